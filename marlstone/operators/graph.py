"""Evidence graphs: typed nodes and edges from a run's record, integrity checks, cycles, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.text import short_label
from ..session import discard, materialise

#: Fixed: the triples (source type, edge type, target type) that may appear; an objection may target any type.
NODE_TYPES = ("issue", "position", "claim", "argument", "counterargument", "objection", "evidence", "document", "statute_section")
ALLOWED = (
    ("position", "about_issue", "issue"),
    ("evidence", "about_issue", "issue"),
    ("claim", "supports", "position"),
    ("argument", "supports", "claim"),
    ("argument", "supports", "counterargument"),
    ("document", "supports", "argument"),
    ("document", "challenges", "argument"),
    ("counterargument", "challenges", "claim"),
    ("claim", "cites", "evidence"),
    ("evidence", "quotes", "document"),
    ("evidence", "quotes", "statute_section"),
    ("document", "case_cites_case", "document"),
    *((("objection", "targets", t)) for t in NODE_TYPES),
)
#: Fixed: edge weights by the status of a citation or claim, and edge type and weight by a precedent's fit.
CITATION_WEIGHT = {"verified": 1.0, "weak": 0.5, "unsupported": 0.0, "invalid": 0.0}
CLAIM_WEIGHT = {"verified": 1.0, "survives": 1.0, "weak": 0.5, "contested": 0.5, "unsupported": 0.0, "falls": 0.0}
FIT = {"directly_supports": ("supports", 1.0), "supports_by_analogy": ("supports", 0.5), "does_not_support": ("supports", 0.0), "distinguishable": ("challenges", 0.5), "contrary": ("challenges", 1.0)}
FALLEN = ("falls", "unsupported")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def edge_weights(claims: DataFrame) -> DataFrame:
    return claims.withColumn("weight", lookup(CLAIM_WEIGHT, F.col("status")))


def build_graph(issues: DataFrame, positions: DataFrame, evidence: DataFrame, claims: DataFrame, arguments: DataFrame, citations: DataFrame, results: DataFrame, objections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (run_id, id, type, label, issue_id) and edges (run_id, source, target, type, weight) of all runs.

    The first node of an ID wins, an edge needs both its ends, and an edge is there once. A claim cites an evidence
    with the weight of the pair's best result. Every frame has run_id; ``evidence`` has document_id and
    section_id (null for judgments), ``arguments`` claim_id, ``objections`` target_id.
    """

    def node(df, ident, kind, label, issue):
        return df.select("run_id", F.col(ident).cast("string").alias("id"), F.lit(kind).alias("type"), short_label(F.col(label).cast("string")).alias("label"), F.col(issue).cast("string").alias("issue_id"))

    source = F.coalesce("section_id", "document_id")
    nodes = [
        node(issues, "issue_id", "issue", "question", "issue_id"),
        node(positions, "position_id", "position", "statement", "issue_id"),
        node(evidence, "evidence_id", "evidence", "evidence_id", "issue_id"),
        node(evidence.where("section_id is null"), "document_id", "document", "document_id", "issue_id"),
        node(evidence.where("section_id is not null"), "section_id", "statute_section", "section_id", "issue_id"),
        node(claims.join(positions.select("run_id", "position_id", "issue_id"), ["run_id", "position_id"], "left"), "claim_id", "claim", "text", "issue_id"),
        node(arguments.withColumn("none", F.lit(None).cast("string")), "argument_id", "argument", "argument_id", "none"),
        node(objections.withColumn("none", F.lit(None).cast("string")), "objection_id", "objection", "objection_id", "none"),
    ]
    ranked = nodes[0].withColumn("nth", F.lit(0))
    for i, x in enumerate(nodes[1:], 1):
        ranked = ranked.unionByName(x.withColumn("nth", F.lit(i)))
    first = ranked.withColumn("pick", F.row_number().over(W.partitionBy("run_id", "id").orderBy("nth", F.col("issue_id").asc_nulls_last(), "label"))).where("pick = 1").drop("nth", "pick")
    first = materialise(first, "nodes")  # both ends of the edges ask for them, and so do those who get them

    def edge(df, a, b, kind, weight=None):
        return df.select("run_id", F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("type"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"))

    rank = F.max(lookup({"invalid": 0, "unsupported": 1, "weak": 2, "verified": 3}, F.col("status")))
    best = results.groupBy("run_id", "claim_id", "evidence_id").agg(F.max_by("status", lookup({"invalid": 0, "unsupported": 1, "weak": 2, "verified": 3}, F.col("status"))).alias("status"), rank.alias("rank"))
    cites = citations.join(best, ["run_id", "claim_id", "evidence_id"], "left")
    edges = edge(positions, "position_id", "issue_id", "about_issue")
    for x in (
        edge(evidence, "evidence_id", "issue_id", "about_issue"),
        edge(evidence.withColumn("src", source), "evidence_id", "src", "quotes"),
        edge(claims, "claim_id", "position_id", "supports", lookup(CLAIM_WEIGHT, F.col("status"))),
        edge(arguments, "argument_id", "claim_id", "supports"),
        edge(cites, "claim_id", "evidence_id", "cites", lookup(CITATION_WEIGHT, F.col("status"))),
        edge(objections, "objection_id", "target_id", "targets"),
    ):
        edges = edges.unionByName(x)
    ids = first.select("run_id", "id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["run_id", end], "left_semi")
    return first, edges.distinct()


def check_graph(nodes: DataFrame, edges: DataFrame, record: DataFrame) -> DataFrame:
    """Problems of graphs: run_id, problem, item. ``record`` has run_id, type, id of what the runs really hold.

    Nodes with the record are shuffled once, nodes once more for their types, edges once for each end. Edges that ``build_graph`` made lie by their targets already.
    """
    spark = nodes.sparkSession
    allowed = F.broadcast(spark.createDataFrame([(*a, True) for a in ALLOWED], "source_type string, type string, target_type string, allowed boolean"))
    times = lambda df, *columns: df.select("run_id", *columns, F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
    part = lambda df, n: df.select("run_id", "id", "type", F.lit(n).alias("n"))
    held = part(nodes, 1).unionByName(part(record, 0)).repartition("run_id", "id")
    typed = held.groupBy("run_id", "id", "type").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 0")
    foreign = F.when((F.col("least") == 1) | F.col("run_id").isNull() | F.col("id").isNull() | F.col("type").isNull(), F.col("n")).otherwise(0)
    told = typed.groupBy("run_id", "id").agg(F.when(F.sum("n") > 1, 1).otherwise(0).cast("long").alias("node appears twice"), F.sum(foreign).alias("node not in the record"))
    found = told.unpivot(["run_id", "id"], ["node appears twice", "node not in the record"], "problem", "n").where("n > 0")
    of_nodes = times(found, "problem", F.col("id").alias("item"))
    kinds = nodes.groupBy("run_id", "id").agg(F.max("type").alias("t"))
    end = lambda name: kinds.select("run_id", F.col("id").alias(name), F.col("t").alias(f"{name}_type"))
    named = edges.join(end("target"), ["run_id", "target"], "left").groupBy("run_id", "source", "target", "type", "target_type").agg(F.count("*").alias("n"))
    ends = named.join(end("source"), ["run_id", "source"], "left").join(allowed, ["source_type", "type", "target_type"], "left")
    wrong = F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "an end is no node").when(F.col("allowed").isNull(), "edge not allowed")
    found = F.filter(F.array(wrong, F.when(F.col("n") > 1, "edge appears twice")), lambda x: x.isNotNull())
    bad = ends.select("run_id", F.concat("source", F.lit(" -> "), "target").alias("item"), "n", F.explode(found).alias("problem"))
    once = bad.withColumn("n", F.when(F.col("problem") == "edge appears twice", 1).otherwise(F.col("n")))
    return of_nodes.unionByName(times(once, "problem", "item"))


def claim_support(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """run_id, claim_id, support: verified, weak or none, by the best citation (cites: run_id, claim_id, verification)."""
    best = F.max(lookup({"weak": 1, "verified": 2}, F.col("verification")))
    s = claims.join(cites, ["run_id", "claim_id"], "left").groupBy("run_id", "claim_id").agg(best.alias("b"))
    return s.select("run_id", "claim_id", F.when(F.col("b") == 2, "verified").when(F.col("b") == 1, "weak").otherwise("none").alias("support"))


def orphan_claims(claims: DataFrame, cites: DataFrame) -> DataFrame:
    return claim_support(claims, cites).where("support = 'none'").select("run_id", "claim_id")


def weak_only_claims(claims: DataFrame, cites: DataFrame) -> DataFrame:
    return claim_support(claims, cites).where("support = 'weak'").select("run_id", "claim_id")


def _supported_positions(claims: DataFrame, cites: DataFrame) -> DataFrame:
    ok = claim_support(claims, cites).where("support = 'verified'")
    standing = claims.where(~F.coalesce(F.col("status").isin(*FALLEN), F.lit(False)))
    return standing.join(ok, ["run_id", "claim_id"], "left_semi").select("run_id", "position_id").distinct()


def unverified_positions(positions: DataFrame, claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Positions without a standing claim with a verified citation."""
    return positions.join(_supported_positions(claims, cites), ["run_id", "position_id"], "left_anti").select("run_id", "issue_id", "position_id")


def contested_issues(positions: DataFrame, claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Issues with two or more supported positions."""
    s = positions.join(_supported_positions(claims, cites), ["run_id", "position_id"], "left_semi")
    return s.groupBy("run_id", "issue_id").agg(F.count_distinct("position_id").alias("supported")).where("supported >= 2")


def support_relation(edges: DataFrame) -> DataFrame:
    """From supporter to supported: supports as it is, cites and quotes turned round."""
    forward = edges.where("type = 'supports'").select("run_id", "source", "target")
    back = edges.where("type in ('cites', 'quotes')").select("run_id", F.col("target").alias("source"), F.col("source").alias("target"))
    return forward.unionByName(back)


#: Edges of a run up to which one task finds its components.
LOCAL_EDGES = 1_000_000


def strong_components(pairs: list[tuple]) -> dict:
    """Component number of every node that is on a loop: one depth-first pass with low links, without recursion."""
    out: dict = {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
        out.setdefault(t, [])
    loops = {s for s, t in pairs if s == t}
    number, low, held, on, found = {}, {}, [], set(), {}
    for root in out:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    held.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(held.pop())
                        on.discard(members[-1])
                    if len(members) > 1 or node in loops:
                        found.update(dict.fromkeys(members, number[node]))
    return found


def _local_components(edges: DataFrame) -> DataFrame:
    """run_id, node, label (one node of its component) of runs that each fit one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = strong_components(list(zip(pdf["source"].tolist(), pdf["target"].tolist())))
        first: dict = {}
        for node, c in found.items():
            first.setdefault(c, node)
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]] * len(found), "node": list(found), "label": [first[c] for c in found.values()]}, dtype=object)

    t = {c: edges.schema[c].dataType.simpleString() for c in edges.columns}
    return edges.groupBy("run_id").applyInPandas(run, f"run_id {t['run_id']}, node {t['source']}, label {t['source']}")


def _trim(edges: DataFrame) -> DataFrame:
    """Edges without those whose source nothing leads to or whose target leads nowhere."""
    ins = edges.select("run_id", F.col("target").alias("source")).distinct()
    outs = edges.select("run_id", F.col("source").alias("target")).distinct()
    return edges.join(ins, ["run_id", "source"], "left_semi").join(outs, ["run_id", "target"], "left_semi").select("run_id", "source", "target")


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with some nodes of one way in and one way out taken from between their neighbours, and those nodes: run_id, node, before, after.

    Of such nodes side by side the one of least hash goes, so a chain loses about a third of its nodes at once.
    """
    one = edges.groupBy("run_id", F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.min("source").alias("before"))
    two = edges.groupBy("run_id", F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.min("target").alias("after"))
    thin = one.join(two, ["run_id", "node"]).where("n_in = 1 and n_out = 1 and node <> before").select("run_id", "node", "before", "after", F.xxhash64("node").alias("h"))
    thin = materialise(thin, "thin")
    side = lambda name: thin.select("run_id", F.col("node").alias(name), F.struct("h", "node").alias(f"h_{name}"))
    near = thin.join(side("before"), ["run_id", "before"], "left").join(side("after"), ["run_id", "after"], "left")
    mine = F.struct("h", "node")
    gone = near.where((F.col("h_before").isNull() | (mine < F.col("h_before"))) & (F.col("h_after").isNull() | (mine < F.col("h_after"))))
    gone = materialise(gone.select("run_id", "node", "before", "after"), "gone")
    left = edges.join(gone.select("run_id", F.col("node").alias("source")), ["run_id", "source"], "left_anti").join(gone.select("run_id", F.col("node").alias("target")), ["run_id", "target"], "left_anti")
    left = left.select("run_id", "source", "target").unionByName(gone.select("run_id", F.col("before").alias("source"), F.col("after").alias("target"))).distinct()
    out = materialise(left, "core")
    discard(thin)
    return out, gone


def _spread_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges: rounds of one join and one aggregate, each of a row an edge."""
    cur = materialise(labels, "labels")
    while True:
        sent = edges.join(cur.withColumnRenamed("node", "source"), ["run_id", "source"]).select("run_id", F.col("target").alias("node"), "label")
        nxt = materialise(cur.unionByName(sent).groupBy("run_id", "node").agg(F.min("label").alias("label")), "labels")
        same = nxt.join(cur, ["run_id", "node", "label"], "left_anti").limit(1).count() == 0
        discard(cur)
        cur = nxt
        if same:
            return cur


def _colour(edges: DataFrame) -> DataFrame:
    """run_id, node, label of the components that hold the root of a colour, and of trivial ones.

    Forward, each node takes the least node that reaches it as its colour. Backward, within a colour, the root's component is what
    reaches the root. Every colour gives one component, so the rest shrinks with each call.
    """
    nodes = edges.select("run_id", F.col("source").alias("node")).union(edges.select("run_id", F.col("target").alias("node"))).distinct()
    colour = _spread_labels(edges, nodes.withColumn("label", F.col("node")))
    kept = edges.join(colour.select("run_id", F.col("node").alias("source"), F.col("label").alias("from")), ["run_id", "source"]).join(colour.select("run_id", F.col("node").alias("target"), F.col("label").alias("to")), ["run_id", "target"]).where(F.col("from") == F.col("to"))
    back = materialise(kept.select("run_id", F.col("target").alias("source"), F.col("source").alias("target")), "back")
    out = materialise(_spread_labels(back, colour.where("node = label")), "component")
    discard(back)
    return out


def cycles(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Strongly connected components with a loop: run_id, component (its least node), node.

    A run of at most ``local_edges`` edges is settled by one task. Larger ones shrink by rounds, each of a row an edge: nodes without a way
    in or out go, and nodes between just two others are taken from between them (they are in their neighbours' component if
    both are in one); runs that have become small leave. Where that no longer helps, components are taken out by colours. Pairs
    of nodes that reach one another are never made.
    """
    core = materialise(edges.select("run_id", "source", "target").distinct(), "core")
    done, gone, n = [], [], core.count()
    while n:
        small = core.groupBy("run_id").count().where(F.col("count") <= local_edges).select("run_id")
        now = materialise(_local_components(core.join(small, "run_id", "left_semi")), "components")
        done.append(now)
        large = materialise(core.join(small, "run_id", "left_anti"), "core")
        discard(core)
        core, taken = _contract(materialise(_trim(large), "core"))
        gone.append(taken)
        was, n = n, core.count()
        if n > 0.9 * was:
            found = _colour(core)
            looped = core.where("source = target").select("run_id", F.col("source").alias("node"))
            sizes = found.groupBy("run_id", "label").agg(F.count("*").alias("n"))
            real = found.join(sizes.where("n > 1").select("run_id", "label"), ["run_id", "label"], "left_semi").unionByName(found.join(looped, ["run_id", "node"], "left_semi").select(found.columns)).distinct()
            done.append(materialise(real, "components"))
            ends = lambda name: found.select("run_id", F.col("node").alias(name))
            rest = materialise(core.join(ends("source"), ["run_id", "source"], "left_anti").join(ends("target"), ["run_id", "target"], "left_anti").select("run_id", "source", "target"), "core")
            discard(core)
            core, n = rest, rest.count()
    known = edges.select("run_id", F.col("source").alias("node"), F.col("source").alias("label")).limit(0)
    for part in done:
        known = known.unionByName(part.select("run_id", "node", "label"))
    for taken in reversed(gone):
        at = lambda name: known.select("run_id", F.col("node").alias(name), F.col("label").alias(f"l_{name}"))
        back = taken.join(at("before"), ["run_id", "before"]).join(at("after"), ["run_id", "after"]).where("l_before = l_after")
        known = materialise(known.unionByName(back.select("run_id", "node", F.col("l_before").alias("label"))), "components")
    least = known.groupBy("run_id", "label").agg(F.min("node").alias("component"))
    return known.join(least, ["run_id", "label"]).select("run_id", "component", "node")


def hints(positions: DataFrame, claims: DataFrame, cites: DataFrame) -> DataFrame:
    """run_id, issue_id, hint: what the checks say, as sentences."""
    bad = unverified_positions(positions, claims, cites).groupBy("run_id", "issue_id").agg(F.array_sort(F.collect_list("position_id")).alias("missing"))
    n = positions.groupBy("run_id", "issue_id").agg(F.count("*").alias("n"))
    text = F.when(F.size("missing") == F.col("n"), F.concat(F.lit("On "), "issue_id", F.lit(" no position rests on verified evidence."))).otherwise(
        F.concat(F.array_join("missing", ", "), F.when(F.size("missing") == 1, " has").otherwise(" have"), F.lit(" no verified support."))
    )
    a = bad.join(n, ["run_id", "issue_id"]).select("run_id", "issue_id", text.alias("hint"))
    both = positions.join(_supported_positions(claims, cites), ["run_id", "position_id"], "left_semi").groupBy("run_id", "issue_id").agg(F.array_sort(F.collect_set("position_id")).alias("p")).where(F.size("p") >= 2)
    b = both.select("run_id", "issue_id", F.concat("issue_id", F.lit(" is contested: "), F.array_join("p", ", "), F.lit(" rest on verified evidence.")).alias("hint"))
    return a.unionByName(b)


def graph_rates(claims: DataFrame, positions: DataFrame, issues: DataFrame, cites: DataFrame) -> DataFrame:
    """Per run: shares of orphan and weak-only claims, unverified positions and contested issues; null over nothing."""
    s = claim_support(claims, cites).groupBy("run_id").agg(F.avg((F.col("support") == "none").cast("double")).alias("orphan_rate"), F.avg((F.col("support") == "weak").cast("double")).alias("weak_only_rate"))
    p = positions.groupBy("run_id").agg(F.count("*").alias("np")).join(unverified_positions(positions, claims, cites).groupBy("run_id").agg(F.count("*").alias("u")), "run_id", "left").select("run_id", (F.coalesce("u", F.lit(0)) / F.col("np")).alias("unverified_rate"))
    i = issues.groupBy("run_id").agg(F.count("*").alias("ni")).join(contested_issues(positions, claims, cites).groupBy("run_id").agg(F.count("*").alias("c")), "run_id", "left").select("run_id", (F.coalesce("c", F.lit(0)) / F.col("ni")).alias("contested_rate"))
    return s.join(p, "run_id", "full_outer").join(i, "run_id", "full_outer")
