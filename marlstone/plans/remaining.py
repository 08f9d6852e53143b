"""Queries of file formats, parsing helpers and the smaller operators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import metadata as M, text as X
from ..functions.udfs import arrow_udf
from ..operators import aggregates as A, citation_graph as G, deliberation as B, dense as D, evaluate as V, events as E, inverted_index as I, lexical as L, structure as T
from ..session import materialise, shared_folder
from ..sources import readers as R, sinks as S
from .registry import query
from .textual import _index, _judgments

c = F.col


def _folder(t, name):
    return f"{shared_folder(t._spark)}/{name}-{uuid.uuid4().hex}"


# ---- file formats, written from driver tables and read back ----


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def scan_jsonl_gz(t):
    p = _folder(t, "jsonl")
    t.nation.write.option("compression", "gzip").json(p)
    return R.scan_jsonl(t._spark, p, "n_nationkey long, n_name string")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 3 = 1")
def scan_parquet_hive_partitions(t):
    p = _folder(t, "hive")
    t.orders.select("o_orderkey", c("o_orderstatus").alias("court"), (c("o_orderkey") % 3).cast("int").alias("year")).write.partitionBy("year", "court").parquet(p)
    return R.scan_parquet_hive_partitions(t._spark, p, ["F", "P"], [1]).select("o_orderkey")


@query("SELECT 'q' || l_orderkey AS query_id, 'd' || l_partkey AS unit FROM lineitem WHERE l_linenumber = 1")
def scan_qrels(t):
    p = _folder(t, "qrels")
    t.lineitem.select(F.concat(F.lit("q"), "l_orderkey", F.lit(" Q0 d"), "l_partkey", F.lit(" "), (c("l_linenumber") == 1).cast("int")).alias("value")).write.text(p)
    return R.scan_qrels(t._spark, p)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS query_id, s_name || ' || x' AS text FROM supplier")
def scan_delimited_text(t):
    p = _folder(t, "delimited")
    t.supplier.select(F.concat(c("s_suppkey").cast("string"), F.lit("||"), "s_name", F.lit(" || x")).alias("value")).write.text(p)
    return R.scan_delimited_text(t._spark, p)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 2 = 0 AS label, s_name AS t1, 'h' AS t2 FROM supplier")
def scan_xml_pairs(t):
    p = _folder(t, "xml")
    label = F.when(c("s_suppkey") % 2 == 0, "Y").otherwise("N")
    pair = F.concat(F.lit('<pair id="'), "s_suppkey", F.lit('" label="'), label, F.lit('"><t1>'), "s_name", F.lit("</t1><t2>h</t2></pair>"))
    one = t.supplier.groupBy("s_nationkey").agg(F.concat(F.lit("<pairs>"), F.array_join(F.collect_list(pair), ""), F.lit("</pairs>")).alias("value"))
    one.write.partitionBy("s_nationkey").text(p)
    return R.scan_xml_pairs(t._spark, p)


@query("SELECT count(*) AS files, CAST(25 AS BIGINT) AS lines FROM range(5)")
def scan_directory_text(t):
    p = _folder(t, "texts")
    t.nation.repartitionByRange(5, "n_regionkey").select(c("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(p)
    d = R.scan_directory_text(t._spark, f"{p}/*/*.txt")
    return d.agg(F.count("*").alias("files"), F.sum(F.regexp_count("text", F.lit("NATION"))).alias("lines"))


@query("SELECT 'ica' AS name, 'Contract Act' AS title, '1872' AS year UNION ALL SELECT 'sra', 'Specific Relief Act', NULL")
def scan_yaml_config(t):
    y = R.parse_simple_yaml("acts:\n  ica:\n    title: Contract Act\n    year: 1872\n  sra:\n    title: Specific Relief Act\n    year: null\n")
    return R.scan_config(t._spark, y["acts"], ["title", "year"])


@query("SELECT 'x' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'y', count(*) FROM region")
def load_all(t):
    return S.load_all(t._spark, _folder(t, "tables"), {"x": (t.nation, ["n_nationkey"]), "y": (t.region, ["r_regionkey"])})


@query("SELECT run_id, CAST(seq AS BIGINT) AS arrival FROM ev WHERE NOT (seq > 1 AND event_id % 7 = 0)")
def append_event(t):
    e = t.ev.select("run_id", F.lit("c").alias("case_id"), c("seq").cast("long").alias("arrival"), F.when((c("seq") > 1) & (c("event_id") % 7 == 0), 0).otherwise(c("seq")).cast("long").alias("seq"), F.when(c("seq") == 1, "case_created").otherwise("x").alias("type"))
    first = e.where("arrival = 1")
    ok, _ = S.append_event(first, e.where("arrival > 1 and seq > 0"), "case_created")
    return ok.select("run_id", "arrival")


@query("SELECT CAST(2 AS BIGINT) AS documents")
def write_manifest(t):
    p = _folder(t, "manifest")
    for n in (2, 9):
        S.write_manifest(t._spark.createDataFrame([(n,)], "documents long"), p)
    return t._spark.read.parquet(p)


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def atomic_json(t):
    p = _folder(t, "json")
    S.atomic_json(t.region, p)
    return t._spark.read.schema("r_regionkey long, r_name string").json(p)


# ---- parsing helpers ----


@query("SELECT p_partkey, CAST(1963 AS BIGINT) AS year, CAST(p_size AS BIGINT) AS volume, true AS supp, CAST(22 AS BIGINT) AS page, 'SCR' AS reporter FROM part WHERE p_size BETWEEN 1 AND 99")
def parse_citation(t):
    from ..functions.citations import find_citations

    s = F.get(find_citations(F.concat(F.lit("[1963] Supp. "), c("p_size").cast("string"), F.lit(" S.C.R. 22"))), 0)
    return t.part.where("p_size between 1 and 99").select("p_partkey", s.alias("s")).select("p_partkey", "s.year", "s.volume", "s.supp", "s.page", "s.reporter")


@query("SELECT l_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS paragraphs FROM (SELECT DISTINCT l_orderkey, l_suppkey AS v FROM lineitem) GROUP BY 1")
def para_key(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(c("l_suppkey").cast("string")).alias("p"))
    return g.select("l_orderkey", F.array_join(A.natural_sort(c("p")), ",").alias("paragraphs"))


@query("SELECT n_nationkey, 'J.L. ' || replace(n_name, '_', '') AS judge FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, regexp_replace(n_name, '_[0-9]+', '') AS n_name FROM nation)")
def clean_judge(t):
    name = F.concat(F.lit("HON'BLE MR. JUSTICE J. L. "), F.regexp_replace("n_name", "_[0-9]+", ""), F.lit(", C.J.I."))
    return t.nation.select("n_nationkey", M.clean_judge(name).alias("judge"))


@query("SELECT s_suppkey, 'breach of \"s. ' || s_suppkey || '\" by ' || s_name AS query FROM supplier")
def quote_references(t):
    quote = arrow_udf("string")(_quote)
    return t.supplier.select("s_suppkey", quote(F.concat(F.lit("breach of s. "), c("s_suppkey").cast("string"), F.lit(" by "), "s_name")).alias("query"))


def _quote(s: pd.Series) -> pd.Series:
    return s.map(L.quote_references)


@query("SELECT s_suppkey AS query_id, 'terms' AS kind, unnest(['breach', '\"s. ' || s_suppkey || '\"']) AS term FROM supplier UNION ALL SELECT s_suppkey, 'excluded', 'x' || s_suppkey FROM supplier")
def parse_query(t):
    n = c("s_suppkey").cast("string")
    q = t.supplier.select(c("s_suppkey").alias("query_id"), F.concat(F.lit("breach OR s. "), n, F.lit(" -- -x"), n).alias("query"))
    return L.query_terms(q)


@query("SELECT s_suppkey AS run_id, 'p' AS place, 'held [E-001] [E-003], see [E-009] [E-010] and [note].' AS text FROM supplier")
def normalise_refs(t):
    x = t.supplier.select(c("s_suppkey").alias("run_id"), F.lit("p").alias("place"), F.lit("held [E-1, e3] , see [C-4] and [note] .").alias("text"))
    a = t.supplier.select(c("s_suppkey").alias("run_id"), F.lit("A-001").alias("argument_id"), F.lit("C-004").alias("claim_id"), F.inline(F.array(*[F.struct(F.lit(e).alias("evidence_id"), F.lit(i).alias("nth")) for i, e in enumerate(("E-009", "E-010"))])))
    return B.normalise_refs(x, a)


@query("SELECT source AS name, sha256(string_agg(lang, ',' ORDER BY lang)) AS hash FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1")
def prompt_hash(t):
    g = t.documents.groupBy(c("source").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("x"))
    return g.select("name", F.sha2("x", 256).alias("hash"))


# ---- pieces of the structure operators ----


def _seg(t, text):
    return T.segment(t.part.select(c("p_partkey").alias("doc_id"), text.alias("text")))


@query("SELECT p_partkey, CAST(3 AS BIGINT) AS dropped FROM part")
def signature_blocks(t):
    page = F.concat(F.lit("Text of part "), c("p_partkey").cast("string"), F.lit(" that is kept.\nDigitally signed by\nA B\n17:03:43 IST"))
    d = T.clean_document(t.part.select("p_partkey", F.array(page).alias("pages"), F.lit("hc").alias("profile")))
    return d.select("p_partkey", c("clean.stats")["dropped_signature"].alias("dropped"))


@query("SELECT p_partkey, 'The contract \"x\" was fixed by ' || p_name AS text FROM part")
def fix_line(t):
    page = F.concat(F.lit("The  con­tract “x” was fi xed by "), c("p_name"))
    d = T.clean_document(t.part.select("p_partkey", F.array(page).alias("pages"), F.lit("hc").alias("profile")))
    return d.select("p_partkey", c("clean.text").alias("text"))


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'symbols' WHEN 2 THEN 'page_number' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def drop_reason(t):
    line = F.get(F.array(F.lit(" "), F.lit("--*--"), F.lit("Page 3 of 9"), F.lit("words of a line")), (c("p_partkey") % 4).cast("int"))
    d = T.clean_document(t.part.select("p_partkey", F.array(line).alias("pages"), F.lit("hc").alias("profile")))
    s = c("clean.stats")
    why = F.when(s["dropped_blank"] > 0, "blank").when(s["dropped_symbols"] > 0, "symbols").when(s["dropped_page_number"] > 0, "page_number").otherwise("kept")
    return d.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS first, CAST(p_size + 2 AS BIGINT) AS last FROM part WHERE p_size BETWEEN 1 AND 900")
def candidate_of(t):
    n, m = c("p_size").cast("string"), (c("p_size") + 2).cast("string")
    pick = arrow_udf("first int, last int")(_number)
    return t.part.where("p_size between 1 and 900").select("p_partkey", pick(F.concat(n, F.lit("-"), m, F.lit(". The appeal"))).alias("k")).select("p_partkey", "k.first", "k.last")


def _number(s: pd.Series) -> pd.DataFrame:
    got = [T.number_of(x) for x in s]
    return pd.DataFrame({"first": [g and g.first for g in got], "last": [g and g.last for g in got]})



@query("SELECT p_partkey AS doc_id, CAST(9 AS BIGINT) AS members, CAST(1 AS BIGINT) AS parts FROM part")
def best_chain(t):
    text = F.concat(F.lit("JUDGMENT\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(i.cast("string"), F.lit(". Words of part "), c("p_partkey").cast("string"), F.lit("."))), "\n"))
    return _seg(t, text).where("numbering = 'explicit'").groupBy("doc_id").agg(F.count("*").alias("members"), F.max("part").alias("parts"))


@query("SELECT p_partkey AS doc_id, CAST(2 AS BIGINT) AS parts FROM part")
def find_chains(t):
    one = "\n".join(f"{i}. Words of the first opinion, number {i}." for i in range(1, 13))
    two = "\n".join(f"{i}. Words of the second opinion, number {i}." for i in range(1, 12))
    return _seg(t, F.concat(F.lit(f"JUDGMENT\n{one}\nRAO, J.\n{two}\n"), c("p_name"))).groupBy("doc_id").agg(F.max("part").alias("parts"))


@query("SELECT p_partkey AS doc_id, 'p-1' AS no FROM part UNION ALL SELECT p_partkey, 'p-2' FROM part")
def infer_blocks(t):
    text = F.lit("This is a long line of the first paragraph that goes on\nand ends here.\nThis is a long line of the second paragraph that goes on\nand on to the end.")
    return _seg(t, text).select("doc_id", "no")


@query("SELECT p_partkey AS doc_id, unnest(['front', 'headnote', 'front', 'body']) AS section FROM part")
def front_headnote_split(t):
    body = "\n".join(f"{i}. Words of the opinion, number {i}, of some length." for i in range(1, 12))
    text = F.lit(f"A v. B\nHEADNOTE\nIt was held so.\nCIVIL APPELLATE JURISDICTION : Appeal\n{body}")
    s = _seg(t, text).groupBy("doc_id", "section", F.when(c("section") == "front", c("seq")).otherwise(0)).agg(F.count("*").alias("n"))
    return s.select("doc_id", "section")


@query("SELECT p_partkey AS doc_id, 'body' AS section, 'The facts are these.' AS text FROM part")
def body_start(t):
    lines = ["A v. B", "The Judgment of the Court was delivered by", "The facts are these."] + ["More of the facts follows here in full."] * 3
    return _seg(t, F.lit("\n".join(lines))).where("section = 'body'").groupBy("doc_id", "section").agg(F.min_by("text", "seq").alias("text")).withColumn("text", F.substring_index("text", "\n", 1))


@query("SELECT p_partkey AS doc_id, '4' AS no FROM part")
def contested_flag(t):
    lines = ["JUDGMENT"] + [f"{i}. Words of the opinion, number {i}, of some length." for i in range(1, 12)]
    lines.insert(5, "The clause quoted reads as under:\n4. Whether the seller must pay at all.")
    return _seg(t, F.lit("\n".join(lines))).where("contested").select("doc_id", "no")


@query("SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS chunks FROM part")
def merge_tails(t):
    lines = ["JUDGMENT"] + [f"{i}. Words of it." for i in range(1, 12)]
    d = t.part.select(c("p_partkey").alias("doc_id"), F.lit("t").alias("title"), F.lit("\n".join(lines[1:])).alias("text"))
    return T.chunk_judgment(d).where("kind = 'paragraphs'").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("SELECT s_suppkey, CAST(2 AS BIGINT) AS sentences FROM supplier")
def sentences(t):
    return t.supplier.select("s_suppkey", F.size(E.sentences(F.concat(F.lit("Held "), "s_name", F.lit(". [E-1] Then it ended.")))).alias("sentences"))


@query("SELECT doc_id FROM documents")
def split_windows(t):
    """Windows of long texts hold at most their tokens, advance, and lose nothing but overlap: documents for which it is so."""
    ok = arrow_udf("boolean")(_windows_hold)
    return t.documents.where(ok("text")).select("doc_id")


def _windows_hold(s: pd.Series) -> pd.Series:
    def good(x):
        w, hard = T.split_windows(x, 100, 20)
        small = all(T.count_tokens(x[a:b]) <= 100 for a, b in w)
        return small and all(p[0] < q[0] for p, q in zip(w, w[1:])) and (hard or {t for a, b in w for t in x[a:b].split()} == set(x.split()))

    return s.map(good)


@query("SELECT p_partkey, CAST(1 + ceil(greatest(0, p_size + 1 - 10) / 9.0) AS BIGINT) AS windows FROM part")
def hard_windows(t):
    n = arrow_udf("int")(_hard)
    return t.part.select("p_partkey", n(F.repeat(F.lit("w "), c("p_size") + 1)).alias("windows"))


def _hard(s: pd.Series) -> pd.Series:
    return s.map(lambda x: len(T.hard_windows(x, 10)))


def _section_texts(t):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), c("p_size") + 1), lambda i: F.concat(F.lit("("), i.cast("string"), F.lit(") words"))), "\n")
    return t.part.select(F.lit("x").alias("act_id"), F.lit("Act X").alias("act"), c("p_partkey").cast("string").alias("section"), F.lit("T").alias("title"), lines.alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS section, CASE WHEN (p_size + 1) * 4 <= 40 THEN 'section' ELSE 'section-lines' END AS kind, CASE WHEN (p_size + 1) * 4 <= 40 THEN 1 ELSE CAST(ceil((p_size + 1) / 8.0) AS BIGINT) END AS chunks FROM part")
def chunk_statute_section(t):
    return T.chunk_statute_section(_section_texts(t), 40).groupBy("section", "kind").agg(F.count("*").alias("chunks"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS section, CAST((p_size + 1) * 4 AS BIGINT) AS tokens FROM part")
def line_windows(t):
    return T.chunk_statute_section(_section_texts(t), 40).groupBy("section").agg(F.sum("tokens").alias("tokens"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\x0b\f]')) AS BIGINT) AS tokens FROM documents")
def count_tokens(t):
    n = arrow_udf("int")(_tokens)
    return t.documents.select("doc_id", n("text").alias("tokens"))


def _tokens(s: pd.Series) -> pd.Series:
    return s.map(T.count_tokens)


@query("SELECT p_partkey AS act_id, unnest(['1', '2']) AS section FROM part")
def arrangement(t):
    text = F.concat(F.lit("1. Short title\n2. Words\n\n1. Short title.- Part "), c("p_partkey").cast("string"), F.lit(".\n2. Words.- Two.\n"))
    return T.split_act(t.part.select(c("p_partkey").alias("act_id"), text.alias("text"))).select("act_id", "section")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Act 18 of 2018,Act 4 of 1930' ELSE '' END AS acts FROM part")
def amended_by(t):
    notes = F.when(c("p_partkey") % 2 == 0, "Subs. by Act 18 of 2018, s. 2. Ins. by Act 4 of 1930; added by Act 18 of 2018").otherwise("See Act 5 of 1900")
    return t.part.select("p_partkey", F.array_join(T.amended_by(notes), ",").alias("acts"))


@query("SELECT p_partkey, '(1),(2A)' AS labels FROM part")
def sub_sections(t):
    return t.part.select("p_partkey", F.array_join(T.sub_sections(F.concat(c("p_name"), F.lit("— (1) one\n(2A) two\n(1) again"))), ",").alias("labels"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS repealed FROM part")
def repealed(t):
    return t.part.select("p_partkey", T.is_repealed(F.when(c("p_partkey") % 2 == 0, "7. [Repealed.]").otherwise("7. Words")).alias("repealed"))


# ---- citation graph, retrieval and evaluation in parts ----


def _grouped(t):
    spans, neutral = G.build_index(_index(t))
    return materialise(G.direct_targets(G.parallel_groups(G.mentions(_judgments(t))), spans, neutral), "mentions")


@query("SELECT resolution, count(*) AS n FROM (SELECT unnest(['direct', 'alias', 'direct', 'alias', 'alias']) AS resolution FROM part) GROUP BY 1")
def resolve_edges(t):
    g = _grouped(t)
    return G.resolve_edges(g, G.learn_aliases(g)).groupBy("resolution").agg(F.count("*").alias("n"))


@query("SELECT 3 * count(*) AS left_over FROM part")
def drop_self_citations(t):
    g = _grouped(t)
    return G.drop_self_citations(G.resolve_edges(g, G.learn_aliases(g))).agg(F.count("*").alias("left_over"))


@query("SELECT DISTINCT target_ref FROM edges WHERE source_doc_id % 10 = 0 AND target_ref % 10 <> 0")
def one_hop_expansion(t):
    ids = t.edges.select(c("source_doc_id").alias("doc_id")).unionByName(t.edges.select(c("target_ref").alias("doc_id")))
    core = ids.where("doc_id % 10 = 0").distinct()
    return A.cited_by_count(t.edges, core, 1).select("target_ref")


@query("SELECT lang, round(avg(n_chars * 1.0 / (n_chars + 1)), 6) AS density FROM documents GROUP BY 1")
def density(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg(c("n_chars") / (c("n_chars") + 1)), 6).alias("density"))


@query("SELECT section_id, count(*) AS chunks FROM chunks WHERE section_id = 3 GROUP BY 1")
def section_lookup(t):
    from ..operators.fusion import section_hits

    return section_hits(t.chunks.where("section_id = 3").select("section_id").distinct(), t.chunks).select("section_id", F.size("chunk_ids").alias("chunks"))


@query("SELECT CASE WHEN count(*) <= 5000 THEN 'exact' ELSE 'ann' END AS path FROM documents")
def path_choice(t):
    return t._spark.createDataFrame([(D.path_choice(t.documents.count()),)], "path string")


@query("SELECT 'bge' AS model, CAST(64 AS BIGINT) AS dim UNION ALL SELECT 'e5', 32")
def register_model(t):
    r = t._spark.createDataFrame([("bge", 64)], "model string, dim long")
    return D.register_model(D.register_model(r, "bge", 64), "e5", 32)


@query("SELECT vec_id FROM embeddings")
def prewarm(t):
    v = D.prewarm(t.embeddings.select("vec_id"))
    v.unpersist()
    return v


@query("SELECT DISTINCT l_orderkey AS run_id, 's' || l_suppkey AS section_id FROM lineitem WHERE l_suppkey % 2 = 0 AND l_linenumber < 3")
def analysis_sections(t):
    ev = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("evidence_id"), F.when(c("l_suppkey") % 2 == 0, F.concat(F.lit("s"), c("l_suppkey").cast("string"))).alias("section_id")).distinct()
    refs = t.lineitem.where("l_linenumber < 3").select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("evidence_id")).distinct()
    return B.analysis_sections(ev, refs)


@query()
def paired(t):
    """Differences of two experiments by metric: mean, interval and p-value."""
    from ..operators.joins import paired_items

    m = t.scores.groupBy("experiment", "metric", "item").agg(F.round(F.avg("value"), 6).alias("value"))
    d = paired_items(m.where("experiment = 'x'"), m.where("experiment = 'y'"), ["metric", "item"])
    ci = V.bootstrap_ci(d.select("metric", "item", c("difference").alias("value")), "metric", 200)
    return ci.join(V.sign_flip_p(d, "metric", flips=2000).select("metric", "p_value"), "metric")


@query("SELECT experiment, round(avg(value), 6) AS mean FROM scores GROUP BY 1")
def table(t):
    return V.macro_means(t.scores.select("experiment", "value"), ["experiment"]).select("experiment", c("value").alias("mean"))


@query("SELECT metric, count(v) AS n, round(avg(v), 6) AS mean FROM (SELECT metric, item, avg(value) AS v FROM scores GROUP BY 1, 2) GROUP BY 1")
def aggregate(t):
    m = t.scores.groupBy("metric", "item").agg(F.avg("value").alias("value"))
    return V.aggregate(m, "metric", 100).select("metric", "n", "mean")


@query("SELECT item_id AS doc_id FROM benchmark WHERE item_id % 4 <> 0")
def pool_index(t):
    """A benchmark pool through the corpus code, without the documents that are loaded."""
    new = t.benchmark.select(c("item_id").alias("doc_id"), F.lit("pool").alias("title"), "text").join(t.benchmark.where("item_id % 4 = 0").select(c("item_id").alias("doc_id")), "doc_id", "left_anti")
    return T.chunk_judgment(new).select("doc_id").distinct()


# ---- stages ----


@query("SELECT count(*) AS judged FROM (SELECT DISTINCT p_name, p_brand FROM part)")
def judge_dedupe(t):
    return t.part.select("p_name", "p_brand").dropDuplicates().agg(F.count("*").alias("judged"))


@query("SELECT run_id, bool_or(type = 'purchase') AS ended FROM ev GROUP BY 1")
def ended(t):
    return t.ev.groupBy("run_id").agg(F.bool_or(c("type") == "purchase").alias("ended"))


@query("SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS doc_id, 'unknown' AS fit FROM lineitem WHERE l_suppkey % 2 > 0")
def fallback_card(t):
    k = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("doc_id")).distinct()
    cards = k.where("doc_id % 2 = 0").select("run_id", "doc_id", F.lit("contrary").alias("fit"), F.lit(True).alias("treatment_verified"))
    return B.precedent_cards(k, cards).where("fallback").select("run_id", "doc_id", "fit")


@query("SELECT query_id AS issue_id, chunk_id, rank AS place FROM ranked WHERE list_name = 'a' AND rank <= 8")
def research_stage(t):
    h = t.ranked.where("list_name = 'a'").withColumnRenamed("query_id", "issue_id")
    return B.research_stage(h, h.limit(0), True, 2, 25, 8)


@query("SELECT l_orderkey AS run_id, count(DISTINCT l_suppkey) AS cards, count(DISTINCT l_suppkey) FILTER (l_suppkey % 2 > 0) AS fallbacks FROM lineitem GROUP BY 1")
def precedent_stage(t):
    k = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("doc_id")).distinct()
    return B.precedent_stage(k, k.where("doc_id % 2 = 0").select("run_id", "doc_id", F.lit("contrary").alias("fit"), F.lit(True).alias("treatment_verified")))


@query("SELECT p_partkey AS item, CASE p_partkey % 2 WHEN 0 THEN 'corpus' ELSE 'unknown act' END AS status FROM part")
def b0_resolve(t):
    a = t.part.select(c("p_partkey").alias("item"), F.lit("statute").alias("kind"), F.concat(F.lit("act"), (c("p_partkey") % 2).cast("string")).alias("canonical"), F.lit("t").alias("title"))
    none = t._spark.createDataFrame([], "canonical string, doc_id long, title string, in_corpus boolean")
    return B.authority_resolver(a, none, none.select("doc_id", "title"), t._spark.createDataFrame([("act0",)], "act_id string")).select("item", "status")


@query()
def b1_pipeline(t):
    """Search, numbered evidence, quoted claims, verification, and an answer from what held, for every query at once."""
    from .retrieval import _chunks, _index, _terms

    index = _index(t)
    hits = I.search_any(index, _terms(t, index), 5)
    cit = B.evidence_from_hits(hits, _chunks(t), 5, 20)
    label = lambda claim, text: F.when(F.length(text) % 2 == 0, "supports").otherwise("contradicts")
    checked = E.verify(cit.drop("text"), cit.select("run_id", "evidence_id", "text"), label)
    return B.held_analysis(checked).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT s_suppkey, 'E-001,E-002,C-003' AS ids FROM supplier")
def b1_normalise_ids(t):
    raw = F.array(F.lit("E1"), F.lit(" [e-02] "), F.lit("C-003"))
    return t.supplier.select("s_suppkey", F.array_join(F.transform(raw, lambda r: X.clean_record_id(r, "E")), ",").alias("ids"))


@query("SELECT run_id, seq, round(least(1.0, greatest(0.0, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY run_id ORDER BY seq), 0) / 1e6) / 50000), 4) AS delay FROM ev")
def mock_run(t):
    from ..operators.windows import event_gap

    return event_gap(t.ev, 50000, 1.0).select("run_id", "seq", F.round("delay", 4).alias("delay"))


@query("SELECT 'research' AS stage, 'run' AS outcome UNION ALL SELECT 'jury', 'skipped: budget' UNION ALL SELECT 'framing', 'passthrough' UNION ALL SELECT 'rebuttal', 'skipped'")
def stage_gating(t):
    rows = B.stage_gating([("framing", "passthrough", False, 0.0), ("research", "on", False, 5.0), ("rebuttal", "off", True, 1.0), ("jury", "on", True, 6.0)], 10.0)
    return t._spark.createDataFrame(rows, "stage string, outcome string")


@query("SELECT CAST(1 AS BIGINT) AS exhausted, CAST(5 AS BIGINT) AS usual")
def jury_stage(t):
    return t._spark.createDataFrame([(B.jury_stage(5, True), B.jury_stage(5, False))], "exhausted long, usual long")
