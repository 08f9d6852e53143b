"""Checks of evidence graphs that have every kind of problem, and how often their edges are moved."""

import re

from marlstone.operators import graph as G

NODE, EDGE = "run_id long, id string, type string", "run_id long, source string, target string, type string, weight double"


def test_every_problem_is_told(spark):
    nodes = [(1, "I", "issue"), (1, "P", "position"), (1, "C", "claim"), (1, "C", "claim"), (1, "X", "argument"), (2, "P", "position"), (2, "E", "evidence"), (2, "E", "claim")]
    record = [(1, "I", "issue"), (1, "P", "position"), (1, "C", "claim"), (1, "X", "claim"), (2, "P", "position"), (2, "E", "evidence"), (2, "new", "issue")]
    edges = [(1, "P", "I", "about_issue", None), (1, "P", "I", "about_issue", 1.0), (1, "I", "P", "about_issue", None), (1, "C", "gone", "cites", None), (1, "C", "gone", "cites", None), (1, "C", "P", "supports", 1.0), (2, "P", "I", "about_issue", None), (1, "C", "P", "cites", 1.0)]
    got = G.check_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(record, NODE).select("run_id", "type", "id"))
    want = [(1, "node appears twice", "C"), (2, "node appears twice", "E"), (1, "node not in the record", "X"), (2, "node not in the record", "E"), (1, "an end is no node", "C -> gone"), (1, "an end is no node", "C -> gone")]
    want += [(2, "an end is no node", "P -> I"), (1, "edge not allowed", "I -> P"), (1, "edge not allowed", "C -> P"), (1, "edge appears twice", "C -> gone"), (1, "edge appears twice", "P -> I")]
    assert sorted(map(tuple, got.select("run_id", "problem", "item").collect())) == sorted(want)


def test_edges_are_moved_once_an_end(spark):
    nodes, edges = spark.createDataFrame([(1, "I", "issue")], NODE), spark.createDataFrame([(1, "I", "I", "targets", None)], EDGE)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = G.check_graph(nodes, edges, nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    moves = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(moves) == 4 and sum(bool(re.search(r"run_id#\d+L, (source|target)#", x)) for x in moves) == 2


def test_runs_are_checked_in_turn(spark, monkeypatch):
    """Every run is in one turn, and what a turn shuffles is let go of before the next."""
    from marlstone.plans import catalog, retrieval as R

    seen, let_go, build = [], [], G.build_graph
    monkeypatch.setattr(R, "CHECKED", 2000)
    monkeypatch.setattr(R, "release", lambda df: let_go.append(1))

    def built(*parts):
        seen.append({r.run_id for r in parts[3].select("run_id").collect()})
        nodes, edges = build(*parts)
        return nodes, edges.unionByName(edges.where("type = 'quotes'"))

    monkeypatch.setattr(R.G, "build_graph", built)
    got = {r.problem: r.n for r in catalog.QUERIES["check_graph"](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.undo()
    quotes = {r.type: r.n for r in catalog.QUERIES["build_graph"](spark, "/root/testdata/sf0.001").collect()}["quotes"]
    runs = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey").distinct().count()
    assert got == {"edge appears twice": quotes}
    assert len(seen) == len(let_go) > 1 and sum(map(len, seen)) == len(set().union(*seen)) == runs
