import math

import numpy as np
import pytest

from marlstone.llm import mtree as M


def brute(ids, x, q, k, own):
    s = x @ q
    return sorted(((int(-a), int(i)) for a, i in zip(s, ids) if i != own))[:k]


@pytest.mark.parametrize("kind", ["clusters", "uniform", "equal"])
def test_tree_is_exact_and_prunes(kind):
    rng = np.random.default_rng(3)
    x = {"clusters": rng.integers(-60, 60, (20, 8))[rng.integers(0, 20, 1500)] + rng.integers(-3, 4, (1500, 8)), "uniform": rng.integers(-9, 9, (700, 6)), "equal": np.ones((500, 4), int)}[kind]
    ids = rng.permutation(len(x)) * 3
    tree = M.MTree(ids, x, page=16)
    work = []
    for j in range(0, len(x), 37):
        got, n = tree.search(x[j], 20, int(ids[j]))
        work.append(n)
        assert [(-s, i) for s, i in got] == brute(ids, x, x[j], 20, ids[j])
    if kind == "clusters":
        assert np.mean(work) < 0.5 * len(x)


@pytest.mark.parametrize("kind", ["clusters", "uniform", "equal", "wide"])
def test_blocks_of_queries_equal_single_ones(kind):
    rng = np.random.default_rng(5)
    x = {"clusters": rng.integers(-60, 60, (20, 8))[rng.integers(0, 20, 1500)] + rng.integers(-3, 4, (1500, 8)), "uniform": rng.integers(-9, 9, (700, 6)), "equal": np.ones((500, 4), int), "wide": rng.integers(-(1 << 30), 1 << 30, (90, 3))}[kind]
    ids = rng.permutation(len(x)) * 3
    tree = M.MTree(ids, x, page=16)
    asked = np.arange(0, len(x), 7)
    for k in (1, 20, 2000):
        single = [tree.search(x[j], k, int(ids[j]))[0] for j in asked]
        for least in (np.full(len(asked), -np.inf), np.array([s[-1][0] for s in single], float)):
            who, score, vec = tree.search_many(x[asked], k, ids[asked], least)
            got = [[] for _ in asked]
            for w, s, v in zip(who.tolist(), score.tolist(), vec.tolist()):
                got[w].append((s, v))
            assert got == single


def test_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.round(rng.normal(0, 0.2, 12), 4)], i) for i in range(230)]
    rows += [(300, None, 1), (301, [1.0, None] + [0.0] * 10, 1), (302, [float("nan")] * 12, 1), (None, [0.1] * 12, 1), (320, [], 1), (340, [0.5, 0.5], 1), (341, [0.1, 0.1], 1), (7, rows[7][1], 1), (20, rows[20][1], 1), (303, [float("inf")] * 12, 1)]
    rows += [(400 + i, rows[5][1], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    monkeypatch.setattr(M, "BLOCK", 50)
    rows += [(1, [0.9] * 12, 1), (1, [0.5] * 12, 1), (500, [3e5] * 12, 1), (501, [-1e300] * 12, 1), (502, [70000.5] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in M.top_products(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    long = (1 << 63) - 1
    whole = lambda v: max(-long - 1, min(long, math.floor(64 * v)))
    good = [(i, [whole(v) for v in e]) for i, e, _ in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    want = {}
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            c = sorted((-max(-long, min(long, sum(a * b for a, b in zip(x, v)))), i) for j, (i, v) in enumerate(good) if j != at and len(v) == len(x))[:20]
            want.setdefault(q, []).extend((n + 1, i, -s) for n, (s, i) in enumerate(c))
    assert len(want[20]) == 40 and {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}
    assert M.top_products(df.limit(0)).count() == 0


def test_whole_trees_are_left_out(spark, monkeypatch):
    """On clustered vectors the first tree's bound rules out most others, and results are those of brute force."""
    rng = np.random.default_rng(8)
    turns = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.repeat(turns, 60, axis=0) * 3 + rng.normal(0, 0.02, (960, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(M, "BLOCK", 60)
    kept, real = {}, M.materialise
    monkeypatch.setattr(M, "materialise", lambda d, label="step": kept.setdefault(label, real(d, label)) if label in ("others", "trees") else real(d, label))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in M.top_products(df).collect()}
    v = np.floor(64 * x).astype(int)
    for q in range(0, 960, 20):
        assert [(-s, i) for i, s in (got[q, n] for n in range(1, 21))] == brute(np.arange(960), v, v[q], 20, q)
    assert kept["others"].count() < 0.3 * 48 * kept["trees"].count()
