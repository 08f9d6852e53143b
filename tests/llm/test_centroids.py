import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np

from marlstone.llm import centroids as C


def slow(rows, k=C.CLUSTERS, rounds=C.ROUNDS, dim=C.DIM):
    """Plain integers, one vector at a time."""
    kept = [(i, [math.floor(256 * Fraction(a)) for a in e], e) for i, e in rows if e is not None and len(e) == dim and all(a is not None and math.isfinite(a) for a in e)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    c = [v for _, v, _ in kept[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((d2(v, m), j) for j, m in enumerate(c)) for _, v, _ in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v, _), (_, o) in zip(kept, own) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    cap = lambda x: min(x, 2**63 - 1)
    total = cap(sum(d for d, _ in own))
    part = {j: cap(sum(d for d, o in own if o == j)) for j in range(len(c))}
    return sorted(((i, o, cap(d), part[o], total, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _, _), (d, o) in zip(kept, own)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(a)) for a in rng.normal(0, spread, 64)]) for i in range(n)]


def test_equals_plain_form_with_odd_rows(spark):
    rows = vectors(150, 1) + [(7, vectors(1, 9)[0][1]), (None, vectors(1, 8)[0][1]), (200, None), (201, [1.0] * 63), (202, [math.nan] + [0.0] * 63), (203, [math.inf] * 64), (204, [None] + [0.0] * 63), (205, []), (206, [0.0] * 64), (206, [0.0] * 64)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, cluster int").repartition(7)
    assert got(C.centroid_clusters(df)) == slow(rows)
    assert got(C.centroid_clusters(df.limit(0))) == []
    few = rows[:5]
    assert got(C.centroid_clusters(df.where("vec_id < 5"))) == slow(few)


def test_large_components_fall_back_to_integers(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * scale for _ in range(64)]) for i, scale in enumerate([1.0] * 40 + [2e4] * 20 + [3e5] * 20 + [2e6] * 10 + [1e30, 1e30, 1e300, 1e307])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(C.centroid_clusters(df, k=12)) == slow(rows, k=12)


def test_ties_go_to_the_smaller_number():
    v = C.whole(np.zeros((3, 64)))
    best, dist = C.nearest(v, [[5] * 64, [-5] * 64, [5] * 64])
    assert best.tolist() == [0, 0, 0] and dist.tolist() == [1600] * 3
    edge = C.SMALL
    best, dist = C.nearest(np.full((1, 64), float(edge)), [[-edge] * 64, [edge + 2] * 64, [edge - 1] + [edge] * 63])
    assert best.tolist() == [2] and dist.tolist() == [1]
    best, dist = C.nearest(np.full((1, 64), float(edge)), [[-edge] * 64, [edge + 1] * 64])
    assert best.tolist() == [1] and dist.tolist() == [64]


def test_query_equals_duckdb(spark, tmp_path):
    rows = vectors(300, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "e.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet/*.parquet'")
    cur = con.execute(C.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall(), key=repr) == sorted((tuple(r) for r in C.centroid_clusters(df).select(*names).collect()), key=repr)
