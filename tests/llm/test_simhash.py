import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash_trie as S


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    n = len(fps)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [find(i) for i in range(n)]


def test_fingerprint_matches_slow_form_and_spark_hash(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É a b A B c a b c\td\x0be", "x " * 5000]
    for t in texts:
        assert S.shingle_fingerprint(t) == slow_fingerprint(t)
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == S.shingle_fingerprint("a b c")


@pytest.mark.parametrize("hot", [8, 2048])
def test_links_equal_brute_force(spark, monkeypatch, hot):
    rng = random.Random(hot)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ (rng.getrandbits(12) << 30) for _ in range(80)}
    fps = sorted(fps)
    rng.shuffle(fps)
    monkeypatch.setattr(S, "HOT_LEAVES", hot)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    links = S.near_links(spark.createDataFrame(rows, "doc long, fp long").repartition(3))
    from marlstone.llm.common import connected_components

    got = dict(connected_components(links).collect())
    assert [got.get(i, i) for i in range(len(fps))] == slow_components(fps)


def test_components_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(5, base, "x"), (3, base, "y"), (9, base + " extra", "z"), (4, None, "n"), (2, "", "n"), (7, "quite other words here", None), (None, base, "q"), (7, "quite other words here", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in S.simhash_components(df).collect() if r.doc_id is not None)
    assert [g for g in got if g[0] != 9] == [(2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (7, 7)]
    assert S.simhash_components(df.limit(0)).count() == 0
    kept = S.keep_one_per_class(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {2, 3, 7, None}


@pytest.mark.parametrize("most", [0, 7, 1 << 18])
def test_components_by_tasks_and_by_rounds(spark, monkeypatch, most):
    import random

    from marlstone.llm import common as C

    monkeypatch.setattr(C, "LOCAL_EDGES", most)
    rng = random.Random(most)
    path = rng.sample(range(1000, 1300), 300)
    edges = list(zip(path, path[1:])) + [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] * 2 + [(-5, 5), (9, 9), (None, 3)]
    want = {n: n for e in edges for n in e if e[0] != e[1] and None not in e}
    for _ in want:
        before = dict(want)
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    steps, write = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, label: steps.append(label) or write(df, label))
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    rows = C.connected_components(df).collect()
    assert len(rows) == len(want) and dict(rows) == want
    if most > 1000:  # few edges take no rounds of shuffles
        assert len(steps) == 2
    assert C.connected_components(df.limit(0)).count() == 0
