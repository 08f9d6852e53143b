import random

import numpy as np

from marlstone.llm import weak_labels as L


def test_votes_and_shapes():
    assert L.votes(None) == L.votes("") == L.votes(" \n") == 1
    assert L.shape("Hello,") == "Aa," and L.shape("THE!!") == "A!!" and L.shape("x12|") == "a0|"
    junk = L.votes("ab | cd | " * 40)
    assert junk % 3 == 1


def test_em_equals_row_by_row_form():
    rng = np.random.default_rng(1)
    m = len(L.LABELLERS)
    truth = rng.random(4000) < 0.8
    v = np.where(rng.random((4000, m)) < 0.3, 0, np.where(rng.random((4000, m)) < 0.9, 1 + truth[:, None], 2 - truth[:, None]))
    codes = (v * 3 ** np.arange(m)).sum(1)
    patterns, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    theta, good, post = L.fit_labellers(patterns, counts.astype(float), steps=30)
    p = np.where((v == 1).any(1), 0.1, np.where((v == 2).any(1), 0.9, 0.5))
    for _ in range(30):
        t = np.ones((m, 2, 3))
        for i in range(m):
            for k in (1, 2):
                t[i, 0, k] = (1 - p)[v[:, i] == k].sum() + 1
                t[i, 1, k] = p[v[:, i] == k].sum() + 1
            t[i, :, 1:] /= t[i, :, 1:].sum(1, keepdims=True)
        g = (p.sum() + 1) / (len(p) + 2)
        log = [np.log(q) + sum(np.log(t[i, c, v[:, i]]) for i in range(m)) for c, q in ((0, 1 - g), (1, g))]
        p = 1 / (1 + np.exp(log[0] - log[1]))
    assert np.allclose(post[inverse], p, atol=1e-6) and abs(good - g) < 1e-6 and ((p >= 0.5) == truth).mean() > 0.95


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = L.classify(docs)
    assert got.count() == docs.count()
    r = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(x.kept == (x.quality == 1) for x in r) / len(r) > 0.95
    good = [x.kept for x in r if x.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_edges(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(500) for _ in range(60)) + ".", 1) for i in range(40)]
    rows += [(100 + i, "bad | word | " * 30, 1) for i in range(10)] + [(200, None, 1), (201, "", 1), (None, "a b.", 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = L.classify(df).collect()
    assert len(got) == len(rows) and all(not r.kept for r in got if r.doc_id in range(100, 110)) and all(r.kept for r in got if r.doc_id in range(40))
    assert L.classify(df.limit(0)).count() == 0


def test_votes_read_whole_texts():
    from marlstone.llm import weak_labels as M

    capitals = lambda text: M.votes(text) // 81 % 3
    for n in (60, 20_000):
        assert capitals("aBaBa " * n) == 0 and capitals("ABAB " * n) == 1 and capitals("aaaa " * n) == 2
    assert M.letters_of("aB1 É\U00010400\ud800") == (4, 3)
    assert M.shape("x" * 5 + "-" * 40) == "a" + "-" * 40
    assert M.votes("word " * 100_000) // 3**5 % 3 == 1
