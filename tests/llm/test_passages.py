import random

import numpy as np
import pytest

from marlstone.llm import passage_chains as C


def words(rng, n, pool=4000):
    return ["w%d" % rng.randrange(pool) for _ in range(n)]


def slow_chain_score(x, y):
    f = []
    for i in range(len(x)):
        best = max([f[j] - C.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if y[j] < y[i] and x[j] < x[i]], default=0)
        f.append(C.K + max(0, best))
    return f


def test_best_chain_equals_quadratic_form(monkeypatch):
    monkeypatch.setattr(C, "MAX_GAP", 1000)  # chains whole, not parted
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 40)
        pairs = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(n)})
        x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        chains = C.chain_seeds(x, y)
        f = slow_chain_score(x.tolist(), y.tolist())
        seen = [i for c in chains for i in c]
        assert len(seen) == len(set(seen))
        top = int(np.argmax(f))
        if f[top] > C.K:
            assert any(top in c for c in chains)
        for c in chains:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()


def test_common_words():
    rng = random.Random(6)
    for _ in range(50):
        a, b = [[rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in "ab"]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert C.common_words(np.array(a), np.array(b)) == t[-1][-1]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    docs, truth = [], []
    passage = words(rng, 70)
    for d in range(60):
        docs.append([d, words(rng, rng.randint(60, 300))])
    for d in range(10, 40):  # one passage in many documents, at any place, exact or with some words changed
        p = list(passage)
        if d % 3 == 2:
            for i in rng.sample(range(70), 5):
                p[i] = "new%d" % rng.randrange(10**6)
        if d % 3 == 0:
            del p[30]
            p.insert(50, "inserted")
        at = rng.randint(0, len(docs[d][1]))
        docs[d][1][at:at] = p
        if d > 10:
            truth.append((d, at, at + 70))
    docs.append([70, docs[3][1][:]])
    truth.append((70, 0, len(docs[3][1])))
    docs += [[80, words(rng, 49)], [81, docs[-1][1][:45]]]
    return [(d, " ".join(w), 1) for d, w in docs], truth


def test_planted_passages(spark, planted):
    docs, truth = planted
    rows = docs + [(None, docs[0][1], 1), (90, None, 1), (91, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_word int").repartition(3)
    got = {}
    for r in C.repeated_passages(df).collect():
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(got) == {d for d, *_ in truth}
    for d, s, e in truth:
        assert len(got[d] & set(range(s, e))) >= 0.95 * (e - s), (d, s, e, sorted(got[d]))
        assert len(got[d] - set(range(s, e))) <= 3
    cut = {r.doc_id: r.text for r in C.cut_passages(df).collect()}
    assert cut[70] == "" and cut[10] == dict((d, t) for d, t, _ in docs)[10] and len(cut) == len({r[0] for r in rows})
    assert C.repeated_passages(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 AS cut_doc", "2 AS cut_spans")
    assert C.cut_passages(clash).columns == clash.columns and C.cut_passages(clash).where("cut_doc = 1 and cut_spans = 2").count() == len(rows)


def test_runs_of_one_word(spark):
    rows = [(1, "same " * 300), (2, "other words " * 3 + "same " * 200), (3, "quite different " + " ".join("u%d" % i for i in range(90)))]
    got = {r.doc_id: (r.start_word, r.end_word, r.source_doc_id) for r in C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2} and got[2][2] == 1 and got[2][0] <= 6 and got[2][1] == 206


def test_passage_twice_in_a_document(spark):
    rng = random.Random(8)
    p, rest = words(rng, 60), words(rng, 80)
    rows = [(1, " ".join(words(rng, 30) + p)), (2, " ".join(rest + p + p))]
    spans = [(r.start_word, r.end_word) for r in C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {i for a, b in spans for i in range(a, b)} >= set(range(81, 199))


def repeated_words(docs, n=50):
    """Brute force: the words of each text within a window of n words that a text of smaller doc_id has."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = t.split()
        own = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        out[d] = {i + j for i, x in enumerate(own) if x in seen for j in range(n)}
        seen |= set(own)
    return out


def test_composed_passages_equal_brute_force(spark):
    """Passages of which each sentence also stands alone in an earlier text of its own."""
    rng = random.Random(9)
    singles, later = [], []
    for k in range(40):
        parts = [words(rng, n) for n in ((30, 30), (25, 25, 25), (20, 31, 15))[k % 3]]
        singles += [words(rng, 40) + x + words(rng, 40) for x in parts]
        later += [words(rng, 30) + sum(parts, []) + words(rng, 30) for _ in range(3)]
    docs = [(i, " ".join(w)) for i, w in enumerate(singles + later)]
    got = {}
    for r in C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for d, want in repeated_words(docs).items():
        assert want <= got.get(d, set()), d
        assert len(got.get(d, set()) - want) <= 3


def test_spans():
    assert C.without_spans("a b\nc d", [(1, 3)]) == "a d" and C.without_spans(" a b ", [(0, 9)]) == " " and C.without_spans("a b c d", [(0, 2), (1, 3)]) == "d"
