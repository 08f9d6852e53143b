"""Hand-computed cases of fusion, metrics, lexical parsing and statistics."""

import math

import pytest

from marlstone.operators import evaluate as V, fusion as U, lexical as L, windows as N


def lists(spark, **named):
    rows = [(1, n, x, i) for n, xs in named.items() for i, x in enumerate(xs, 1)]
    return spark.createDataFrame(rows, "query_id int, list_name string, chunk_id string, rank int")


def order(df):
    return [r.chunk_id for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_rrf(spark):
    got = U.rrf(lists(spark, a=["x", "y", "z"], b=["y", "w"]))
    assert order(got) == ["y", "x", "w", "z"]
    assert abs({r.chunk_id: r.score for r in got.collect()}["y"] - (1 / 62 + 1 / 61)) < 1e-8
    assert order(U.rrf(lists(spark, a=["p", "r", "q"], b=["q", "s", "p"], c=["x", "s"]))) == ["p", "q", "s", "x", "r"]
    with pytest.raises(ValueError):
        U.rrf(lists(spark, a=["x"]), k=-1)


def test_retrieval_metrics(spark):
    run = spark.createDataFrame([(1, f"u{i}", i) for i in range(1, 66)], "query_id int, unit string, rank int")
    rel = spark.createDataFrame([(1, "u2"), (1, "u4"), (1, "u65")], "query_id int, unit string")
    r = V.retrieval_metrics(run, rel).first()
    assert (r.recall_10, r.precision_10, r.mrr) == (round(2 / 3, 6), 0.2, 0.5)
    assert abs(r.ndcg_10 - (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / 2)) < 1e-5


def test_query_parsing():
    assert L.quote_references("breach of s. 74 and Section 16(2)") == 'breach of "s. 74" and "Section 16(2)"'
    assert L.parse_query('damages or "liquidated sum" -penalty -- u/s 74') == {"terms": ["damages", '"liquidated sum"', '"u/s 74"'], "excluded": ["penalty"]}


def test_stems():
    for word, stem in {"contracts": "contract", "agreed": "agre", "damages": "damag", "penalties": "penalti", "relational": "relat", "hopping": "hop", "flies": "fli", "happy": "happi", "generously": "generous", "consigned": "consign", "national": "nation", "sky": "sky", "dying": "die"}.items():
        assert L.stem(word) == stem, word


def test_budget_prefix(spark):
    t = spark.createDataFrame([(1, "a", 60), (1, "b", 10), (1, "c", 50)], "query_id int, term string, df int")
    terms = lambda n: sorted(r.term for r in N.budget_prefix(t, n).collect())
    assert terms(100) == ["b", "c"] and terms(1000) == ["a", "b", "c"] and terms(5) == []


def test_pack_skips(spark):
    rows = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 1, 80), (1, 3, 2, 40)], "doc int, p int, at int, n int")
    assert [r["at"] for r in sorted(N.passage_pack(rows, "doc", "p", "n", "at", 100).collect(), key=lambda r: r.nth)] == [0, 2]


def test_statistics(spark):
    v = spark.createDataFrame([("g", i, 0.5) for i in range(9)], "grp string, item int, value double")
    b = V.bootstrap_ci(v, "grp", 200).first()
    assert (b["mean"], b.low, b.high) == (0.5, 0.5, 0.5)
    d = spark.createDataFrame([("g", i, 1.0) for i in range(5)], "grp string, item int, difference double")
    assert V.sign_flip_p(d, "grp").first().p_value == 2 / 32
    pair = lambda rows: spark.createDataFrame(rows, "gold int, predicted int")
    assert V.cohens_kappa(pair([(1, 1), (0, 0)])).first().kappa == 1.0
    assert V.cohens_kappa(pair([(1, 1), (1, 0), (0, 1), (0, 0)])).first().kappa == 0.0
    assert V.cohens_kappa(pair([(1, 0), (0, 1)])).first().kappa == -1.0
    assert V.cohens_kappa(pair([])).first().kappa == 0.0
    p = V.precision_recall_f1(pair([(1, 1), (1, 0), (0, 1), (0, 0)]), 1).first()
    assert (p.precision, p.recall, p.f1) == (0.5, 0.5, 0.5)


def test_phrase_and_all(spark):
    ch = spark.createDataFrame([(1, "time is of the essence"), (2, "essence of time"), (3, "the essence")], "chunk_id long, text string")
    from pyspark.sql import functions as F

    words = ch.select("chunk_id", F.posexplode(L.words_of(F.col("text"))).alias("pos", "word"))
    q = spark.createDataFrame([(1, "the", 0), (1, "essence", 1)], "query_id int, word string, nth int")
    assert sorted(r.chunk_id for r in L.search_phrase(words, q, 9).collect()) == [1, 3]
    post = L.postings(ch)
    t = spark.createDataFrame([(1, "time"), (1, "essence")], "query_id int, lexeme string")
    assert sorted(r.chunk_id for r in L.search_all(post, t, 9).collect()) == [1, 2]


def test_tsvector_moves_only_chunks_whose_id_comes_again(spark):
    rows = [(1, "the Cats cat, running", "h One"), (2, "cat", None), (2, "dog cat", "h"), (None, "x x", "y"), (None, "x", None), (3, None, "z"), (4, "the of", "the")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, header string")
    got = sorted(((r.chunk_id or 0, r.lexeme, r.weight, r.positions) for r in L.tsvector(df, stemmed=False).collect()))
    want = [(0, "x", "A", [1, 1, 2]), (0, "y", "B", [1]), (1, "cat", "A", [3]), (1, "cats", "A", [2]), (1, "h", "B", [1]), (1, "one", "B", [2]), (1, "running", "A", [4])]
    assert got == want + [(2, "cat", "A", [1, 2]), (2, "dog", "A", [1]), (2, "h", "B", [1]), (3, "z", "B", [1])]
    stems = {(r.lexeme, r.weight): r.positions for r in L.tsvector(df.where("chunk_id = 1")).collect()}
    assert stems["cat", "A"] == [2, 3] and stems["run", "A"] == [4]
    assert "hashpartitioning" not in L.tsvector(df.where("chunk_id in (1, 3)"))._jdf.queryExecution().executedPlan().toString()
