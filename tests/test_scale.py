"""Operators whose work must not grow faster than their input: results against plain Python, and what a plan joins on."""

import random

import numpy as np
import pytest

from marlstone.operators import dense as D, joins as J


@pytest.mark.parametrize("widest", [[5], [5, 300, 10**6, 2**62]])
def test_range_join_meets_bins_of_pages(spark, widest):
    rng = random.Random(3)
    cits = [(i, rng.randint(0, 1), rng.randint(0, 1), rng.choice([rng.randint(-100, 3000), 64, 63, 128])) for i in range(300)] + [(900, None, 0, 5), (901, 0, 0, None)]
    reps = [(i, rng.randint(0, 1), rng.randint(0, 1), a := rng.randint(-100, 3000), a + rng.randint(-2, rng.choice(widest))) for i in range(200)] + [(900, 0, 0, None, 9), (901, 1, 1, 64, 127)]
    c = spark.createDataFrame(cits, "cit long, year long, volume long, page long")
    r = spark.createDataFrame(reps, "doc_id long, year long, volume long, first_page long, last_page long")
    out = J.range_join_page(c, r)
    want = sorted((*x, d) for x in cits for d, y, v, a, b in reps if (x[1], x[2]) == (y, v) and None not in (x[3], a) and a <= x[3] <= b)
    assert out.columns == [*c.columns, "doc_id"] and sorted(map(tuple, out.collect())) == want and want
    assert "bin" in out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert J.range_join_page(c, r.limit(0)).count() == 0


def test_lists_are_searched_by_products(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).round(1)
    x[10:40] = x[5]
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>").repartition(5)
    q = v.where("chunk_id % 20 = 5").selectExpr("chunk_id AS query_id", "embedding")
    centres = D.ivf_build(v, 6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(x @ centres.T), axis=1)
    for probes, block in ((2, 4096), (6, 7)):
        out = D.ann_search(v, q, 10, centres, probes, block)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
        for i in range(5, 700, 20):
            near = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(700) if order[j, 0] in order[i, :probes])[:10]
            assert [got[i][n + 1] for n in range(len(near))] == [(j, -s) for s, j in near]
    exact = D.cosine_exact(v, q, 4, exclude_self=True).collect()
    assert all(r.query_id != r.chunk_id for r in exact) and len(exact) == 35 * 4


def test_plain_lines_are_cleaned_whole(monkeypatch):
    from marlstone.operators import structure as T

    pages = ["HEAD 1\nA “quoted” line of words.\nno change here\n\n1", "HEAD 2\nof­fice and off ice\n2"]
    mended, plain = [], T.mend_line
    monkeypatch.setattr(T, "mend_line", lambda line, *x: mended.append(line) or plain(line, *x))
    out = T.clean_pages(pages, "hc")
    assert "no change here" not in mended and any(" " in x for x in mended)
    raw = "\f".join(pages)
    for r in out["runs"]:
        a, b = out["text"][r["clean_start"] : r["clean_start"] + r["len"]], raw[r["raw_start"] : r["raw_start"] + r["len"]]
        assert all(x == y or y in "“” \n\f" for x, y in zip(a, b, strict=True))


def test_texts_are_parsed_for_citations_once(spark):
    from marlstone.operators import citation_graph as G

    docs = spark.createDataFrame([("a", "See [1963] 1 SCR 5 : AIR 1963 SC 7."), ("b", "none"), ("c", None)], "doc_id string, text string")
    found = G.mentions(docs)
    assert [r.doc_id for r in found.collect()] == ["a", "a"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("find_citations(") == 1


def test_index_takes_texts_in_small_batches(spark, tmp_path, monkeypatch):
    from marlstone.operators import inverted_index as I

    seen, small = [], I.text_batches
    monkeypatch.setattr(I, "text_batches", lambda df: seen.append(1) or small(df))
    before = spark.conf.get(I._ROWS)
    I.build_index(spark.createDataFrame([(1, "a b"), (2, "b")], "chunk_id long, text string"), str(tmp_path / "i"))
    assert seen and spark.conf.get(I._ROWS) == before
