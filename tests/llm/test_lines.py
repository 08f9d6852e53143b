import random

import duckdb
import pytest

from marlstone.llm import line_suffix as L


def brute(docs, m=2):
    """Delete every line of a window of m lines that stands earlier, and later copies of lines that are long or alone."""
    seqs = {}
    for d, t in docs:
        seqs[d] = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    seen, gone = set(), set()
    for d in sorted(seqs):
        s = seqs[d]
        for p in range(len(s) - m + 1):
            w = tuple(x for _, x in s[p : p + m])
            if w in seen:
                gone |= {(d, i) for i, _ in s[p : p + m]}
            seen.add(w)
    known = set()
    for d in sorted(seqs):
        for i, x in seqs[d]:
            if x in known and (len(x.split()) >= 50 or len(seqs[d]) == 1):
                gone.add((d, i))
            known.add(x)
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone), sum(1 for g in gone if g[0] == d)) for d, t in docs}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [2, 3, 5])
def test_equal_brute_force_and_sql(spark, seed, least):
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "d e", "", " "]) if seed == 1 else "l%d" % rng.randint(0, 40) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    docs += [(100 + i, "\n".join("run %d" % k for k in range(37))) for i in range(6)] + [(200, "z\nrun 3\nrun 4\nrun 5\ny"), (201, "x\n" * 9), (202, "a"), (203, "only")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.lines_deleted) for r in L.dedup_lines(df, min_lines=least).collect()}
    assert got == brute(docs, least)
    assert (got == brute(docs)) == (least == 2)
    if least > 2:
        return
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: (r[1], r[3]) for r in con.execute(L.ORACLE_SQL).fetchall()} == got


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a\nb", 5), (3, "a\nb", 5), (4, "a\nb", 5), (4, "a\nb", 5), (4, "a\nb\nc", 5), (5, "a\n\n \nb", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "lines_total", "lines_deleted"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, None), (2, ""), (None, "a\nb"), (3, "a\nb"), (4, ""), (4, ""), (4, "c"), (5, "\n ")], key=repr)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_long_and_only_lines(spark):
    """Repeated single lines go where they are long or a whole text, in the pipeline's stage; short ones among others stay."""
    import corpus_pipeline

    long, less = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    texts = {1: f"a\n{long}\nb", 2: f"c\n{long}\nd", 3: less, 4: less, 5: f"e\n{less}\nf", 6: "a", 7: f"a\ng\n \t{long}", 8: f"{long}\n\nh\n{long}", 9: "only\n", 10: "\n only", 11: "only"}
    rows = [(d, t, len(t)) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    want = dict(texts) | {2: "c\nd", 4: "", 6: "", 8: "\nh", 11: ""}
    assert {r.doc_id: r.text for r in L.dedup_lines(df, 50).collect()} == want
    assert {r.doc_id: r.text for r in L.dedup_lines(df, None).collect()} == texts
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()} == {d: t for d, t in want.items() if t.strip()}
    assert L.dedup_lines(df.limit(0), 50).count() == 0


def test_runs_are_maximal(spark):
    run = lambda a, b: "\n".join(f"run {k}" for k in range(a, b))
    docs = [(1, f"p\n{run(0, 37)}\nq"), (2, f"r\ns\n{run(3, 30)}\nt"), (3, f"{run(20, 25)}\nu\n{run(5, 8)}"), (4, run(20, 25))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lambda m: sorted((r.doc, r.start, r.end, r.source_doc, r.source_start) for r in L.repeated_runs(df, None, m)[1].collect())
    assert got(3) == [(2, 2, 29, 1, 4), (3, 0, 5, 1, 21), (3, 6, 9, 1, 6), (4, 0, 5, 1, 21)]
    assert got(4) == [(2, 2, 29, 1, 4), (3, 0, 5, 1, 21), (4, 0, 5, 1, 21)]


def test_clashing_columns(spark):
    names = ["cut_lines", "cut_doc", "gone", "doc", "copy", "deleted", "lines_total", "pos"]
    df = spark.createDataFrame([(1, "a\nb") + tuple(range(8)), (2, "a\nb\nc") + tuple(range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", *[n for n in names if n != "lines_total"], "lines_total", "lines_deleted"]
    assert sorted((r.doc_id, r.text, r.gone, r.lines_total, r.lines_deleted) for r in got.collect()) == [(1, "a\nb", 2, 2, 0), (2, "c", 2, 3, 2)]
