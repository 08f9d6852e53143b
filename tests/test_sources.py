"""Sources and sinks over files made here."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense as D, filters as P, joins as J
from marlstone.sources import readers as R, sinks as S


def test_parquet_partitions_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2001, "a", "x"), (2, 2002, "b", "y"), (3, 2002, "a", "z")], "id long, year int, court string, v string")
    df.write.partitionBy("year", "court").parquet(str(tmp_path / "p"))
    got = R.scan_parquet_hive_partitions(spark, str(tmp_path / "p"), ["a"], [2002])
    assert [r.id for r in got.collect()] == [3] and "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    assert R.scan_parquet_projected(spark, str(tmp_path / "p"), ["id", "nope"]).where("nope is null").count() == 3


def test_text_formats(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in R.scan_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a long, b string").where("a is not null").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "qrels.txt").write_text("q1 Q0 d1 1\nq1 Q0 d2 0\n\nq2 Q0 d3 1\n")
    assert sorted(map(tuple, R.scan_qrels(spark, str(tmp_path / "qrels.txt")).collect())) == [("q1", "d1"), ("q2", "d3")]
    (tmp_path / "q.txt").write_text("q1||a || b\nbroken\n")
    assert list(map(tuple, R.scan_delimited_text(spark, str(tmp_path / "q.txt")).collect())) == [("q1", "a || b")]
    (tmp_path / "p.xml").write_text('<dataset><pair id="H1" label="Y"><t1>prem</t1><t2> hyp </t2></pair><pair id="H2" label="N"><t1>a</t1><t2>b</t2></pair></dataset>')
    assert sorted(map(tuple, R.scan_xml_pairs(spark, str(tmp_path / "p.xml")).collect())) == [("H1", True, "prem", "hyp"), ("H2", False, "a", "b")]
    d = tmp_path / "dir"
    d.mkdir()
    (d / "C1.txt").write_text("one\ntwo")
    assert list(map(tuple, R.scan_directory_text(spark, str(d)).collect())) == [("C1", "one\ntwo")]
    (d / "C1.txt").write_bytes(b"page one\fpage two")
    assert R.scan_binary_pages(spark, str(d)).first().pages == ["page one", "page two"]


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name, data in (("a.pdf", b"A"), ("b.txt", b"B")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = R.scan_tar_members(spark, str(tmp_path / "x.tar"), ".pdf").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("a.pdf", b"A")]


def test_config(spark):
    y = R.parse_simple_yaml("acts:\n  ica:\n    title: Contract Act  # t\n    year: 1872\n    aliases:\n      - ICA\n      - 'Contract Act'\n    on: true\nempty: null\nlist: [1, 2]\n")
    assert y["acts"]["ica"]["year"] == 1872 and y["acts"]["ica"]["aliases"] == ["ICA", "Contract Act"] and y["list"] == [1, 2] and y["empty"] is None
    assert R.scan_config(spark, y["acts"], ["title", "year"]).first().year == "1872"


def test_dataset_validate(spark):
    q = spark.createDataFrame([("q1", "x"), ("q2", " ")], "query_id string, text string")
    d = spark.createDataFrame([("d1", None)], "doc_id string, text string")
    r = spark.createDataFrame([("q1", "d9")], "query_id string, unit string")
    assert sorted(map(tuple, R.dataset_validate(q, d, r).collect())) == [("empty document", "d1"), ("empty query", "q2"), ("no relevant documents", "q2"), ("relevant document missing", "d9")]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    S.load_table(spark, p, df, ["id"])
    S.load_table(spark, p, df, ["id"])
    assert sorted(map(tuple, S.load_table(spark, p, df.where("id = 2").withColumn("v", F.lit("c")), ["id"]).collect())) == [(1, "a"), (2, "c")]
    counts = S.load_all(spark, str(tmp_path / "all"), {"x": (df, ["id"]), "y": (df.limit(1), ["id"])})
    assert sorted(map(tuple, counts.collect())) == [("x", 2), ("y", 1)]
    m = S.build_manifest(df.select(F.col("id").alias("doc_id"), F.col("v").alias("sha256")), "s")
    assert m.first() == S.build_manifest(df.repartition(3).select(F.col("id").alias("doc_id"), F.col("v").alias("sha256")), "s").first()
    S.write_manifest(m, str(tmp_path / "m"))
    S.write_manifest(m.withColumn("documents", F.lit(9)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().documents == 2
    S.atomic_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    c = str(tmp_path / "c")
    S.results_csv_upsert(spark, c, df.select(F.col("v").alias("experiment"), "id"))
    assert sorted(map(tuple, S.results_csv_upsert(spark, c, spark.createDataFrame([("a", 7)], "experiment string, id long")).collect())) == [("a", "7"), ("b", "2")]
    assert json.loads(S.jsonl_split_export(df, F.col("id") == 2, "id").first().line) == {"id": 2, "v": "b"}


def test_append_event(spark):
    log = spark.createDataFrame([("r", "c", 1, 1, "case_created")], "run_id string, case_id string, arrival long, seq long, type string")
    new = spark.createDataFrame([("r", "c", 2, 3, "x"), ("r", "c", 3, 3, "x"), ("s", "c", 1, 1, "x")], log.schema)
    ok, bad = S.append_event(log, new, "case_created")
    assert sorted((r.run_id, r.arrival) for r in ok.collect()) == [("r", 1), ("r", 2)] and sorted((r.run_id, r.problem) for r in bad.collect()) == [("r", "sequence not rising"), ("s", "first event of another type")]


def test_filters_and_offsets(spark):
    with pytest.raises(ValueError):
        P.SearchFilters(date_from="2020-01-02", date_to="2020-01-01")
    docs = spark.createDataFrame([("J1", "judgment", "A", None), ("J2", "judgment", "B", "2001-02-03"), ("ACT", "statute", None, None)], "doc_id string, kind string, court string, decision_date string").withColumn("decision_date", F.col("decision_date").cast("date"))
    ids = lambda f, e=None: sorted(r.doc_id for r in P.search_filters(docs, f, e).collect())
    assert ids(P.SearchFilters()) == ["ACT", "J1", "J2"] and ids(P.SearchFilters(date_from="2000-01-01")) == ["ACT", "J2"] and ids(P.SearchFilters(kinds=("judgment",), courts=("A",))) == ["J1"]
    e = spark.createDataFrame([("J1", "ACT")], "source_doc_id string, target_doc_id string")
    assert ids(P.SearchFilters(acts=("ACT",)), e) == ["ACT", "J1"]
    runs = spark.createDataFrame([("d", 0, 5, 3), ("d", 3, 20, 2)], "doc_id string, clean_start long, raw_start long, len long")
    at = lambda *o: spark.createDataFrame([("d", x) for x in o], "doc_id string, offset long")
    assert sorted((r.offset, r.raw_offset) for r in J.offset_map_back(at(0, 2, 3, 4), runs).collect()) == [(0, 5), (2, 7), (3, 20), (4, 21)]
    with pytest.raises(Exception):
        J.offset_map_back(at(9), runs).collect()
    assert J.offset_map_back(at(9), runs, strict=False).first().raw_offset is None


def test_dense_index(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (8, 16))
    x = np.vstack([c + rng.normal(0, 0.1, (40, 16)) for c in centres])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")
    q = v.where("chunk_id % 29 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = D.cosine_exact(v, q, 10)
    found = D.ann_search(v, q, 10, D.ivf_build(v, 8), 3)
    assert D.recall_at_k(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    with pytest.raises(Exception):
        D.dimension_check(v, 15).collect()
    with pytest.raises(ValueError):
        D.register_model(spark.createDataFrame([("m", 3)], "model string, dim long"), "m", 4)
    assert D.path_choice(10) == "exact" and D.path_choice(9999) == "ann"
    assert D.cosine_exact(v, q.limit(0), 10).count() == 0
    in_blocks = D.cosine_exact(v, q, 10, block=3)
    assert sorted(map(tuple, in_blocks.collect())) == sorted(map(tuple, D.cosine_exact(v, q, 10).collect()))
