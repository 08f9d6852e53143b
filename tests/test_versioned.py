import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.sources.versioned import VersionConflict, VersionedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stamps(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["doc", "part"], ["doc"], buckets=16)
    t.upsert(spark.range(400).select((F.col("id") % 100).alias("doc"), (F.col("id") / 100).cast("int").alias("part"), F.lit("old").alias("text")))
    return t


def test_upsert_writes_touched_buckets_alone(spark, table):
    before = stamps(table.path)
    new = spark.createDataFrame([(7, 1, "new"), (7, 9, "added")], "doc long, part int, text string")
    assert table.upsert(new) == 2
    after = stamps(table.path)
    assert before.items() <= after.items()
    added = {Path(p).parent.name for p in after.keys() - before.keys()}
    assert len(added) == 1
    got = rows(table.read())
    assert len(got) == 401 and (7, 1, "new") in got and (7, 9, "added") in got and (7, 0, "old") in got
    assert len(rows(table.read(1))) == 400 and (7, 1, "old") in rows(table.read(1))
    assert table.manifest()["folders"].values() != table.manifest(1)["folders"].values()


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, table, monkeypatch):
    want = rows(table.read())

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_swap", die)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(7, 1, "lost")], "doc long, part int, text string"))
    again = VersionedTable(spark, table.path, table.keys, table.bucket_by)
    assert again.versions() == [1] and rows(again.read()) == want
    assert again.upsert(spark.createDataFrame([(8, 1, "kept")], "doc long, part int, text string")) == 2
    assert (8, 1, "kept") in rows(again.read()) and not any(r[2] == "lost" for r in rows(again.read()))


def test_two_writers_conflict(spark, table, monkeypatch):
    base = table.manifest()
    monkeypatch.setattr(table, "manifest", lambda v=None: base)
    other = VersionedTable(spark, table.path, table.keys, table.bucket_by)
    other.upsert(spark.createDataFrame([(1, 1, "first")], "doc long, part int, text string"))
    folders = set(os.listdir(f"{table.path}/data"))
    with pytest.raises(VersionConflict):
        table.upsert(spark.createDataFrame([(2, 1, "second")], "doc long, part int, text string"))
    assert set(os.listdir(f"{table.path}/data")) == folders
    assert (1, 1, "first") in rows(other.read()) and (2, 1, "old") in rows(other.read())


def test_stale_rows_and_replaced_documents(spark, table):
    keep = spark.createDataFrame([(3, 0, "x"), (4, 2, "x")], "doc long, part int, text string")
    table.delete_stale(keep, "doc")
    got = rows(table.read())
    assert len(got) == 400 - 6 and [r for r in got if r[0] in (3, 4)] == [(3, 0, "old"), (4, 2, "old")]
    table.replace_documents(spark.createDataFrame([(3, 5, "y")], "doc long, part int, text string"), "doc")
    assert [r for r in rows(table.read()) if r[0] == 3] == [(3, 5, "y")]
    with pytest.raises(ValueError):
        VersionedTable(spark, table.path, table.keys, ["part"]).delete_stale(keep, "doc")


def test_a_bucket_may_run_empty_and_old_versions_go(spark, table):
    one = VersionedTable(spark, table.path + "2", ["k"], buckets=8)
    one.upsert(spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    assert one.upsert(spark.createDataFrame([], "k long, v int")) == 1
    for v in (5, 6, 7):
        one.upsert(spark.createDataFrame([(0, v)], "k long, v int"))
    assert one.versions() == [1, 2, 3, 4] and rows(one.read()) == [(0, 7), (1, 1), (2, 1)]
    assert one.vacuum(1) >= 1 and one.versions() == [4] and rows(one.read()) == [(0, 7), (1, 1), (2, 1)]
    empty = VersionedTable(spark, table.path + "3", ["k"])
    empty.upsert(spark.createDataFrame([], "k long, v int"))
    assert rows(empty.read()) == []
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, table.path + "4", ["k"]).read()
