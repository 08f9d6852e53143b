"""Sinks: upserts, stale-row deletion, manifests, resumable fills, counts and exports over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target with ``rows`` in place of those of the same keys; the columns of the target (``VersionedTable`` applies it to touched buckets)."""
    return target.join(rows.select(*keys), keys, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def delete_stale(target: DataFrame, produced: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """The target without rows of touched documents that are no longer produced."""
    touched = produced.select(doc).distinct()
    kept = target.join(touched, doc, "left_anti")
    return kept.unionByName(target.join(produced.select(*keys).distinct(), keys, "left_semi").select(target.columns))


def load_table(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert into a versioned table, which rewrites only the buckets that ``rows`` touch and swaps the new version in last."""
    from .versioned import VersionedTable

    table = VersionedTable(spark, path, keys)
    table.upsert(rows)
    return table.read()


def load_all(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Load tables in order and count them."""
    return row_counts({name: load_table(spark, f"{root}/{name}", df, keys) for name, (df, keys) in tables.items()})


def document_rows(manifest: DataFrame, parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """Manifest documents with their parse and metadata summaries; the title falls back to the parse's, then the ID."""
    j = manifest.join(parsed, "doc_id", "left").join(metadata, "doc_id", "left")
    return j.withColumn("title", F.coalesce("meta_title", "parsed_title", F.col("doc_id").cast("string")))


def append_event(log: DataFrame, new: DataFrame, first_type: str) -> tuple[DataFrame, DataFrame]:
    """The log with those new events that are in order, and the ones refused."""
    from ..operators.events import order_check

    both = log.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    bad = order_check(both, first_type).join(new.select("run_id", "arrival"), ["run_id", "arrival"], "left_semi")
    return both.join(bad.select("run_id", "arrival"), ["run_id", "arrival"], "left_anti").drop("batch"), bad


def embed_missing(chunks: DataFrame, embeddings: DataFrame, model: str, encoder) -> DataFrame:
    """New rows (chunk_id, model, embedding) for the chunks without a vector of the model: a restart does the rest."""
    from ..operators.dense import encode
    from ..operators.joins import missing_embeddings

    todo = missing_embeddings(chunks, embeddings, model)
    return encode(todo, encoder).select("chunk_id", F.lit(model).alias("model"), "embedding")


def build_manifest(entries: DataFrame, name: str) -> DataFrame:
    """snapshot_id (name and the first 10 hex digits of SHA-256 over the sorted doc_id:sha256 lines) and counts.

    The digest needs all lines in one order, so one row holds them: hashes of a buckets' lines are joined first, to keep
    it small (256 buckets by the hash of doc_id).
    """
    line = F.concat_ws(":", "doc_id", "sha256")
    buckets = entries.groupBy(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(256)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    whole = buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s.h), "\n"), 256).alias("h"), F.sum("n").alias("documents"))
    return whole.select(F.concat(F.lit(f"{name}-"), F.substring("h", 1, 10)).alias("snapshot_id"), "documents")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Keep-first: a manifest that is there stays."""
    manifest.write.mode("ignore").parquet(path)


def atomic_json(df: DataFrame, path: str) -> None:
    """JSON by the commit protocol: readers see all of it or none."""
    df.coalesce(1).write.mode("overwrite").json(path)


def results_csv_upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "experiment") -> DataFrame:
    """The results table as CSV with an experiment's rows replaced."""
    from ..operators.evaluate import results_upsert

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    if fs.exists(hadoop(path)):
        text = results_upsert(spark.read.option("header", True).csv(path), text, key)
    new = f"{path}.new"
    text.coalesce(1).write.mode("overwrite").option("header", True).csv(new)
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(new), hadoop(path))
    return spark.read.option("header", True).csv(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        x = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = x if out is None else out.unionByName(x)
    return out


def jsonl_split_export(items: DataFrame, split: Column, key: str) -> DataFrame:
    """JSON lines of the items of a split, in order of their IDs."""
    cols = sorted(c for c in items.columns)
    return items.where(split).orderBy(key).select(F.to_json(F.struct(*cols)).alias("line"))
