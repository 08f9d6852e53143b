"""Readers: Parquet, JSON Lines, delimited text, XML pairs, directories, archives, logs; and dataset checks."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W


def scan_parquet_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of Parquet files; one that no file has is null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def scan_parquet_hive_partitions(spark: SparkSession, path: str, courts: list[str], years: list[int]) -> DataFrame:
    """Files under year=/court=/ folders; the predicates on them prune folders before anything is read."""
    return spark.read.parquet(path).where(F.col("court").isin(*courts) & F.col("year").isin(*years))


def scan_filtered_by_key(rows: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a wanted key, the first of each."""
    hit = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return hit.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(order))).where("nth = 1").drop("nth")


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines, gzip or not; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def scan_config(spark: SparkSession, entries: dict[str, dict], columns: list[str]) -> DataFrame:
    """A small configuration (name -> fields) as a frame; values are strings."""
    rows = [(k, *(None if v.get(c) is None else str(v[c]) for c in columns)) for k, v in sorted(entries.items())]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} string" for c in columns))


def parse_simple_yaml(text: str) -> dict:
    """The part of YAML that the configurations use: nested maps by indentation, lists of scalars, plain scalars.

    A YAML library is used where there is one.
    """
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ModuleNotFoundError:
        pass
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    for raw in text.split("\n"):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and isinstance(stack[-1][1], list)):
            stack.pop()
        parent = stack[-1][1]
        if body.startswith("- "):
            parent.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        if value.strip():
            parent[_scalar(key)] = _scalar(value.strip())
        else:
            child: object = _Later(parent, _scalar(key))
            stack.append((indent, child))
    return _plain(root)


class _Later(dict):
    """A nested value that turns out to be a map or a list."""

    def __init__(self, parent, key):
        super().__init__()
        self.items_: list = []
        parent[key] = self

    def append(self, x):
        self.items_.append(x)


def _plain(x):
    if isinstance(x, _Later) and x.items_:
        return x.items_
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s in ("null", "~", ""):
        return None
    if s in ("true", "false"):
        return s == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def scan_binary_pages(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """doc_path and pages of binary documents; ``extract`` turns bytes into a list of page texts.

    Without one, files are UTF-8 texts with form feeds between pages (no PDF library is assumed).
    """
    take = extract or (lambda data: data.decode("utf-8", "replace").split("\f"))

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda c: take(bytes(c)))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_path"), pages("content").alias("pages"))


def scan_tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, content of the files in tar archives: an archive is read by one task, member by member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def scan_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id and unit of relevance files with four columns, label 1 alone."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(p, 0).alias("query_id"), F.get(p, 2).alias("unit"), F.get(p, 3).alias("label")).where("label = '1'").drop("label")


def scan_delimited_text(spark: SparkSession, path: str, mark: str = r"\|\|") -> DataFrame:
    """query_id and text of lines parted by a mark (the first one counts)."""
    p = F.split("value", mark, 2)
    return spark.read.text(path).where(F.size(p) == 2).select(F.trim(F.get(p, 0)).alias("query_id"), F.trim(F.get(p, 1)).alias("text"))


def scan_xml_pairs(spark: SparkSession, path: str, tag: str = "pair") -> DataFrame:
    """id, label, t1, t2 of XML pairs; the label as a boolean."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_id string, _label string, t1 string, t2 string").load(path)
    return df.select(F.col("_id").alias("id"), (F.upper("_label") == "Y").alias("label"), F.trim("t1").alias("t1"), F.trim("t2").alias("t2"))


def scan_directory_text(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file: doc_id is its name without the ending."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def scan_events_log(events: DataFrame, run_id, after_seq: int) -> DataFrame:
    return events.where((F.col("run_id") == run_id) & (F.col("seq") > after_seq)).orderBy("seq")


def dataset_validate(queries: DataFrame, documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """Problems of a retrieval dataset: problem, item; a missing document once for each judgment of it."""
    blank = lambda df, key, kind: df.where(F.trim(F.coalesce("text", F.lit(""))) == "").select(F.lit(f"empty {kind}").alias("problem"), F.col(key).cast("string").alias("item"))
    none = queries.join(qrels, "query_id", "left_anti").select(F.lit("no relevant documents").alias("problem"), F.col("query_id").cast("string").alias("item"))
    lost = qrels.join(documents.select(F.col("doc_id").alias("unit")), "unit", "left_anti").select(F.lit("relevant document missing").alias("problem"), F.col("unit").cast("string").alias("item"))
    return blank(queries, "query_id", "query").unionByName(blank(documents, "doc_id", "document")).unionByName(none).unionByName(lost)
