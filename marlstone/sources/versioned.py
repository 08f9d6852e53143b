"""A Parquet table in key buckets whose versions share what they have in common: a change writes the touched buckets alone.

Under the table's folder, ``data/<version>-<id>/bucket=<b>`` holds the rows of a bucket as some version wrote them, and ``versions/<n>.json``
names, for version n, the folder of each bucket. A version is there once its file is: that is written beside and renamed last,
so a writer that dies before leaves the newest version as it was. Nothing is ever changed in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import discard, materialise
from .sinks import delete_stale, upsert


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class VersionedTable:
    """Rows with unique ``keys``, dealt into ``buckets`` by a hash of ``bucket_by`` (some of the keys)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.bucket_by, self.buckets = spark, path.rstrip("/"), keys, bucket_by or keys, buckets
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the newest) consists of: schema, buckets, and the folder of each bucket that has rows."""
        version = version or max(self.versions(), default=0)
        if not version:
            raise FileNotFoundError(f"{self.path} has no version")
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        m = self.manifest(version)
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in m["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(buckets)).cast("int")

    def _commit(self, base: dict | None, rows: DataFrame, touched: list[int] | None, buckets: int) -> int:
        """Write the rows of the touched buckets (all: None) and then the version that has them."""
        version = (base["version"] if base else 0) + 1
        folder = f"{version:08d}-{uuid.uuid4().hex}"
        where = f"{self.path}/data/{folder}"
        # The hint deals rows by bucket and splits a bucket that is much larger than others.
        rows.withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(where)
        made = [str(s.getPath().getName()).removeprefix("bucket=") for s in self._fs.listStatus(self._hadoop(where)) if str(s.getPath().getName()).startswith("bucket=")]
        kept = {b: f for b, f in (base["folders"] if base else {}).items() if touched is not None and int(b) not in touched}
        new = {"schema": rows.schema.jsonValue(), "buckets": buckets, "keys": self.keys, "bucket_by": self.bucket_by, "folders": kept | dict.fromkeys(made, folder)}
        try:
            self._swap(version, json.dumps(new))
        except VersionConflict:
            self._fs.delete(self._hadoop(where), True)
            raise
        return version

    def _swap(self, version: int, text: str) -> None:
        """Make the version's file appear as a whole; renaming fails where one is there already."""
        beside = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(beside, self._hadoop(f"{self.path}/versions/{version:08d}.json"), options)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"{self.path} has version {version} already") from None
            raise

    def _change(self, rows: DataFrame, change) -> int:
        """Apply ``change`` (old rows, new rows) -> rows to the buckets that the new rows touch."""
        rows = materialise(rows, "changes")
        try:
            if not self.versions():
                return self._commit(None, change(rows.limit(0), rows), None, self.buckets)
            base = self.manifest()
            touched = [r[0] for r in rows.select(self._bucket(base["buckets"])).distinct().collect()]
            if not touched:
                return base["version"]
            old = self.read(base["version"], touched)
            return self._commit(base, change(old, rows), touched, base["buckets"])
        finally:
            discard(rows)

    def upsert(self, rows: DataFrame) -> int:
        """Put ``rows`` in the place of those of the same keys; the version that has them (the newest where there are none)."""
        return self._change(rows, lambda old, new: upsert(old, new, self.keys))

    def delete_stale(self, produced: DataFrame, doc: str) -> int:
        """Drop rows of touched documents that are no longer produced."""
        self._by_document(doc)
        return self._change(produced, lambda old, new: delete_stale(old, new, doc, self.keys))

    def replace_documents(self, produced: DataFrame, doc: str) -> int:
        """Upsert what documents produce now and drop what they no longer do, as one version."""
        self._by_document(doc)
        return self._change(produced, lambda old, new: upsert(delete_stale(old, new, doc, self.keys), new, self.keys))

    def _by_document(self, doc: str) -> None:
        if self.bucket_by != [doc]:
            raise ValueError(f"the table is not bucketed by {doc}: its other rows would lie in untouched buckets")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest versions and the folders that only they name; how many folders went.

        Folders of writers at work look the same as those of dead ones, so nothing may be written meanwhile.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/versions/{v:08d}.json"), False)
        gone = 0
        for s in self._fs.listStatus(self._hadoop(f"{self.path}/data")):
            if str(s.getPath().getName()) not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
