"""Session builder and the shared folder in which long plans cut their lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER = "marlstone-work"
_OPENED: set[str] = set()


def build_session(app: str = "marlstone", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every query of this package assumes."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MARLSTONE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small frame's rows out over all cores before work that is heavy for each row.

    A file of one row group is one split however many cores there are. Inputs whose size already makes as many splits
    as there are cores are left as they are, so what is moved is bounded by cores times the split size.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


#: Rows and bytes of an Arrow batch of whole texts, so that a Python worker holds little at once.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """Set the session's Arrow batches to a size fit for whole texts, and give the frame back."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application in the cluster's spark.checkpoint.dir; without one (tests), beside the warehouse.

    It is deleted when the driver's JVM ends.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        base = given
    elif not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/" + _OWN_FOLDER
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if path not in _OPENED:
        _OPENED.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    Lineage ends at the files, which any executor can read after another is lost. Columns keep their
    names and types. The files live until ``discard`` or until the application's folder is removed. They are
    zstd-compressed: that codec works in heap buffers, while snappy's direct ones are only freed by a full
    collection and can double an executor's memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.marlstone_path = path
    return out


def bounded(df: DataFrame, rows: int = 200_000, label: str = "bounded") -> DataFrame:
    """A frame for the small side of a join: written down, counted, and marked for broadcast up to ``rows`` rows.

    Beyond them it is joined by shuffle, like any other.
    """
    from pyspark.sql import functions as F

    out = materialise(df, label)
    return F.broadcast(out) if out.count() <= rows else out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a frame that ``materialise`` made, once nothing reads them any more."""
    path = getattr(df, "marlstone_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Let go of the shuffle files of finished steps.

    Executors delete a shuffle's files once the driver has collected the plan that made it, which a large heap may put off for long. After a
    step is written down nothing reads its shuffles any more, so a stage that writes many calls for a collection then.
    """
    df.sparkSession._jvm.System.gc()
