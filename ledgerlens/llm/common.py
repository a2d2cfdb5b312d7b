"""Helpers that the text operators share: the shared folder, scratch tables, input columns."""

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests) a temporary folder is made
    and set; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str = "") -> DataFrame:
    """Write ``df`` to the shared folder, or to ``folder`` in it, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_step(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``; then the driver's garbage goes, so a chain of many small steps holds that of one."""
    out = materialize(df, name)
    release(out.sparkSession)
    return out


def bucketed(df: DataFrame, key: str, name: str, buckets: int, sort: bool = False, deal: Column | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once, bucketed by ``key``, so that later joins on ``key`` leave it in place.

    Rows are dealt by ``key`` first, so there is a file a bucket, not one for each task and bucket; or by
    ``deal``, which may spread the rows of a key that no join is on. ``options`` are the writer's.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key) if deal is None else df.withColumn("__deal", deal).repartition(buckets, "__deal").drop("__deal")
    writer = dealt.write.options(**(options or {})).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(buckets, key)
    (writer.sortBy(key) if sort else writer).saveAsTable(table)
    release(spark)
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written; it does so for plans that
    have become garbage, which else happens whenever the driver's heap fills up.

    Spark's queues of events hold the last one, and with it the plan that just ended, until another query
    has ended; so one without a job goes first.
    """
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays. Null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
