"""Shared helpers: table readers, the shared folder and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors; rows hold whole texts, so Arrow tasks take ARROW_ROWS of them at a time unless the session says otherwise."""
    shipping.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers serve many tasks, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column."""
    while name in df.columns:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir, which driver and executors share.

    Only in a local session that names none (tests) a temporary folder is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.local.dir", None)
    if not folder:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            return named.get()
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.local.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that serve one run: scratch(df, name) writes one, drop(name) removes those of a name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def next_ids(ids: DataFrame) -> DataFrame:
    """For a column doc_id: each distinct id with the next larger one (the last: the first).

    Ids are dealt out by ranges; a window runs inside each range, and only one id per
    range (a count set by configuration, not by the data) closes the gaps between them.
    """
    from pyspark.sql import Window

    spark = ids.sparkSession
    n = shuffle_partitions(spark) * 2
    dealt = ids.where("doc_id is not null").distinct().repartitionByRange(n, "doc_id")
    dealt = materialize(dealt.withColumn("rng", F.spark_partition_id()), "ids")
    heads = dealt.groupBy("rng").agg(F.min("doc_id").alias("head"))
    after = heads.withColumn("after", F.lead("head").over(Window.orderBy("head")))
    after = after.withColumn("after", F.coalesce("after", F.min("head").over(Window.partitionBy())))
    inner = dealt.withColumn("nxt", F.lead("doc_id").over(Window.partitionBy("rng").orderBy("doc_id")))
    return inner.join(F.broadcast(after.select("rng", "after")), "rng", "left").select(
        "doc_id", F.coalesce("nxt", "after").alias("next_id")
    )
