"""A store of hours: results of hourly source files, kept by hour, so that each hour is read from its source once.

What is wanted, (market, hour), comes from fan_out(). fill() takes an anti-join of it with what the store holds, reads the sources of
the hours that lack something alone, and writes them with dynamic partition overwrite: partitions of other hours stay, and a repeated or retried fill
replaces its own. It is noted which markets an hour was read for, so that one without any price isn't read again, and one that another market is wanted of later is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hour_range


def fresh_root(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return f"{folder.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written below fresh_root() and read back: what follows doesn't compute it again."""
    path = fresh_root(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fan_out(markets: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """(fixture_id, market, hour) of markets(fixture_id, market, at): the hours from `before` ahead of each market's time to `after` past it."""
    return markets.where("at is not null").select("fixture_id", "market", F.explode(hour_range(F.col("at").cast("timestamp"), before, after)).alias("hour")).distinct()


def ids_by_hour(wanted: DataFrame) -> DataFrame:
    """(hour, markets): the distinct markets that each hour's file is scanned for."""
    return wanted.groupBy("hour").agg(F.array_sort(F.collect_set("market")).alias("markets"))


def ids_by_fixture(wanted: DataFrame) -> DataFrame:
    """(fixture_id, markets): the distinct markets of each fixture."""
    return wanted.groupBy("fixture_id").agg(F.array_sort(F.collect_set("market")).alias("markets"))


class HourStore:
    """Prices (market, timestamp, price, ...) under root, partitioned by hour."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def held(self) -> DataFrame:
        """(hour, market) that the store has an answer for, be it that there is no price."""
        return self.spark.read.schema("hour string, market string").parquet(f"{self.root}/held").distinct() if self._exists("held") else self.spark.createDataFrame([], "hour string, market string")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """(hour, market) of what is wanted and not held."""
        return wanted.select("hour", F.col("market").cast("string").alias("market")).distinct().join(self.held(), ["hour", "market"], "left_anti")

    def fill(self, wanted: DataFrame, source: Callable[[list[str]], DataFrame]) -> list[str]:
        """Read the hours that lack a wanted market from source(hours) (market, hour, ...) and keep the prices of those and of what they held; gives the hours that were read.

        The list of hours goes through the driver, as paths of files do anyway; their markets don't.
        """
        lacking = self.missing(wanted)
        hours = sorted(r["hour"] for r in lacking.select("hour").distinct().collect())
        if not hours:
            return []
        lacking = self._written(lacking, f"wanted-{uuid.uuid4().hex}")
        again = self.held().join(lacking.select("hour").distinct(), "hour", "left_semi")
        pairs = lacking.unionByName(again).withColumnRenamed("market", "_m")
        found = source(hours)
        found = found.join(pairs.withColumnRenamed("hour", "_h"), (F.col("hour") == F.col("_h")) & (F.col("market").cast("string") == F.col("_m")), "left_semi")
        found.repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(f"{self.root}/prices")
        # what is held is noted last: a fill that broke off is done again
        lacking.write.mode("append").parquet(f"{self.root}/held")
        return hours

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def prices(self, wanted: DataFrame) -> DataFrame:
        """fixture_id with the prices of its own markets and hours. Partitions of other hours are pruned when the wanted ones are known."""
        held = self.spark.read.option("basePath", f"{self.root}/prices").schema(self._schema()).parquet(f"{self.root}/prices")
        return held.join(wanted.select("fixture_id", "market", "hour"), ["market", "hour"])

    def _schema(self) -> str:
        """The stored columns, with hour as text: partition values would be read as times otherwise."""
        kept = self.spark.read.parquet(f"{self.root}/prices").drop("hour").schema
        return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "hour string"])
