"""Sources: tables, candle and market JSON, hourly order books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDLES = T.StructType([T.StructField("history", T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("p", T.DoubleType())])))])
ORDER_BOOK = T.StructType([
    T.StructField("timestamp_received", T.TimestampType()), T.StructField("timestamp", T.TimestampType()), T.StructField("market", T.BinaryType()),
    T.StructField("event_type", T.StringType()), T.StructField("asset_id", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("size", T.DoubleType()), T.StructField("side", T.StringType()), T.StructField("best_bid", T.DoubleType()), T.StructField("best_ask", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """All message files under path, with event_date and fixture_id taken from the path where files lack them."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    file = F.input_file_name()
    found = {"event_date": F.regexp_extract(file, r"(\d{4}-\d{2}-\d{2})", 1), "fixture_id": F.regexp_extract(file, r"/(?:fixture_id=)?(\d+)/[^/]*$", 1).try_cast("long")}
    return df.withColumns({k: v for k, v in found.items() if k not in df.columns})


def first_rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row a message file under path: file, event_date and fixture_id from the path, and the columns of the file's first row.

    The first row is the one of the smallest row index that the reader gives, found by an aggregate; columns that no file has are null.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
    held = F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    by = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min_by(held, F.col("_metadata.row_index")).alias("r"))
    day, fixture = F.regexp_extract("file", r"/(\d{4}-\d{2}-\d{2})/", 1), F.regexp_extract("file", r"/(\d+)/[^/]*$", 1).try_cast("long")
    return by.select("file", day.alias("path_date"), fixture.alias("path_fixture"), *(F.col(f"r.{c}").alias(c) for c in columns))


def candles(spark: SparkSession, path: str) -> DataFrame:
    """(file, timestamp, mid) from candle JSON files."""
    df = spark.read.schema(CANDLES).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), F.inline("history"))
    return df.select("file", F.timestamp_seconds("t").alias("timestamp"), F.col("p").alias("mid"))


def fixture(spark: SparkSession, root: str, date: str, fixture_id: int, least: int = 20) -> DataFrame | None:
    """One fixture's messages under root/date/fixture_id, or None if there are fewer than `least`."""
    path = f"{root}/{date}/{fixture_id}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    df = messages(spark, path)
    return df if df.limit(least).count() >= least else None


def first_files(spark: SparkSession, root: str, n: int, sport: int | None = None) -> DataFrame:
    """Messages of the first n Parquet files by name under root; of one sport only, if given (sport_id or sportId)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, found = jvm.org.apache.hadoop.fs.Path(root), []
    files = place.getFileSystem(conf).listFiles(place, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        found += [name] if name.endswith(".parquet") else []
    df = spark.read.parquet(*sorted(found)[:n])
    at = next((c for c in df.columns if c.lower().replace("_", "") == "sportid"), None)
    return df if sport is None or at is None else df.where(F.col(at) == sport)


def markets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def price_changes(spark: SparkSession, paths: list[str], ids: DataFrame) -> DataFrame:
    """Price changes of the listed markets from hourly files: the event type is pushed to the scan, ids are a semi-join."""
    book = spark.read.schema(ORDER_BOOK).parquet(*paths).where("event_type = 'price_change'")
    return book.withColumn("market", F.decode("market", "UTF-8")).join(ids.select("market"), "market", "left_semi")


def top_active(events: DataFrame, per: str, key: str, n: int = 200) -> DataFrame:
    """The n most frequent keys of each group; names break ties."""
    from pyspark.sql import Window

    counts = events.groupBy(per, key).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("n"), key))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def large_enough(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least so many rows."""
    keys = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(keys, key, "left_semi")
