"""Exact quantiles by group, with no group's values in one place.

1. Values are counted by (group, bucket); buckets are ranges of values, cut at numbers that split the whole column evenly (or given ones).
2. Running counts over a group's buckets, a few numbers, tell which bucket holds each wanted rank.
3. Only values of those buckets are looked at again: counted by value, then ranked inside the bucket by a running sum.
A task holds the buckets of a group (SPLITS numbers) or streams over one bucket's distinct values. Copies of a value cost nothing more.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 1024


def split_points(df: DataFrame, value: str, n: int = SPLITS) -> list[float]:
    """About n numbers that cut a column's values evenly: one row of a sketch reaches the driver. They needn't be exact."""
    shares = F.array(*(F.lit((i + 1) / n) for i in range(n - 1)))
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 4 * n)).first()[0]
    return sorted(set(found or []))


def _bucketed(df: DataFrame, value: str, splits: list[float]) -> DataFrame:
    ends = [-float("inf"), *(splits or [0.0]), float("inf")]
    return Bucketizer(splits=ends, inputCol="_v", outputCol="_bucket", handleInvalid="keep").transform(df.withColumn("_v", F.col(value).cast("double")))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str, splits: list[float] | None = None) -> DataFrame:
    """One row a group with, for each name, the quantile at its share (linear between neighbours, as PERCENTILE_CONT). Nulls don't count.

    Groups without values have no row, but without `by` there is always one row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    rows = _bucketed(rows, value, split_points(rows, value) if splits is None else splits)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(group)}).withColumn("_below", F.col("_upto") - F.col("_n"))
    # ranks from 0: the one at or below each share, and the next
    wanted = []
    for i, share in enumerate(shares.values()):
        at = F.lit(share) * (F.col("_all") - 1)
        wanted += [F.struct(F.lit(2 * i).alias("_q"), F.floor(at).alias("_rank"), (at - F.floor(at)).alias("_part")), F.struct(F.lit(2 * i + 1).alias("_q"), F.ceil(at).alias("_rank"), (at - F.floor(at)).alias("_part"))]
    asked = counts.select(*by, "_bucket", "_below", "_upto", F.inline(F.array(*wanted))).where("_rank >= _below and _rank < _upto")
    held = asked.groupBy(*by, "_bucket").agg(F.min("_below").alias("_below"), F.collect_list(F.struct("_q", "_rank", "_part")).alias("_asked"))
    names = {c: f"_k{i}" for i, c in enumerate((*by, "_bucket"))}
    met = F.lit(True)
    for c, k in names.items():
        met = met & F.col(c).eqNullSafe(F.col(k))
    near = rows.join(held.withColumnsRenamed(names).drop("_below", "_asked"), met, "left_semi")
    near = near.groupBy(*by, "_bucket", "_v").agg(F.count("*").alias("_n"), F.first(value).alias("_value"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.sum("_n").over(inside)).join(held.withColumnsRenamed(names), met)
    hits = near.select(*by, "_value", F.inline(F.filter("_asked", lambda a: (a["_rank"] < F.col("_below") + F.col("_to")) & (a["_rank"] >= F.col("_below") + F.col("_to") - F.col("_n")))))
    pick = lambda q: F.max(F.when(F.col("_q") == q, F.col("_value")))
    part = lambda q: F.max(F.when(F.col("_q") == q, F.col("_part")))
    out = [(pick(2 * i) + part(2 * i) * (pick(2 * i + 1) - pick(2 * i))).alias(name) for i, name in enumerate(shares)]
    return hits.groupBy(*by).agg(*out)
