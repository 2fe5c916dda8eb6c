"""As-of joins as one union: linear, and with busy keys cut by time.

A key's time is cut into cells of CELL. Inside a cell the latest (or next) price is carried along by a growing window; what
comes from cells before (or after) is one row a cell, carried over a key's cells and joined to each. So no task holds more of a key than a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cell_of
from .windows import SECOND, onward, until

CELL = 6 * 3600 * SECOND


def _both(left: DataFrame, right: DataFrame, key: str, order: str, value: str, tie: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Union of events and prices (of an instant the last by tie) with its cells, and the cells' first and last prices."""
    prices = right.groupBy(key, order).agg(F.max_by(value, tie).alias("_v"))
    prices = prices.where(F.col(order).isNotNull()).select(key, order, F.struct(F.col(order).alias("at"), F.col("_v").alias("v")).alias("_p"))
    both = left.withColumn("_event", F.lit(True)).unionByName(prices, allowMissingColumns=True).withColumn("_cell", cell_of(F.col(order), cell))
    held = both.groupBy(F.col(key).alias("_k"), F.col("_cell").alias("_c")).agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    return both, held


def _carried(both: DataFrame, held: DataFrame, key: str, ahead: bool = False) -> DataFrame:
    """both with _before, the last price of earlier cells, and with ahead also _after, the first of later ones."""
    w = Window.partitionBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    found = {"_before": F.last("_last", ignorenulls=True).over(w.orderBy("_c"))}
    if ahead:
        found["_after"] = F.last("_first", ignorenulls=True).over(w.orderBy(F.desc("_c")))
    held = held.withColumns(found).drop("_first", "_last")
    return both.join(held, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")), "left").drop("_k", "_c")


def backward(left: DataFrame, right: DataFrame, key: str, order: str, value: str, tie: str, cell: int = CELL) -> DataFrame:
    """left with the latest value of right at or before each row (null if there is none) and its time, `<value>_at`."""
    both = _carried(*_both(left, right, key, order, value, tie, cell), key)
    both = both.withColumn("_hit", F.coalesce(F.last("_p", ignorenulls=True).over(until([key, "_cell"], order)), "_before"))
    return both.where("_event").select(*left.columns, F.col("_hit.v").alias(value), F.col("_hit.at").alias(f"{value}_at"))


def nearest(left: DataFrame, right: DataFrame, key: str, order: str, value: str, tie: str, seconds: float, cell: int = CELL) -> DataFrame:
    """left with the value of right nearest in time within a tolerance; the earlier wins a tie."""
    both = _carried(*_both(left, right, key, order, value, tie, cell), key, ahead=True)
    both = both.withColumn("_a", F.coalesce(F.last("_p", ignorenulls=True).over(until([key, "_cell"], order)), "_before"))
    both = both.withColumn("_b", F.coalesce(F.last("_p", ignorenulls=True).over(onward([key, "_cell"], order)), "_after"))
    da, db = F.col(order) - F.col("_a.at"), F.col("_b.at") - F.col(order)
    pick = F.when(F.col("_b").isNull() | (da <= db), F.col("_a")).otherwise(F.col("_b"))
    both = both.where("_event").withColumn("_hit", pick)
    near = F.abs(F.col("_hit.at") - F.col(order)) <= int(seconds * SECOND)
    return both.select(*left.columns, F.when(near, F.col("_hit.v")).alias(value))


def carried(df: DataFrame, key: str, order: str, tie: str, value: str, when: str, default) -> DataFrame:
    """df with value carried forward from the rows where `when` holds; of equal times the first such row counts."""
    first = Window.partitionBy(key, order).orderBy(F.when(F.expr(when), 0).otherwise(1), tie)
    held = F.when(F.expr(when), F.col(value))
    df = df.withColumn("_v", F.first(held).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.withColumn(f"carried_{value}", F.coalesce(F.last("_v", ignorenulls=True).over(until(key, order)), F.lit(default))).drop("_v")
