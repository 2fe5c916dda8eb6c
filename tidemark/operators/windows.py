"""Time-range frames over keyed event streams, on a LONG of microseconds."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000


def past(key, order: str, seconds: float, closed: str = "both") -> WindowSpec:
    """Frame of the last seconds up to t: both [t-w, t], left [t-w, t), right (t-w, t], neither (t-w, t)."""
    w = int(seconds * SECOND)
    lo = -w if closed in ("both", "left") else -w + 1
    hi = 0 if closed in ("both", "right") else -1
    return Window.partitionBy(key).orderBy(order).rangeBetween(lo, hi)


def future(key, order: str, seconds: float, closed: str = "right") -> WindowSpec:
    """Frame of the next seconds: right (t, t+w], both [t, t+w]."""
    return Window.partitionBy(key).orderBy(order).rangeBetween(0 if closed == "both" else 1, int(seconds * SECOND))


def until(key, order: str) -> WindowSpec:
    """All rows up to t, ties included."""
    return Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)


def onward(key, order: str) -> WindowSpec:
    """All rows from t on, ties included, latest first: last() over it is the earliest of them. Grows by a row at a time."""
    return Window.partitionBy(key).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)


def slope(values: Column) -> Column:
    """Least-squares slope of an array over 0..k-1; fewer than two values: 0."""
    n = F.size(values).cast("double")
    sy = F.aggregate(values, F.lit(0.0), lambda a, y: a + y)
    pairs = F.transform(values, lambda y, i: y * i)
    sxy = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + y)
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    return F.when(n >= 2, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(F.lit(0.0))


def last_values(order: str, tie: str, value: str, frame: WindowSpec, k: int = 5) -> Column:
    """The last k values of a frame that aren't null, in order."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, tie, value))).over(frame))
    return F.transform(F.slice(rows, F.greatest(F.size(rows) - (k - 1), F.lit(1)), k), lambda r: r[value])


def trend(order: str, tie: str, value: str, frame: WindowSpec, k: int = 5) -> Column:
    """Slope of the last k values of a frame."""
    return slope(last_values(order, tie, value, frame, k))


def with_trend(df, key: str, order: str, tie: str, value: str, seconds: float, into: str, closed: str = "both", k: int = 5):
    """df with the slope of the last k values (that aren't null) of the last seconds up to t; closed: both or left.

    Each row with a value takes the k - 1 before it along; the latest such list as of t is then cut
    to the frame. Both windows only grow, so long frames cost no more than short ones.
    """
    own = Window.partitionBy(key, "_has").orderBy(order, tie).rowsBetween(1 - k, 0)
    seen = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if closed == "both" else -1)
    df = df.withColumn("_has", F.col(value).isNotNull())
    df = df.withColumn("_five", F.collect_list(F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), F.col(value).cast("double").alias("v"))).over(own))
    df = df.withColumn("_five", F.max(F.when(F.col("_has"), F.struct(order, tie, "_five"))).over(seen)["_five"])
    inside = F.filter("_five", lambda x: x["o"] >= F.col(order) - int(seconds * SECOND))
    return df.withColumn(into, F.coalesce(slope(F.transform(inside, lambda x: x["v"])), F.lit(0.0))).drop("_has", "_five")


def sessions(df, key: str, order: str, gap: int, tie: str | None = None):
    """df with session: a row starts a new one if it comes more than gap (in the order's unit) after the row before."""
    w = Window.partitionBy(key).orderBy(order, *([tie] if tie else []))
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
