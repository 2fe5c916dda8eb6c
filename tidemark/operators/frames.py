"""Sums, trends and extremes over time frames in linear time, whatever the length of a frame, and with busy keys cut by time.

A frame holds the times in (t + lo, t + hi], whole numbers in the order's unit; between() translates ends. A key's time is cut into cells as
wide as the longest frame, so a frame lies in one cell or in two neighbours. Rows and probes (an instant that asks, shifted by an end
of a frame) are sorted together inside each (key, cell), so a key with a third of all rows is spread over its cells. Sums: a probe takes the running sum
of its cell up to it; a frame is the difference of its two probes, plus the first cell's total where it crosses into the next. Extremes: cells are as
wide as the frame, so it is the rest of one cell and the beginning of the next: a running minimum backwards and one forwards.
Frames depend on the instant alone, so equal times ask once; rows without time lie in no frame and have empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SECOND

Frame = tuple[str, int, int]


def between(seconds: float, closed: str = "both", ahead: bool = False) -> tuple[int, int]:
    """(lo, hi) of the last (or next) seconds: both ends, the left, the right or neither belong to it."""
    w = int(seconds * SECOND)
    lo, hi = (0, w) if ahead else (-w, 0)
    return (lo - 1 if closed in ("both", "left") else lo), (hi if closed in ("both", "right") else hi - 1)


def cell_of(at: Column, width: int) -> Column:
    """The number of the cell of a time, rounded down."""
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def _stream(owners: DataFrame, ticks: DataFrame, key: str, order: str, offsets: list[int], width: int) -> DataFrame:
    """ticks(key, _at, ...) and the probes of each distinct instant: key, _t (the instant), _o (number of the offset; ticks: -1), _at, _cell."""
    own = owners.where(F.col(order).isNotNull()).select(key, F.col(order).alias("_t")).distinct()
    ends = F.array(*(F.struct(F.lit(i).alias("_o"), (F.col("_t") + x).alias("_at")) for i, x in enumerate(offsets)))
    both = own.select(key, "_t", F.inline(ends)).unionByName(ticks.withColumn("_o", F.lit(-1)), allowMissingColumns=True)
    return both.withColumn("_cell", cell_of(F.col("_at"), width))


def framed(owners: DataFrame, rows: DataFrame, key: str, order: str, values: dict[str, Column], frames: dict[str, Frame], lines: dict[str, Frame] | None = None) -> DataFrame:
    """(key, order, ...) of each distinct instant of owners: for each frame the sum of a value over rows, 0 where there is none.

    lines: for each, `<name>_n`, `<name>_sum` and `<name>_slope`, the least-squares slope of a value against its ordinal in the frame (fewer
    than two: 0). A value of a line has one row an instant at most.
    """
    lines = lines or {}
    asked = {**frames, **lines}
    offsets = sorted({x for _, lo, hi in asked.values() for x in (lo, hi)})
    width = max(hi - lo for _, lo, hi in asked.values())
    at = {x: i for i, x in enumerate(offsets)}
    held = rows.where(F.col(order).isNotNull()).groupBy(key, F.col(order).alias("_at"))
    ticks = held.agg(*(F.sum(v).alias(f"_v_{n}") for n, v in values.items()))
    stream = _stream(owners, ticks, key, order, offsets, width)
    cell = Window.partitionBy(key, "_cell")
    run = cell.orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    drawn = sorted({v for v, _, _ in lines.values()})
    # a value's ordinal in its cell, and its product with the value
    stream = stream.withColumns({f"_v_{v}:n": F.when(F.col(f"_v_{v}").isNotNull(), F.lit(1)) for v in drawn})
    stream = stream.withColumns({f"_v_{v}:x": F.sum(f"_v_{v}:n").over(run) * F.col(f"_v_{v}") for v in drawn})
    names = [*values, *(f"{v}:{p}" for v in drawn for p in "nx")]
    zero = lambda c: F.coalesce(c, F.lit(0))
    stream = stream.withColumns({f"_s_{n}": zero(F.sum(f"_v_{n}").over(run)) for n in names} | {f"_a_{n}": zero(F.sum(f"_v_{n}").over(cell)) for n in names})

    def crosses(hi: int) -> Column:
        return F.col("_cell") != cell_of(F.col("_t") + hi, width)

    def total(value: str, lo: int, hi: int) -> Column:
        s, whole = F.col(f"_s_{value}"), F.col(f"_a_{value}")
        return F.sum(F.when(F.col("_o") == at[hi], s).when(F.col("_o") == at[lo], F.when(crosses(hi), whole - s).otherwise(-s)))

    out = [total(*f).alias(n) for n, f in frames.items()]
    for n, (v, lo, hi) in lines.items():
        first, last = F.col("_o") == at[lo], F.col("_o") == at[hi]
        out += [total(f"{v}:n", lo, hi).alias(f"{n}_n"), total(v, lo, hi).alias(f"{n}_sum"), total(f"{v}:x", lo, hi).alias(f"_{n}_x")]
        # ordinals of the second cell go on from the first one's
        out += [F.sum(F.when(first, F.col(f"_s_{v}:n"))).alias(f"_{n}_start"), F.sum(F.when(first & crosses(hi), F.col(f"_a_{v}:n")).otherwise(0)).alias(f"_{n}_carry"), F.sum(F.when(last, F.col(f"_s_{v}"))).alias(f"_{n}_end")]
    found = stream.where("_o >= 0").groupBy(key, F.col("_t").alias(order)).agg(*out)
    for n in lines:
        count = F.col(f"{n}_n")
        xy = F.col(f"_{n}_x") + F.col(f"_{n}_carry") * F.col(f"_{n}_end") - (F.col(f"_{n}_start") + (count + 1) / 2) * F.col(f"{n}_sum")
        found = found.withColumn(f"{n}_slope", F.when(count >= 2, xy / (count.cast("double") * (count * count - 1) / 12)).otherwise(F.lit(0.0)))
        found = found.drop(*(f"_{n}_{p}" for p in ("x", "start", "carry", "end")))
    return found


def extremes(owners: DataFrame, rows: DataFrame, key: str, order: str, value: str, lo: int, hi: int) -> DataFrame:
    """(key, order, low, high) of each distinct instant of owners: the smallest and largest value of rows in its frame, null if there is none."""
    ticks = rows.where(F.col(order).isNotNull()).groupBy(key, F.col(order).alias("_at")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    stream = _stream(owners, ticks, key, order, [lo, hi], hi - lo)
    cell = Window.partitionBy(key, "_cell")
    # up to the probe of the end; and, backwards, what comes after the probe of the beginning
    upto = cell.orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    after = cell.orderBy(F.desc("_at"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumns({"_l1": F.min("_low").over(upto), "_h1": F.max("_high").over(upto), "_l0": F.min("_low").over(after), "_h0": F.max("_high").over(after)})
    pick = lambda x: F.when(F.col("_o") == 1, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    return stream.where("_o >= 0").groupBy(key, F.col("_t").alias(order)).agg(F.min(pick("_l")).alias("low"), F.max(pick("_h")).alias("high"))


def joined(df: DataFrame, found: DataFrame, key: str, order: str) -> DataFrame:
    """df with the columns found for its instants; null keys meet null ones."""
    found = found.withColumnsRenamed({key: "_k", order: "_t"})
    return df.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_t")), "left").drop("_k", "_t")


def with_sums(df: DataFrame, key: str, order: str, values: dict[str, Column], frames: dict[str, Frame]) -> DataFrame:
    """df with sums of its own values over frames of its own rows; empty ones are 0."""
    return joined(df, framed(df, df, key, order, values, frames), key, order).na.fill(0, list(frames))


def with_extremes(df: DataFrame, key: str, order: str, value: str, lo: int, hi: int, low: str, high: str) -> DataFrame:
    """df with the smallest and largest of its own values over a frame of its own rows."""
    return joined(df, extremes(df, df, key, order, value, lo, hi).withColumnsRenamed({"low": low, "high": high}), key, order)
