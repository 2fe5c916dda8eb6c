"""Forward-looking labels."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def largest_move(low: Column, high: Column, now: Column) -> Column:
    """Largest distance of a frame's prices from the price now, by its extremes; none: 0."""
    return F.coalesce(F.greatest(F.abs(high - now), F.abs(low - now)), F.lit(0.0))


def max_move(price: str, now: Column, frame: WindowSpec) -> Column:
    """Largest distance of the frame's prices from the price now; none: 0."""
    return largest_move(F.min(price).over(frame), F.max(price).over(frame), now)


def absolute_label(move: Column, threshold: float = 0.03) -> Column:
    """Strictly above the threshold."""
    return (move > threshold).cast("int")


def relative_label(move: Column, now: Column, threshold: float = 0.03) -> Column:
    """Move over price at least the threshold; prices of 0 or less: 0."""
    return F.when(now > 0, (move / now >= threshold).cast("int")).otherwise(F.lit(0))


def tick_label(change: str, frame: WindowSpec, threshold: float = 0.03) -> Column:
    """Any tick in the frame that changes by more than the threshold."""
    return F.coalesce((F.max(F.abs(F.col(change))).over(frame) > threshold).cast("int"), F.lit(0))


def causal_label(flag: str, frame: WindowSpec) -> Column:
    """Any flagged row in the frame."""
    return F.coalesce(F.max(flag).over(frame), F.lit(0))


def tick_change(price: str, key, *order: str) -> Column:
    """Difference from the row before in the key; 0 for the first."""
    return F.coalesce(F.col(price) - F.lag(price).over(Window.partitionBy(key).orderBy(*order)), F.lit(0.0))
