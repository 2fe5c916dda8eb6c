"""Synthetic match generator: every number follows from a hash of match, step and seed, so it runs as plain expressions."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, win_probability

# fixed values: event kinds and their weights
KINDS = ("POSSESSION", "ATTACK", "DANGEROUS_ATTACK", "SHOT_OFF_TARGET", "SHOT_ON_TARGET", "CORNER", "GOAL", "YELLOW_CARD", "RED_CARD", "PENALTY", "FREE_KICK", "THROW_IN", "OFFSIDE")
WEIGHTS = (0.30, 0.20, 0.15, 0.08, 0.06, 0.05, 0.02, 0.04, 0.005, 0.01, 0.04, 0.03, 0.015)


def _u(seed: int, what: str, step: Column | None = None) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "match_id", F.col("step") if step is None else step), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _second(seed: int) -> Column:
    """beta(2, 8): the second smallest of nine uniform numbers."""
    return F.sort_array(F.array(*(_u(seed, f"conf{i}") for i in range(9))))[1]


def _bounds() -> list[float]:
    """Where each kind but the last ends on (0, 1)."""
    return list(accumulate(w / sum(WEIGHTS) for w in WEIGHTS[:-1]))


def _moves(seed: int, n_events: int) -> Column:
    """(gap, home, away) of each step of a match: the time to it and the goals in it."""
    low, high = (_bounds()[KINDS.index("GOAL") + i] for i in (-1, 0))

    def move(step: Column) -> Column:
        pick, home = _u(seed, "kind", step), _u(seed, "side", step) < 0.55
        goal = (pick >= low) & (pick < high)
        return F.struct((-18.0 * F.log(_u(seed, "gap", step))).alias("gap"), (goal & home).cast("long").alias("home"), (goal & ~home).cast("long").alias("away"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_events - 1)), move)


def _running(moves: Column, n_events: int) -> Column:
    """(step, elapsed_time, score_home, score_away) of each step: sums carried along the steps inside a match's row, so without a sort.

    Blocks of about sqrt(n_events) steps: the sums at their starts, then those inside each, as an array is copied with each step added to it.
    """
    size = math.isqrt(n_events)
    state = lambda step, time, home, away: F.struct(step.alias("step"), time.alias("elapsed_time"), home.alias("score_home"), away.alias("score_away"))
    after = lambda held, m: state(held["step"] + 1, held["elapsed_time"] + m["gap"], held["score_home"] + m["home"], held["score_away"] + m["away"])
    added = lambda rows, row: F.concat(rows, F.array(row))
    last, block = (lambda rows: F.element_at(rows, -1)), (lambda i: F.slice(moves, i * size + 1, F.lit(size)))
    starts = F.array(state(F.lit(-1), F.lit(0.0), F.lit(0).cast("long"), F.lit(0).cast("long")))
    if n_events > size:
        starts = F.aggregate(F.sequence(F.lit(0), F.lit((n_events - 1) // size - 1)), starts, lambda held, i: added(held, F.aggregate(block(i), last(held), after)))
    inside = lambda held, i: F.slice(F.aggregate(block(i), F.array(held), lambda rows, m: added(rows, after(last(rows), m))), 2, size)
    return F.flatten(F.transform(starts, inside))


def matches(ids: DataFrame, n_events: int = 300, seed: int = 42) -> DataFrame:
    """match_id, step, elapsed_time, event_type, score_home, score_away, confidence, true_win_prob, price of a match for each of ids(match_id)."""
    # so many tasks, however few bytes the ids are: they become n_events rows each
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.select("match_id").repartition(tasks, "match_id").distinct().withColumn("moves", _moves(seed, n_events))
    rows = rows.select("match_id", F.inline(_running(F.col("moves"), n_events)))
    kind, pick = None, _u(seed, "kind")
    for name, bound in zip(KINDS[:-1], _bounds(), strict=True):
        kind = F.when(pick < bound, F.lit(name)) if kind is None else kind.when(pick < bound, F.lit(name))
    left = F.greatest(F.lit(0.0), 90 - F.col("elapsed_time") / 60)
    rows = rows.withColumns({"event_type": kind.otherwise(F.lit(KINDS[-1])), "true_win_prob": win_probability(F.col("score_home") - F.col("score_away"), left)})
    normal = F.sqrt(-2 * F.log(_u(seed, "n1"))) * F.cos(6.283185307179586 * _u(seed, "n2"))
    rows = rows.withColumns({"confidence": 1 - _second(seed), "price": clip(F.col("true_win_prob") + 0.015 * normal, 0.01, 0.99)})
    return rows.select("match_id", "step", "event_type", "elapsed_time", "score_home", "score_away", "true_win_prob", "confidence", "price")
