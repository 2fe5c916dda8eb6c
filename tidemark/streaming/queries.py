"""Streaming twins of the batch queries: they take a stream or a table with a TIMESTAMP column ts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.windows import SECOND
from ..shipping import ship


def minute_stream(events: DataFrame, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """analytics.minute_line over tumbling windows."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width)).agg(
        F.avg("mid_price").alias("price"),
        F.avg("prob").alias("mean_prob"),
        F.max("prob").alias("max_prob"),
        F.avg("label").alias("vol_rate"),
        F.count("*").alias("n"),
    )


def density_stream(events: DataFrame, width: str = "1 minute", step: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Events and summed weight of each fixture over sliding windows."""
    grouped = events.withWatermark("ts", watermark).groupBy("fixture_id", F.window("ts", width, step))
    return grouped.agg(F.count("*").alias("density"), F.sum("weight").alias("xt_sum"))


def session_stream(events: DataFrame, gap: str = "120 seconds", move: float = 0.08, watermark: str = "10 minutes") -> DataFrame:
    """analytics.move_sessions on a stream. A session window also splits at a gap of exactly `gap`."""
    big = events.where(F.col("move") > move).withWatermark("ts", watermark)
    grouped = big.groupBy("fixture_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n"), F.max("move").alias("max_move"))


STATE = "price double, at array<long>, conf array<double>"
ROLLED = "fixture_id long, event_id long, us long, price double, conf_trend double"


def _slope(values: list[float]) -> float:
    """Least-squares slope over 0..n-1; fewer than two values: 0."""
    n = len(values)
    if n < 2:
        return 0.0
    middle, mean = (n - 1) / 2, sum(values) / n
    return sum((i - middle) * (v - mean) for i, v in enumerate(values)) / (n * (n * n - 1) / 12)


def rolling_state(seconds: float, k: int):
    """A step over a fixture's new rows that keeps its last price and its last k confidences."""
    width = int(seconds * SECOND)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, at, conf = state.get if state.exists else (None, [], [])
        at, conf, out = list(at), list(conf), []
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"], kind="stable")
        for us, same in rows.groupby("us", sort=True):
            # of equal times all prices and confidences count for all rows, as in a frame that ends with t
            priced = same[same["price"].notna()]
            price = float(priced["price"].iloc[-1]) if len(priced) else price
            known = same[same["conf"].notna()]
            at, conf = (at + [int(us)] * len(known))[-k:], (conf + [float(c) for c in known["conf"]])[-k:]
            trend = _slope([c for t, c in zip(at, conf, strict=True) if t >= us - width])
            out += [(key[0], int(i), int(us), price, trend) for i in same[same["is_event"]]["event_id"]]
        state.update((price, at, conf))
        yield pd.DataFrame(out, columns=["fixture_id", "event_id", "us", "price", "conf_trend"]).astype({"price": "float64", "conf_trend": "float64"})

    return step


def rolling_stream(rows: DataFrame, seconds: float = 60, k: int = 5) -> DataFrame:
    """fixture_id, event_id, us, price (the last at or before the event) and conf_trend (slope of the last k confidences of the last seconds).

    rows(fixture_id, event_id, us, is_event, price, conf): prices are rows that aren't events. The streaming twin of asof.backward and with_trend: a
    fixture's state is one price and k confidences. Rows of a fixture must arrive in order of time; inside a batch they may be in any order, and what comes late counts from then on.
    """
    ship(rows.sparkSession)
    kept = rows.select(F.col("fixture_id").cast("long").alias("fixture_id"), F.col("event_id").cast("long").alias("event_id"), "us", "is_event", "price", "conf")
    return kept.groupBy("fixture_id").applyInPandasWithState(rolling_state(seconds, k), ROLLED, STATE, "append", "NoTimeout")
