"""The full feature row: frames over events, as-of price, frames over prices and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import backward
from .frames import between, extremes, framed, joined, with_extremes, with_sums
from .labels import absolute_label, largest_move
from ..functions import scalars as S
from ..functions.constants import TIMER_KINDS
from .windows import with_trend

DENSITY = (30, 60, 120, 300)


def game_state(messages: DataFrame, timers: tuple[str, ...] = TIMER_KINDS) -> DataFrame:
    """messages(home_value, away_value, seconds, period_id, incident) with the game's state as features; what can't be parsed is 0 (period: 10)."""
    home, away = S.number(F.col("home_value")), S.number(F.col("away_value"))
    seconds = S.number(F.col("seconds"))
    df = messages.withColumns({
        "score_diff": (home - away).cast("int"), "total_goals": (home + away).cast("int"), "minutes_elapsed": S.minutes_elapsed(seconds),
        "minutes_remaining": S.minutes_remaining(seconds), "period_id": S.number(F.col("period_id"), 10.0),
    })
    df = df.withColumns({
        "is_leading": (F.col("score_diff") > 0).cast("int"), "is_drawing": (F.col("score_diff") == 0).cast("int"), "is_trailing": (F.col("score_diff") < 0).cast("int"),
        "game_intensity": S.game_intensity(F.col("total_goals"), F.col("minutes_elapsed")),
        "is_timer_period": F.coalesce(F.col("incident").isin(*timers), F.lit(False)).cast("int"),
    })
    return df.drop("home_value", "away_value", "seconds")


def feature_row(
    events: DataFrame, prices: DataFrame, weight: Column, high_risk: Column, high_impact: Column, scale: float = 1.0, low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """One row for each event that has a price in (low, high) at or before it.

    events(fixture_id, event_id, us, incident, conf), with the state columns of game_state() if wanted, and prices(fixture_id, event_id, us, price).
    Window lengths are seconds times scale. All sums are differences of running sums (frames.py), found once for each instant of a fixture.
    A price at t counts for the as-of price and not for the price windows before t or after it.
    """
    key, us = "fixture_id", "us"
    ticks = prices.groupBy(key, us).agg(F.max_by("price", "event_id").alias("price"))
    marked = events.withColumns({"xt_weight": weight, "risk": high_risk.cast("int"), "is_high_impact": high_impact.cast("int")})
    rows = marked.select(key, us, F.lit(1).alias("n"), "risk", F.col("is_high_impact").alias("impact"), F.col("xt_weight").alias("xt"))
    rows = rows.unionByName(ticks.withColumn("square", F.col("price") * F.col("price")), allowMissingColumns=True)
    before = between(300 * scale, "left")
    frames = {f"event_density_{s}s": ("n", *between(s * scale)) for s in DENSITY}
    frames |= {f"risk_event_count_{s}s": ("risk", *between(s * scale)) for s in (30, 60)} | {f"high_impact_{s}s": ("impact", *between(s * scale)) for s in (60, 300)}
    frames |= {f"xt_sum_{s}s": ("xt", *between(s * scale)) for s in (60, 300)} | {"_ahead": ("impact", *between(60 * scale, "right", ahead=True)), "_square": ("square", *before)}
    values = {c: F.col(c) for c in ("n", "risk", "impact", "xt", "price", "square")}
    found = framed(marked, rows, key, us, values, frames, {"_p": ("price", *before)})
    ahead = extremes(marked, ticks, key, us, "price", *between(120 * scale, "right", ahead=True))
    # the price at each instant, and the change that the last price strictly before it made
    moments = marked.select(key, us).distinct()
    earlier = lambda df: df.withColumn(us, F.col(us) - 1)
    changes = backward(earlier(ticks.select(key, us, F.col("price").alias("_now"))), ticks, key, us, "price", us)
    changes = changes.select(key, (F.col(us) + 1).alias(us), (F.col("_now") - F.col("price")).alias("delta")).where("delta is not null")
    last = backward(earlier(moments), changes, key, us, "delta", us).select(key, (F.col(us) + 1).alias(us), "delta")
    priced = backward(moments, ticks, key, us, "price", us).select(key, us, F.col("price").alias("mid_price"))
    both = with_trend(marked, key, us, "event_id", "conf", 60 * scale, "conf_trend")
    for part in (found, ahead, last, priced):
        both = joined(both, part, key, us)
    n = F.col("_p_n")
    gated = lambda c: F.when(n >= 3, c).otherwise(F.lit(0.0))
    variance = F.col("_square") / n - (F.col("_p_sum") / n) * (F.col("_p_sum") / n)
    both = both.withColumns(
        {
            "price_velocity": gated(F.col("_p_slope")),
            "price_realized_vol": gated(F.sqrt(F.greatest(variance, F.lit(0.0)))),
            "price_change_1m": gated(F.col("delta")),
            "max_abs_move_120s": largest_move(F.col("low"), F.col("high"), F.col("mid_price")),
            "next_60s_high_impact": (F.col("_ahead") > 0).cast("int"),
        }
    )
    kept = both.where((F.col("mid_price") > low) & (F.col("mid_price") < high))
    conf = F.coalesce("conf", F.lit(0.5))
    kept = kept.withColumns(
        {
            "confidence_grade": conf,
            "high_volatility": absolute_label(F.col("max_abs_move_120s")),
            "xt_x_conf": F.col("xt_weight") * conf,
            "risk_density_ratio": F.col("risk_event_count_60s") / (F.col("event_density_60s") + 1),
            "pressure_score": F.col("xt_sum_60s") * conf,
            "price_extremeness": 2 * F.abs(F.col("mid_price") - 0.5),
        }
    )
    return kept.drop("risk", "delta", "conf", "low", "high", "_ahead", "_square", "_p_n", "_p_sum", "_p_slope")


def rolling_block(df: DataFrame, columns: dict[str, str], windows: tuple[int, ...] = (30, 60, 120), scale: float = 1.0, flags: dict[str, Column] | None = None) -> DataFrame:
    """df with features of the last seconds (t - w, t]: event_density, conf_mean (none: 0.5), conf_min (none: 1), weight_sum and a count for each flag.

    columns names the columns of `conf` and, if wanted, `weight`; flags are conditions, such as shots on target and dangerous attacks.
    """
    key, us, conf = "fixture_id", "us", columns["conf"]
    values = {"event_density": F.lit(1), "_conf": F.col(conf), "_known": F.col(conf).isNotNull().cast("int")}
    values |= {"weight_sum": F.col(columns["weight"])} if "weight" in columns else {}
    values |= {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in (flags or {}).items()}
    frames = {f"{n}_{w}s": (n, *between(w * scale, "right")) for n in values for w in windows}
    out = with_sums(df, key, us, values, frames)
    for w in windows:
        out = with_extremes(out, key, us, conf, *between(w * scale, "right"), f"conf_min_{w}s", f"_high_{w}s")
        out = out.withColumn(f"conf_mean_{w}s", F.when(F.col(f"_known_{w}s") > 0, F.col(f"_conf_{w}s").cast("double") / F.col(f"_known_{w}s")).otherwise(F.lit(0.5)))
        out = out.withColumn(f"conf_min_{w}s", F.coalesce(f"conf_min_{w}s", F.lit(1.0))).drop(f"_high_{w}s", f"_known_{w}s", f"_conf_{w}s")
    return out


def forward_std(events: DataFrame, prices: DataFrame, seconds: float) -> DataFrame:
    """events with price_std: the standard deviation (of a population) of their fixture's prices in the next seconds (t, t + w]; none: 0."""
    key, us = "fixture_id", "us"
    frame = between(seconds, "right", ahead=True)
    values = {"_n": F.col("price").isNotNull().cast("int"), "_p": F.col("price"), "_pp": F.col("price") * F.col("price")}
    found = framed(events, prices, key, us, values, {n: (n, *frame) for n in values})
    n, mean = F.col("_n"), F.col("_p") / F.col("_n")
    std = F.when(n > 0, F.sqrt(F.greatest(F.col("_pp") / n - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))
    return joined(events, found, key, us).withColumn("price_std", F.coalesce(std, F.lit(0.0))).drop("_n", "_p", "_pp")
