"""Markov chain over states: counts, transitions, expected prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state_values(rows: DataFrame, state: str = "state", win: str = "win") -> DataFrame:
    """state, visits, wins, win_prob."""
    return rows.groupBy(state).agg(F.count("*").alias("visits"), F.sum(win).alias("wins"), F.avg(win).alias("win_prob"))


def transitions(rows: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """state, next_state, n, p: row-normalised counts of consecutive states of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = rows.withColumn("next_state", F.lead(state).over(w)).where("next_state is not null")
    counts = pairs.groupBy(state, "next_state").agg(F.count("*").alias("n"))
    total = counts.groupBy(state).agg(F.sum("n").alias("total"))
    return counts.join(total, state).withColumn("p", F.col("n") / F.col("total")).drop("total")


def expected(values: DataFrame, moves: DataFrame, state: str = "state") -> DataFrame:
    """state, expected, delta, volatility: mean and weighted variance of the next state's value; an unseen one counts .5.

    A state without successors expects its own value, with delta and volatility 0.
    """
    nxt = values.select(F.col(state).alias("next_state"), F.col("win_prob").alias("w"))
    joined = moves.join(nxt, "next_state", "left").withColumn("w", F.coalesce("w", F.lit(0.5)))
    sums = joined.groupBy(state).agg(F.sum(F.col("p") * F.col("w")).alias("m"), F.sum(F.col("p") * F.col("w") * F.col("w")).alias("m2"))
    out = values.join(sums, state, "left")
    mean = F.coalesce("m", "win_prob")
    return out.select(
        state, mean.alias("expected"), F.abs(mean - F.col("win_prob")).alias("delta"),
        F.coalesce(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)), F.lit(0.0)).alias("volatility"),
    )


def summary(values: DataFrame, moves: DataFrame) -> DataFrame:
    a = values.agg(F.count("*").alias("n_states"), F.avg("win_prob").alias("mean_win_prob"))
    return a.crossJoin(moves.agg(F.count("*").alias("n_transitions")))


def features(rows: DataFrame, values: DataFrame, moves: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """rows with win_prob, delta, volatility of their state, and first and second differences of win_prob within the key."""
    table = values.select(state, "win_prob").join(expected(values, moves, state), state)
    out = rows.join(table, state, "left").withColumn("win_prob", F.coalesce("win_prob", F.lit(0.5)))
    w = Window.partitionBy(key).orderBy(*order)
    out = out.withColumn("d1", F.coalesce(F.col("win_prob") - F.lag("win_prob").over(w), F.lit(0.0)))
    return out.withColumn("d2", F.coalesce(F.col("d1") - F.lag("d1").over(w), F.lit(0.0)))


def with_analytic(rows: DataFrame) -> DataFrame:
    """rows(score, period, time) with win_prob by the closed form; a state that it doesn't know counts .5."""
    table = analytic_table(rows.sparkSession)
    return rows.join(F.broadcast(table), ["score", "period", "time"], "left").withColumn("win_prob", F.coalesce("win_prob", F.lit(0.5)))


def analytic_table(spark) -> DataFrame:
    """Closed-form fallback: score 0..6, period 1..3, time 0..5."""
    grid = spark.range(7).select(F.col("id").cast("int").alias("score"))
    grid = grid.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return grid.withColumn("win_prob", 0.5 + (F.col("score") - 2) * 0.12)


def simulated_prices(rows: DataFrame, key: str, order: list[str], seed: int = 42) -> DataFrame:
    """rows(win_prob) with simulated_price: 0.7 of the probability three events before (.5 at first), 0.3 of the present one, and normal noise of .02 by hash."""
    w = Window.partitionBy(key).orderBy(*order)
    u = lambda what: (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key, *order), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = 0.02 * F.sqrt(-2 * F.log(u("a"))) * F.cos(6.283185307179586 * u("b"))
    lagged = F.coalesce(F.lag("win_prob", 3).over(w), F.lit(0.5))
    return rows.withColumns({"market_base": 0.7 * lagged + 0.3 * F.col("win_prob"), "simulated_price": F.least(F.greatest(0.7 * lagged + 0.3 * F.col("win_prob") + noise, F.lit(0.01)), F.lit(0.99))})


def save(values: DataFrame, moves: DataFrame, path: str) -> None:
    """Keep a chain as two Parquet tables."""
    values.write.mode("overwrite").parquet(f"{path}/values")
    moves.write.mode("overwrite").parquet(f"{path}/moves")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(values, moves) of a chain that save() kept."""
    return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/moves")
