"""Dashboard queries over scored events: fixture_id, ts (TIMESTAMP), us (LONG), mid_price, prob, label, predicted, incident, weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binned
from .frames import framed, joined
from .quantiles import quantiles
from .windows import SECOND, past, sessions


RANGES = 256


def dataset_summary(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Rows, fixtures and rate of the label; with metrics(model, f1) also the best model and its F1 (the smaller name wins ties)."""
    out = df.agg(F.count("*").alias("n"), F.countDistinct("fixture_id").alias("fixtures"), F.avg("label").alias("label_rate"))
    if metrics is None:
        return out
    best = metrics.agg(F.min(F.struct((-F.col("f1")).alias("_f"), "model")).alias("b"))
    return out.crossJoin(F.broadcast(best.select(F.col("b.model").alias("best_model"), (-F.col("b._f")).alias("best_f1"))))


def fixture_list(df: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row a fixture; with meta(fixture_id, home, away, league) also those, "?" where they are unknown."""
    out = df.groupBy("fixture_id").agg(
        F.count("*").alias("n"), F.avg("label").alias("vol_rate"), F.min("mid_price").alias("price_min"), F.max("mid_price").alias("price_max"),
        (F.max("mid_price") - F.min("mid_price")).alias("price_range"), F.max("prob").alias("max_prob"),
    )
    if meta is None:
        return out
    known = [c for c in meta.columns if c != "fixture_id"]
    return out.join(meta, "fixture_id", "left").withColumns({c: F.coalesce(c, F.lit("?")) for c in known})


def minute_line(df: DataFrame, *keys: str, fixture: int | None = None) -> DataFrame:
    """By minute (and keys); of one fixture only, if one is named."""
    df = df if fixture is None else df.where(F.col("fixture_id") == fixture)
    return df.groupBy(*keys, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.avg("mid_price").alias("price"), F.avg("prob").alias("mean_prob"), F.max("prob").alias("max_prob"), F.avg("label").alias("vol_rate"), F.count("*").alias("n")
    )


def incident_stats(df: DataFrame, least: int = 50, top: int = 20) -> DataFrame:
    stats = df.groupBy("incident").agg(
        F.avg("label").alias("vol_rate"), F.avg("predicted").alias("pred_rate"), F.avg("prob").alias("mean_prob"), F.count("*").alias("n"), F.avg("weight").alias("mean_weight")
    )
    return stats.where(F.col("n") >= least).orderBy(F.desc("vol_rate"), "incident").limit(top)


def confusion(df: DataFrame) -> DataFrame:
    of = lambda p, y: F.count_if((F.col("predicted") == p) & (F.col("label") == y))
    return df.agg(of(1, 1).alias("tp"), of(1, 0).alias("fp"), of(0, 1).alias("fn"), of(0, 0).alias("tn"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    return binned(df, "prob", bins).groupBy("bin").agg(F.avg("prob").alias("mean_prob"), F.avg("label").alias("vol_rate"), F.count("*").alias("n"))


def lead_means(df: DataFrame, leads: tuple[int, ...], move: float = 0.08, scale: float = 1.0, half: bool = False) -> DataFrame:
    """For each big move and lead: mean probability of its fixture's rows in [t - lead, t), or with half in [t - lead, t - lead // 2).

    All leads are frames of the same running sums, asked for by the big moves alone: no self-join.
    """
    frames = {}
    for lead in leads:
        ends = -int(lead * scale * SECOND) - 1, (-int((lead // 2) * scale * SECOND) if half else 0) - 1
        frames |= {f"s{lead}": ("prob", *ends), f"n{lead}": ("known", *ends)}
    big = df.where(F.col("move") > move).select("fixture_id", "event_id", "us")
    found = framed(big, df, "fixture_id", "us", {"prob": F.col("prob"), "known": F.col("prob").isNotNull().cast("int")}, frames)
    rows = joined(big, found, "fixture_id", "us")
    mean = lambda lead: F.when(F.col(f"n{lead}") > 0, F.col(f"s{lead}") / F.col(f"n{lead}"))
    pairs = F.array(*(F.struct(F.lit(lead).alias("lead"), mean(lead).alias("mean_prob")) for lead in leads))
    return rows.select("fixture_id", "event_id", F.inline(pairs)).where("mean_prob is not null")


def advance_warning(df: DataFrame, leads: tuple[int, ...], **how) -> DataFrame:
    """By lead: mean, exact median and number of the moves' means."""
    means = lead_means(df, leads, **how)
    middle = quantiles(means, "mean_prob", {"median": 0.5}, "lead", splits=[i / 256 for i in range(1, 256)])
    return means.groupBy("lead").agg(F.avg("mean_prob").alias("mean"), F.count("*").alias("n")).join(middle, "lead").select("lead", "mean", "median", "n")


def warning_by_fixture(df: DataFrame, leads: tuple[int, ...], **how) -> DataFrame:
    return lead_means(df, leads, half=True, **how).groupBy("fixture_id", "lead").agg(F.avg("mean_prob").alias("mean_prob"))


def move_sessions(df: DataFrame, gap_seconds: float = 120, move: float = 0.08) -> DataFrame:
    """Runs of big moves, a new one after a gap longer than gap_seconds."""
    big = sessions(df.where(F.col("move") > move), "fixture_id", "us", int(gap_seconds * SECOND), "event_id")
    return big.groupBy("fixture_id", "session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.max("move").alias("max_move")
    )


def hit_or_miss(df: DataFrame, threshold: float = 0.52) -> DataFrame:
    """Per fixture: minutes that were warned of and moved, missed, or were false alarms.

    A minute's probabilities are added one after the other in order of event_id: floating sums depend on the order, and a mean can lie at the threshold.
    """
    upto = Window.partitionBy("fixture_id", "minute").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("fixture_id", F.date_trunc("minute", "ts").alias("minute"), "event_id", "prob", "label")
    rows = rows.withColumns({"_sum": F.sum("prob").over(upto), "_at": F.count("*").over(upto)})
    mean = F.try_divide(F.max_by("_sum", "_at"), F.count("prob"))
    m = rows.groupBy("fixture_id", "minute").agg(mean.alias("mean_prob"), F.avg("label").alias("vol_rate"))
    warned, moved = F.col("mean_prob") >= threshold, F.col("vol_rate") > 0.5
    return m.groupBy("fixture_id").agg(
        F.count_if(warned & moved).alias("hits"), F.count_if(~warned & moved).alias("misses"), F.count_if(warned & ~moved).alias("false_alarms")
    )


def markers(df: DataFrame, noise: tuple[str, ...], sample: int = 100, seed: int = 42) -> DataFrame:
    """Events that aren't noise: of each fixture all of weight 2 or more, and a seeded sample of the rest (the first `sample` in order of hash and id).

    Hashes are counted by fixture and their first 10 bits; running counts tell in which of those parts a fixture's sample ends, and only that
    part (a thousandth of the fixture) is ranked. Repeats of a row are all in or out. A null weight is below 2; null incidents aren't noise.
    """
    kept = df.where(F.col("incident").isNull() | ~F.col("incident").isin(*noise)).withColumn("_h", id_hash("event_id", seed))
    light = F.coalesce(F.col("weight") < 2, F.lit(True))
    rest = kept.where(light).select("fixture_id", "event_id", "_h", F.shiftright("_h", 50).alias("_part"))
    upto = Window.partitionBy("fixture_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    counts = rest.groupBy("fixture_id", "_part").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    ends = counts.where((F.col("_upto") >= sample) & (F.col("_upto") - F.col("_n") < sample))
    ends = ends.select(F.col("fixture_id").alias("_f"), F.col("_part").alias("_p"), (sample - F.col("_upto") + F.col("_n")).alias("_left"))
    last = rest.join(ends, F.col("fixture_id").eqNullSafe(F.col("_f")) & (F.col("_part") == F.col("_p")))
    ranked = last.withColumn("_r", F.row_number().over(Window.partitionBy("_f", "_p").orderBy("_h", "event_id"))).where("_r = _left")
    bounds = ranked.select("_f", F.struct("_h", "event_id").alias("_end"))
    # a fixture of fewer rows has no bound
    rows = kept.join(bounds, F.col("fixture_id").eqNullSafe(F.col("_f")), "left")
    return rows.where(~light | F.col("_end").isNull() | (F.struct("_h", "event_id") <= F.col("_end"))).select(*df.columns)


def id_hash(column: str, seed: int) -> Column:
    """60 bits of the MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string"))), 1, 15), 16, 10).cast("long")


def threshold_sweep(df: DataFrame, low: float = 0.1, step: float = 0.02, n: int = 40) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 for n thresholds.

    Rows are first counted by the last threshold that they reach; running sums over those n rows
    give all thresholds, so rows aren't multiplied by n.
    """
    # thresholds are numbers of two digits; a score counts for those that it reaches as they are
    grid_at = lambda i: F.round(low + i * step, 2)
    near = F.floor((F.col("prob") - low) / step)
    at = F.coalesce(*(F.when(F.col("prob") >= grid_at(near + d), near + d) for d in (1, 0)), near - 1)
    at = F.least(at, F.lit(n - 1)).cast("int")
    counts = df.groupBy(at.alias("i")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    all_rows = counts.agg(F.sum("pos").alias("all_pos"))
    table = grid.join(counts, "i", "left").na.fill(0, ["pos", "n"])
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    t = table.select("i", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("said")).crossJoin(F.broadcast(all_rows))
    p = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "all_pos"), F.lit(0.0))
    return t.select(
        F.round(low + F.col("i") * step, 2).alias("threshold"), "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
    )


def ranking_metrics(df: DataFrame) -> DataFrame:
    """roc_auc (average ranks for ties; null without both classes) and average_precision (null without positives), from counts by distinct score.

    A score's range follows from its value (RANGES even parts of 0 to 1, what lies beyond in the outer ones); running sums go
    inside each range, and one row a range carries on the sums between them.
    """
    by = df.groupBy(F.col("prob").alias("s")).agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
    by = by.withColumn("part", F.least(F.greatest(F.floor(F.col("s") * RANGES), F.lit(0)), F.lit(RANGES - 1)))
    rest = by.groupBy("part").agg(F.min("s").alias("at"), F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    before, beyond = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rest = rest.select("part", zero(F.sum("all_q").over(before)).alias("q0"), zero(F.sum("all_p").over(beyond)).alias("p1"), zero(F.sum("all_q").over(beyond)).alias("q1"))
    up = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    t = by.withColumns({"below": zero(F.sum("q").over(up)), "tp": F.sum("p").over(down), "fp": F.sum("q").over(down)}).join(F.broadcast(rest), "part")
    below, tp, fp = F.col("below") + F.col("q0"), F.col("tp") + F.col("p1"), F.col("fp") + F.col("q1")
    return t.agg(
        F.try_divide(F.sum(F.col("p") * (below + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("p") * tp / (tp + fp)), F.sum("p")).alias("average_precision"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share by value, nulls included."""
    total = df.agg(F.count("*").alias("_all"))
    by = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))


def described(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles and max of a column, as one row."""
    plain = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    middle = quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.crossJoin(F.broadcast(middle)).select("count", "mean", "std", "min", "q1", "median", "q3", "max")


def series_quality(prices: DataFrame, keys: list[str], series: str) -> DataFrame:
    """The best series by key: n (1 - 2 |mean - .5|) with .05 < mean < .95; the first wins ties."""
    by = prices.groupBy(*keys, series).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"))
    by = by.where("mean_price > 0.05 and mean_price < 0.95").withColumn("quality", F.col("n") * (1 - 2 * F.abs(F.col("mean_price") - 0.5)))
    return by.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), series))).where("_r = 1").drop("_r")


def longest_series(prices: DataFrame, key: str, series: str) -> DataFrame:
    """By key the series of the most prices among those with .05 < mean < .95; the first wins ties."""
    by = prices.groupBy(key, series).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")).where("mean_price > 0.05 and mean_price < 0.95")
    return by.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), series))).where("_r = 1").drop("_r")


def first_usable(candidates: DataFrame, prices: DataFrame, key: str, ordinal: str, source: str, least: int = 5) -> DataFrame:
    """By key the first source, by ordinal, that has more than `least` prices: key, source, n."""
    n = prices.groupBy(source).agg(F.count("*").alias("n")).where(F.col("n") > least)
    fit = candidates.join(n, source)
    return fit.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(ordinal, source))).where("_r = 1").select(key, source, "n")


def within_prices(events: DataFrame, prices: DataFrame, key: str, order: str, before: int = 0, after: int = 0) -> DataFrame:
    """The events from `before` ahead of their key's first price to `after` past its last."""
    span = prices.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    return events.join(span, key).where((F.col(order) >= F.col("_lo") - before) & (F.col(order) <= F.col("_hi") + after)).drop("_lo", "_hi")


def preferred(df: DataFrame, last: Column, order: list, n: int) -> DataFrame:
    """The first n rows by order, with those where `last` holds (null: it doesn't) after all others."""
    return df.orderBy(F.coalesce(last, F.lit(False)), *order).limit(n)


def yes_series(prices: DataFrame, key: str, series: str, order: str) -> DataFrame:
    """By key the series with the highest first price; the smaller name wins ties."""
    first = prices.groupBy(key, series).agg(F.min_by("price", order).alias("first_price"))
    best = F.max_by(F.struct(series, "first_price"), F.struct("first_price", -F.col(series)))
    return first.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def recent(df: DataFrame, seconds: float, closed: str = "both") -> DataFrame:
    """df with the number of its fixture's rows in the last seconds."""
    return df.withColumn("density", F.count("*").over(past("fixture_id", "us", seconds, closed)))
