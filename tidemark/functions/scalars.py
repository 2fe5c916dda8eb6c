"""Scalar functions: parsing, buckets, weights, text normalisation. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C


def number(x: Column, default: float = 0.0) -> Column:
    """Lenient parse: what isn't a number becomes the default."""
    return F.coalesce(x.try_cast("double"), F.lit(float(default)))


def truncated(x: Column, default: int = 0) -> Column:
    """Lenient parse to a whole number, cut towards zero."""
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(default))


def timestamp(x: Column) -> Column:
    """Lenient parse; null where it fails."""
    return F.try_to_timestamp(x.cast("string"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def looked_up(x: Column, table: dict, default) -> Column:
    """table[x], or the default."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), x), F.lit(default))


def threat_weight(incident: Column, table: dict | None = None) -> Column:
    return looked_up(incident, table or C.THREAT_WEIGHT, C.THREAT_DEFAULT)


def event_weight(event_type: Column) -> Column:
    return looked_up(F.upper(event_type), C.EVENT_WEIGHT, C.EVENT_WEIGHT_DEFAULT)


def _among(x: Column, names) -> Column:
    return F.coalesce(x.isin(*names), F.lit(False))


def high_risk(incident: Column) -> Column:
    return _among(incident, C.HIGH_RISK)


def high_impact(incident: Column) -> Column:
    return _among(incident, C.HIGH_IMPACT)


def high_risk_event(event_type: Column) -> Column:
    """By the upper-cased event type."""
    return _among(F.upper(event_type), C.HIGH_RISK_EVENTS)


def canonical_incident(incident: Column) -> Column:
    return looked_up(incident, C.CANONICAL, "other")


def canonical_weight(incident: Column) -> Column:
    return looked_up(canonical_incident(incident), C.CANONICAL_WEIGHT, 0.1)


def contains_any(x: Column, words) -> Column:
    """Whether the lower-cased text holds any of the words; null: false."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(w)) for w in words]), F.lit(False))


def substring_weight(incident: Column, table=C.SUBSTRING_WEIGHT, default: float = C.SUBSTRING_DEFAULT) -> Column:
    """Weight of the first entry that the lower-cased text holds; null: 0."""
    out = F.when(incident.isNull(), F.lit(0.0))
    for word, weight in table:
        out = out.when(F.contains(F.lower(incident), F.lit(word)), F.lit(weight))
    return out.otherwise(F.lit(default))


def is_risk(incident: Column) -> Column:
    return contains_any(incident, C.RISK_SUBSTRINGS)


def bucket(x: Column, edges) -> Column:
    """Number of edges that x has reached: the first edge above x gives the bucket."""
    out = F.when(x < edges[0], F.lit(0))
    for i, edge in enumerate(edges[1:], 1):
        out = out.when(x < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def score_bucket(home: Column, away: Column) -> Column:
    """0..7; a draw is 4."""
    return bucket(home - away, C.SCORE_EDGES)


def time_bucket(minutes: Column) -> Column:
    return bucket(minutes, C.TIME_EDGES)


def volatility_grade(x: Column) -> Column:
    """0..5."""
    return bucket(x, C.VOLATILITY_EDGES)


def markov_state(home: Column, away: Column, period: Column, minutes: Column) -> Column:
    """struct(score, period, time); a missing score is 0, a missing or zero period 1."""
    return F.struct(
        score_bucket(F.coalesce(home, F.lit(0)), F.coalesce(away, F.lit(0))).alias("score"),
        F.coalesce(F.nullif(period, F.lit(0)), F.lit(1)).cast("int").alias("period"),
        time_bucket(F.coalesce(minutes, F.lit(0))).alias("time"),
    )


def threat_grid(x: Column, y: Column) -> Column:
    """Value of the pitch cell of a position in percent; a null x is 0."""
    flat = F.array(*(F.lit(v) for row in C.THREAT_GRID for v in row))
    xi = F.least((F.coalesce(x, F.lit(0.0)) / 100 * 12).cast("int"), F.lit(11))
    yi = F.least((F.coalesce(y, F.lit(0.0)) / 100 * 8).cast("int"), F.lit(7))
    return F.element_at(flat, xi * 8 + yi + 1)


def minutes_elapsed(seconds: Column) -> Column:
    return seconds / 60


def minutes_remaining(seconds: Column) -> Column:
    return F.greatest(F.lit(0), 5400 - seconds) / 60


def minutes_by_period(seconds: Column, period: Column) -> Column:
    """Minutes left, with the second half (20) offset by 45; half-even rounding."""
    played = F.when(period == 20, 45 + seconds / 60).otherwise(seconds / 60)
    return F.bround(F.greatest(F.lit(0.0), 90 - played), 2)


def game_intensity(goals: Column, minutes: Column) -> Column:
    return goals * (minutes / 90 + 0.01)


def intensity_per_minute(goals: Column, minutes: Column) -> Column:
    """Goals over minutes played, from the first one on."""
    return goals / (minutes + 1)


def intensity_of_match(goals: Column, minutes: Column) -> Column:
    """Goals weighted by the played share of 90 minutes."""
    return goals * minutes / 90


def win_probability(diff: Column, minutes_left: Column) -> Column:
    """Closed form from score difference and time."""
    factor = F.sqrt(F.greatest(minutes_left, F.lit(0.0)) / 90)
    return clip(0.5 + 0.12 * diff * (1 - factor * 0.3), 0.02, 0.98)


def mid_and_spread(bid: Column, ask: Column, no_bid: float | None = None, no_ask: float | None = None) -> tuple[Column, Column]:
    """Mid price and spread; defaults for a missing side are (0, 0), (0, 1) or none, by the data set's version."""
    bid = bid if no_bid is None else F.coalesce(bid, F.lit(no_bid))
    ask = ask if no_ask is None else F.coalesce(ask, F.lit(no_ask))
    return (bid + ask) / 2, ask - bid


def normalised_team(name: Column) -> Column:
    """Lower case without apostrophes, punctuation and words that say nothing."""
    x = F.regexp_replace(F.lower(name), "'", "")
    x = F.regexp_replace(x, "[^a-z0-9 ]", " ")
    x = F.regexp_replace(x, r"\b(" + "|".join(C.NOISE_TOKENS) + r")\b", "")
    return F.trim(F.regexp_replace(x, " +", " "))


def parsed_question(q: Column) -> Column:
    """struct(team_a, team_b, kind): "A vs. B: kind"; kind defaults to unknown, teams to null."""
    has_kind = F.contains(q, F.lit(": "))
    left = F.when(has_kind, F.regexp_extract(q, r"(?s)^(.*): (.*)$", 1)).otherwise(q)
    kind = F.when(has_kind, F.trim(F.regexp_extract(q, r"(?s)^(.*): (.*)$", 2))).otherwise(F.lit("unknown"))
    sep = F.when(F.contains(left, F.lit(" vs. ")), F.lit(" vs. ")).when(F.contains(left, F.lit(" vs ")), F.lit(" vs "))
    a = F.when(sep.isNotNull(), F.trim(F.substring(left, F.lit(1), F.instr(left, sep) - 1)))
    b = F.when(sep.isNotNull(), F.trim(F.substring(left, F.instr(left, sep) + F.length(sep), F.length(left))))
    return F.struct(a.alias("team_a"), b.alias("team_b"), kind.alias("kind"))


def strict_question(q: Column) -> Column:
    """struct(team_a, team_b, kind) of "A vs. B: kind", else nulls."""
    rx = r"^(.+?)\s+vs\.\s+(.+?):\s+(.+)$"
    part = lambda i: F.when(q.rlike(rx), F.trim(F.regexp_extract(q, rx, i)))
    return F.struct(part(1).alias("team_a"), part(2).alias("team_b"), part(3).alias("kind"))


def word_in_text(name: Column, text: Column) -> Column:
    """Whether the text holds any word of the name that is longer than three characters."""
    words = F.filter(F.split(F.lower(name), " "), lambda w: F.length(w) > 3)
    return F.exists(words, lambda w: F.contains(F.lower(text), w))


def include_exclude(text: Column, exclude: str, include: str) -> Column:
    """Two-stage classifier: not excluded, and included; null: false."""
    return F.coalesce(~text.rlike(exclude) & text.rlike(include), F.lit(False))


def strict_market(question: Column, clubs=(), excluded=C.OTHER_SPORTS) -> Column:
    """Whether a question is about a football match: no other sport's words, and a club, a general term, a win on a date, a low total or a draw.

    Clubs and competitions are a parameter; a null question is none.
    """
    return include_exclude(question, *market_patterns(clubs, excluded))


def market_patterns(clubs=(), excluded=C.OTHER_SPORTS) -> tuple[str, str]:
    """The patterns that exclude and include a question."""
    include = "|".join([*(rf"\b(?:{c})" for c in clubs), *(rf"\b(?:{t})\b" for t in C.FOOTBALL_TERMS), C.WIN_ON_DATE, r"O/U [0-5]\.[05]", r"end in a draw|win or draw|draw\?|draw\b"])
    return "(?i)" + "|".join(excluded), "(?i)" + include


def major_league(name: Column, leagues=C.MAJOR_LEAGUES) -> Column:
    """Whether a league's name holds one of the leagues, in any case."""
    return contains_any(name, [x.lower() for x in leagues])


def date_part(x: Column) -> Column:
    """The date of yyyy-MM-ddTHH."""
    return F.substring(x, 1, 10)


def hour_part(x: Column, default: str = "18") -> Column:
    """The hour of yyyy-MM-ddTHH, or a default if there is none."""
    return F.when(F.length(x) > 10, F.substring(x, 12, 2)).otherwise(F.lit(default))


def days_apart(a: Column, b: Column) -> Column:
    """Days between two dates, in either order."""
    return F.abs(F.date_diff(a, b))


def renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """df with column names in lower case, and an alias renamed where its target is missing."""
    df = df.toDF(*(c.lower() for c in df.columns))
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def first_timestamp(df: DataFrame, names=("timestamp", "createdat", "updatedat", "time"), default: str = "2024-01-01") -> DataFrame:
    """df with timestamp parsed from the first of the columns that it has, or a default; rows where that fails go."""
    name = next((n for n in names if n in df.columns), None)
    parsed = timestamp(F.col(name)) if name else F.lit(default).cast("timestamp")
    return df.withColumn("timestamp", parsed).where("timestamp is not null")


def binned(df: DataFrame, column: str, bins: int = 10, into: str = "bin") -> DataFrame:
    """df with the equal-width bin of a column over its observed range; right-closed, the minimum is in bin 0.

    One value throughout goes to the middle bin. The range is one row, joined back by broadcast.
    """
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.greatest(F.lit(0), F.ceil((F.col(column) - F.col("_lo")) / width).cast("int") - 1)
    out = df.crossJoin(F.broadcast(span))
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit((bins - 1) // 2)).otherwise(F.least(at, F.lit(bins - 1)))
    return out.withColumn(into, F.when(F.col(column).isNotNull(), at)).drop("_lo", "_hi")


def hour_range(ts: Column, before: int = 1, after: int = 2) -> Column:
    """Array of hour strings from `before` hours before to `after` hours after."""
    hours = F.sequence(ts - F.make_dt_interval(hours=F.lit(before)), ts + F.make_dt_interval(hours=F.lit(after)), F.expr("interval 1 hour"))
    return F.transform(hours, lambda h: F.date_format(h, "yyyy-MM-dd'T'HH"))


def market_key(market: Column) -> Column:
    """Hex id without 0x, lower case, its first 32 characters."""
    return F.substring(F.lower(F.regexp_replace(market, "^0x", "")), 1, 32)


def with_defaults(df: DataFrame, **columns: Column) -> DataFrame:
    """Add each column that df hasn't."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})
