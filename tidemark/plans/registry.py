"""Queries of the engine's own operators over the driver's tables, and the SQL that each must equal.

Stand-ins: a fixture is user_id % 50, an incident an event_type, confidence k / 100 of props, and a
price comes from view events as value / (value + 35). Window lengths are scaled by SCALE (30 s
become 6 h), as the events table is sparse.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import asof, frames, labels, markov, match, ml, stores
from ..operators import windows as W
from ..operators.features import feature_row, forward_std, game_state, rolling_block
from ..sources import readers, sinks, synthetic

SCALE = 720
LEADS = (15, 30, 60, 90, 120)
SPLIT = {"train": 0.56, "middle": 0.14}
WEIGHT = {"purchase": 5.0, "error": 4.0, "signup": 1.5, "click": 0.4, "view": 0.0}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # adding zero turns -0.0 into 0.0
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# ---- stand-ins ---------------------------------------------------------------------------------

M = """m AS (SELECT event_id, user_id % 50 AS fixture_id, epoch_us(ts) AS us, ts, event_type AS incident, value,
  CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS conf,
  CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'error' THEN 4.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 0.4 ELSE 0.2 END AS weight,
  CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN 1 ELSE 0 END AS risk,
  CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS impact
  FROM events WHERE event_type <> 'view')"""
P = "p AS (SELECT event_id, user_id % 50 AS fixture_id, user_id AS token, epoch_us(ts) AS us, value / (value + 35) AS price FROM events WHERE event_type = 'view')"
_H = "CAST(('0x' || substr(md5('42:' || {0}), 1, 15)) AS BIGINT)"
#: scored events: a price-like value, a probability and a label that follow from the row alone
G = """g AS (SELECT event_id, user_id % 50 AS fixture_id, ts, epoch_us(ts) AS us, event_type AS incident, value / (value + 35) AS mid_price,
  CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS prob, CASE WHEN value > 40 THEN 1 ELSE 0 END AS label,
  CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 >= 0.5 THEN 1 ELSE 0 END AS predicted, value / 1000 AS move,
  CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'error' THEN 4.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.0 ELSE 0.2 END AS weight
  FROM events)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = readers.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select("event_id", (F.col("user_id") % 50).alias("fixture_id"), "user_id", S.micros(F.col("ts")).alias("us"), "ts", F.col("event_type").alias("incident"), "value", k.alias("conf"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    m = _events(spark, sf).where("incident <> 'view'").drop("user_id")
    return m.withColumns({
        "weight": S.threat_weight(F.col("incident"), WEIGHT), "risk": F.col("incident").isin("purchase", "error", "signup").cast("int"),
        "impact": F.col("incident").isin("purchase", "error").cast("int"),
    })


def _decimal_conf(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose confidences, of few digits, are summed as decimals, so that means halfway between two rounded numbers are right."""
    return _messages(spark, sf).withColumn("conf", F.col("conf").cast("decimal(18,6)"))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    p = _events(spark, sf).where("incident = 'view'")
    return p.select("event_id", "fixture_id", F.col("user_id").alias("token"), "us", (F.col("value") / (F.col("value") + 35)).alias("price"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return e.select(
        "event_id", "fixture_id", F.col("ts").cast("timestamp").alias("ts"), "us", "incident", (F.col("value") / (F.col("value") + 35)).alias("mid_price"), F.col("conf").alias("prob"),
        (F.col("value") > 40).cast("int").alias("label"), (F.col("conf") >= 0.5).cast("int").alias("predicted"), (F.col("value") / 1000).alias("move"), S.threat_weight(F.col("incident"), WEIGHT).alias("weight"),
    )


def _frame(seconds: float, closed: str = "both") -> tuple[int, int]:
    return frames.between(seconds * SCALE, closed)


def _summed(df: DataFrame, values: dict, asked: dict) -> DataFrame:
    return frames.with_sums(df, "fixture_id", "us", values, asked).select("event_id", *asked)


def _sql_past(seconds: int, closed: str = "both") -> str:
    w = seconds * SCALE * 1_000_000
    lo, hi = {"both": (w, "CURRENT ROW"), "left": (w, "1 PRECEDING"), "right": (w - 1, "CURRENT ROW")}[closed]
    return f"(PARTITION BY fixture_id ORDER BY us RANGE BETWEEN {lo} PRECEDING AND {hi})"


def _sql_future(seconds: int) -> str:
    return f"(PARTITION BY fixture_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {seconds * SCALE * 1_000_000} FOLLOWING)"


# ---- windows -----------------------------------------------------------------------------------


@query(f"WITH {M} SELECT event_id, " + ", ".join(f"count(*) OVER {_sql_past(s)} AS density_{s}s, count(*) OVER {_sql_past(s, 'left')} AS before_{s}s" for s in (30, 60, 120, 300)) + " FROM m")
def event_density_range(spark, sf):
    both = {f"density_{s}s": ("n", *_frame(s)) for s in (30, 60, 120, 300)} | {f"before_{s}s": ("n", *_frame(s, "left")) for s in (30, 60, 120, 300)}
    return _summed(_messages(spark, sf), {"n": F.lit(1)}, both)


@query(f"WITH {M} SELECT event_id, CAST(sum(risk) OVER {_sql_past(30)} AS BIGINT) AS risk_30s, CAST(coalesce(sum(risk) OVER {_sql_past(60, 'left')}, 0) AS BIGINT) AS risk_60s FROM m")
def risk_count_range(spark, sf):
    return _summed(_messages(spark, sf), {"risk": F.col("risk")}, {"risk_30s": ("risk", *_frame(30)), "risk_60s": ("risk", *_frame(60, "left"))})


@query(f"WITH {M} SELECT event_id, CAST(sum(impact) OVER {_sql_past(60)} AS BIGINT) AS impact_60s, CAST(sum(impact) OVER {_sql_past(300)} AS BIGINT) AS impact_300s FROM m")
def high_impact_range(spark, sf):
    return _summed(_messages(spark, sf), {"impact": F.col("impact")}, {f"impact_{s}s": ("impact", *_frame(s)) for s in (60, 300)})


@query(f"WITH {M} SELECT event_id, round(sum(weight) OVER {_sql_past(60)}, 6) AS xt_60s, round(sum(weight) OVER {_sql_past(300)}, 6) AS xt_300s FROM m")
def xt_sum_range(spark, sf):
    df = _summed(_messages(spark, sf), {"weight": F.col("weight")}, {f"xt_{s}s": ("weight", *_frame(s)) for s in (60, 300)})
    return _r(df, "xt_60s", "xt_300s")


@query(f"WITH {M} SELECT event_id, round(coalesce(avg(conf) OVER {_sql_past(60, 'right')}, 0.5), 6) AS conf_mean, coalesce(min(conf) OVER {_sql_past(60, 'right')}, 1.0) AS conf_min FROM m")
def conf_mean_min(spark, sf):
    df = rolling_block(_decimal_conf(spark, sf), {"conf": "conf"}, (60,), SCALE)
    return _r(df.select("event_id", F.col("conf_mean_60s").alias("conf_mean"), F.col("conf_min_60s").cast("double").alias("conf_min")), "conf_mean")


def _sql_block() -> str:
    part = lambda w: f"(PARTITION BY fixture_id ORDER BY us RANGE BETWEEN {w * SCALE * 1_000_000 - 1} PRECEDING AND CURRENT ROW)"
    columns = [
        f"""count(*) OVER {part(w)} AS event_density_{w}s, round(sum(weight) OVER {part(w)}, 6) AS weight_sum_{w}s, round(coalesce(CAST(sum(CAST(conf AS DECIMAL(18, 6))) OVER {part(w)} AS DOUBLE) / count(conf) OVER {part(w)}, 0.5), 6) AS conf_mean_{w}s,
  coalesce(min(conf) OVER {part(w)}, 1.0) AS conf_min_{w}s, CAST(sum(CASE WHEN incident = 'purchase' THEN 1 ELSE 0 END) OVER {part(w)} AS BIGINT) AS shot_on_target_{w}s,
  CAST(sum(CASE WHEN incident = 'error' THEN 1 ELSE 0 END) OVER {part(w)} AS BIGINT) AS dangerous_attack_{w}s"""
        for w in (30, 60, 120)
    ]
    return f"WITH {M} SELECT event_id, {', '.join(columns)} FROM m"


@query(_sql_block())
def rolling_features(spark, sf):
    flags = {"shot_on_target": F.col("incident") == "purchase", "dangerous_attack": F.col("incident") == "error"}
    df = rolling_block(_decimal_conf(spark, sf), {"conf": "conf", "weight": "weight"}, (30, 60, 120), SCALE, flags)
    df = df.withColumns({f"conf_min_{w}s": F.col(f"conf_min_{w}s").cast("double") for w in (30, 60, 120)})
    names = [f"{n}_{w}s" for w in (30, 60, 120) for n in ("event_density", "weight_sum", "conf_mean", "conf_min", *flags)]
    return _r(df.select("event_id", *names), *(n for n in names if n.startswith(("weight", "conf_mean"))))


@query(f"""WITH {M}, {P}, u AS (SELECT event_id, fixture_id, us, NULL AS price FROM m UNION ALL SELECT NULL, fixture_id, us, price FROM p),
w AS (SELECT *, stddev_pop(price) OVER {_sql_future(120)} AS sd FROM u) SELECT event_id, round(coalesce(sd, 0), 6) AS price_std FROM w WHERE event_id IS NOT NULL""")
def forward_price_std(spark, sf):
    return _r(forward_std(_messages(spark, sf), _prices(spark, sf), 120 * SCALE).select("event_id", "price_std"), "price_std")


@query(f"""WITH {M}, l AS (SELECT event_id, list_sort(list(struct_pack(us := us, id := event_id, c := conf)) OVER {_sql_past(60)}) AS l FROM m),
k AS (SELECT event_id, list_transform(l[greatest(len(l) - 4, 1):len(l)], lambda x: x.c) AS y FROM l),
n AS (SELECT event_id, y, len(y)::DOUBLE AS n FROM k)
SELECT event_id, round(CASE WHEN n >= 2 THEN (n * list_sum(list_transform(y, lambda v, i: v * (i - 1))) - n * (n - 1) / 2 * list_sum(y))
  / (n * ((n - 1) * n * (2 * n - 1) / 6) - (n * (n - 1) / 2) * (n * (n - 1) / 2)) ELSE 0 END, 6) + 0::DOUBLE AS conf_trend FROM n""")
def conf_trend_last5(spark, sf):
    df = W.with_trend(_messages(spark, sf), "fixture_id", "us", "event_id", "conf", 60 * SCALE, "conf_trend")
    return _r(df.select("event_id", "conf_trend"), "conf_trend")


@query(f"WITH {M} SELECT event_id, round(conf - coalesce(avg(conf) OVER (PARTITION BY fixture_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), conf), 6) + 0::DOUBLE AS conf_step FROM m")
def conf_trend_rows(spark, sf):
    w = Window.partitionBy("fixture_id").orderBy("us", "event_id").rowsBetween(-3, -1)
    return _r(_messages(spark, sf).select("event_id", (F.col("conf") - F.coalesce(F.avg("conf").over(w), F.col("conf"))).alias("conf_step")), "conf_step")


# ---- as-of joins -------------------------------------------------------------------------------


@query(f"WITH {M}, {P} SELECT m.event_id, p.price, p.us AS price_at FROM m ASOF LEFT JOIN p ON m.fixture_id = p.fixture_id AND m.us >= p.us")
def price_asof_backward(spark, sf):
    return asof.backward(_messages(spark, sf), _prices(spark, sf), "fixture_id", "us", "price", "event_id").select("event_id", "price", "price_at")


@query(f"""WITH {M}, {P}, a AS (SELECT m.event_id, m.us, m.fixture_id, p.price AS pa, p.us AS ta FROM m ASOF LEFT JOIN p ON m.fixture_id = p.fixture_id AND m.us >= p.us),
b AS (SELECT a.*, p.price AS pb, p.us AS tb FROM a ASOF LEFT JOIN p ON a.fixture_id = p.fixture_id AND a.us <= p.us)
SELECT event_id, CASE WHEN pb IS NULL OR us - ta <= tb - us THEN CASE WHEN us - ta <= {300 * SCALE * 1000000} THEN pa END
  ELSE CASE WHEN tb - us <= {300 * SCALE * 1000000} THEN pb END END AS price FROM b""")
def price_asof_nearest_tol(spark, sf):
    return asof.nearest(_messages(spark, sf), _prices(spark, sf), "fixture_id", "us", "price", "event_id", 300 * SCALE).select("event_id", "price")


@query(f"WITH {M} SELECT event_id, coalesce(last_value(CASE WHEN incident = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY fixture_id ORDER BY us, event_id), 0.0) AS carried_value FROM m")
def score_carry_forward(spark, sf):
    return asof.carried(_messages(spark, sf), "fixture_id", "us", "event_id", "value", "incident = 'purchase'", 0.0).select("event_id", "carried_value")


_U = f"""{M}, {P}, q AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY us) AS ordinal, price - lag(price) OVER (PARTITION BY fixture_id ORDER BY us) AS delta FROM p),
u AS (SELECT event_id, fixture_id, us, conf, weight, risk, impact, 1 AS is_event, NULL AS price, NULL AS ordinal, NULL AS delta, incident FROM m
  UNION ALL SELECT event_id, fixture_id, us, NULL, NULL, NULL, NULL, NULL, price, ordinal, delta, NULL FROM q),
w AS (SELECT *, count(price) OVER {_sql_past(300, 'left')} AS np, regr_slope(price, ordinal) OVER {_sql_past(300, 'left')} AS slope, stddev_pop(price) OVER {_sql_past(300, 'left')} AS sd,
  last_value(delta IGNORE NULLS) OVER {_sql_past(300, 'left')} AS dl, max(price) OVER {_sql_future(120)} AS hi, min(price) OVER {_sql_future(120)} AS lo,
  max(impact) OVER {_sql_future(60)} AS ahead FROM u),
a AS (SELECT m.event_id, p.price AS mid_price FROM m ASOF LEFT JOIN p ON m.fixture_id = p.fixture_id AND m.us >= p.us),
f AS (SELECT w.*, a.mid_price, coalesce(greatest(abs(hi - a.mid_price), abs(lo - a.mid_price)), 0.0) AS move FROM w JOIN a USING (event_id) WHERE is_event = 1 AND a.mid_price > 0.02 AND a.mid_price < 0.98)"""


#: stand-ins of the game's values: texts that follow from event_id, some of which can't be parsed
STATE = {
    "home_value": "cast(event_id % 4 as string)", "away_value": "case when event_id % 11 = 0 then 'x' else cast(event_id % 3 as string) end",
    "seconds": "cast(event_id % 6000 as string)", "period_id": "case when event_id % 7 = 0 then null else '20' end",
}
GS = """gs AS (SELECT event_id, CAST(event_id % 4 AS DOUBLE) AS h, CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(event_id % 3 AS DOUBLE) END AS w, CAST(event_id % 6000 AS DOUBLE) AS s,
  CASE WHEN event_id % 7 = 0 THEN 10.0 ELSE 20.0 END::DOUBLE AS period_id, event_type = 'click' AS timer FROM events),
st AS (SELECT event_id, CAST(h - w AS INTEGER) AS score_diff, CAST(h + w AS INTEGER) AS total_goals, round(s / 60, 6) AS minutes_elapsed, round(greatest(0, 5400 - s) / 60, 6) AS minutes_remaining,
  period_id, CAST(h > w AS INTEGER) AS is_leading, CAST(h = w AS INTEGER) AS is_drawing, CAST(h < w AS INTEGER) AS is_trailing, round((h + w) * (s / 60 / 90 + 0.01), 6) AS game_intensity, CAST(timer AS INTEGER) AS is_timer_period FROM gs)"""
STATE_FEATURES = ("score_diff", "total_goals", "minutes_elapsed", "minutes_remaining", "period_id", "is_leading", "is_drawing", "is_trailing", "game_intensity", "is_timer_period")
#: the 30 features of the classifiers
FEATURES = (
    "confidence_grade", "conf_trend", "xt_weight", "event_density_30s", "event_density_60s", "event_density_120s", "risk_event_count_30s", "risk_event_count_60s", "score_diff", "minutes_remaining",
    "period_id", "mid_price", "xt_x_conf", "is_high_impact", "is_timer_period", "risk_density_ratio", "price_extremeness", "total_goals", "is_leading", "is_drawing", "game_intensity",
    "event_density_300s", "high_impact_60s", "high_impact_300s", "xt_sum_60s", "xt_sum_300s", "price_velocity", "price_realized_vol", "price_change_1m", "pressure_score",
)


def _stated(df: DataFrame) -> DataFrame:
    return game_state(df.withColumns({k: F.expr(v) for k, v in STATE.items()}), ("click",))


def _features(spark, sf) -> DataFrame:
    m = _stated(_messages(spark, sf).drop("weight", "risk", "impact", "ts", "value"))
    w = S.threat_weight(F.col("incident"), WEIGHT)
    return feature_row(m, _prices(spark, sf).drop("token"), w, F.col("incident").isin("purchase", "error", "signup"), F.col("incident").isin("purchase", "error"), SCALE)


@query(f"WITH {_U} SELECT event_id, round(CASE WHEN np >= 3 THEN slope ELSE 0 END, 6) + 0::DOUBLE AS price_velocity, round(CASE WHEN np >= 3 THEN sd ELSE 0 END, 6) AS price_realized_vol, round(CASE WHEN np >= 3 THEN dl ELSE 0 END, 6) + 0::DOUBLE AS price_change_1m FROM f")
def price_window_features(spark, sf):
    names = ("price_velocity", "price_realized_vol", "price_change_1m")
    return _r(_features(spark, sf).select("event_id", *names), *names)


@query(f"WITH {_U} SELECT event_id, round(move, 6) AS max_abs_move_120s, CAST(move > 0.03 AS INTEGER) AS high_volatility, CAST(coalesce(ahead, 0) AS INTEGER) AS next_60s_high_impact FROM f")
def forward_labels(spark, sf):
    return _r(_features(spark, sf).select("event_id", "max_abs_move_120s", "high_volatility", "next_60s_high_impact"), "max_abs_move_120s")


_D = ", ".join(f"count(*) OVER {_sql_past(s)} AS d{s}" for s in (30, 60, 120, 300))


@query(f"""WITH {_U}, {GS}, ct AS ({SQL["conf_trend_last5"].replace(f"WITH {M}, l AS", "WITH l AS")}), e AS (SELECT event_id, {_D}, sum(risk) OVER {_sql_past(30)} AS r30, sum(risk) OVER {_sql_past(60)} AS r60, sum(impact) OVER {_sql_past(60)} AS h60,
  sum(impact) OVER {_sql_past(300)} AS h300, sum(weight) OVER {_sql_past(60)} AS x60, sum(weight) OVER {_sql_past(300)} AS x300 FROM m)
SELECT f.fixture_id, f.event_id, f.us, f.incident, d30 AS event_density_30s, d60 AS event_density_60s, d120 AS event_density_120s, d300 AS event_density_300s,
  CAST(r30 AS BIGINT) AS risk_event_count_30s, CAST(r60 AS BIGINT) AS risk_event_count_60s, CAST(h60 AS BIGINT) AS high_impact_60s, CAST(h300 AS BIGINT) AS high_impact_300s,
  round(x60, 6) AS xt_sum_60s, round(x300, 6) AS xt_sum_300s, round(f.weight, 6) AS xt_weight, f.impact AS is_high_impact, round(mid_price, 6) AS mid_price,
  round(CASE WHEN np >= 3 THEN slope ELSE 0 END, 6) + 0::DOUBLE AS price_velocity, round(CASE WHEN np >= 3 THEN sd ELSE 0 END, 6) AS price_realized_vol,
  round(CASE WHEN np >= 3 THEN dl ELSE 0 END, 6) + 0::DOUBLE AS price_change_1m, round(move, 6) AS max_abs_move_120s, CAST(move > 0.03 AS INTEGER) AS high_volatility,
  CAST(coalesce(ahead, 0) AS INTEGER) AS next_60s_high_impact, conf AS confidence_grade, round(f.weight * conf, 6) AS xt_x_conf, round(r60 / (d60 + 1), 6) AS risk_density_ratio,
  round(x60 * conf, 6) AS pressure_score, round(2 * abs(mid_price - 0.5), 6) AS price_extremeness
  , ct.conf_trend, st.* EXCLUDE (event_id)
FROM f JOIN e USING (event_id) JOIN ct USING (event_id) JOIN st USING (event_id)""")
def feature_row_v4(spark, sf):
    df = _features(spark, sf)
    return _r(df, *(c for c, t in df.dtypes if t == "double" and c != "confidence_grade"))


@query(f"""WITH {_U} SELECT event_id, CASE WHEN mid_price > 0 AND move / mid_price >= 0.03 THEN 1 ELSE 0 END AS relative_label FROM f""")
def forward_relative_label(spark, sf):
    return _features(spark, sf).select("event_id", labels.relative_label(F.col("max_abs_move_120s"), F.col("mid_price")).alias("relative_label"))


@query(f"""WITH {P}, d AS (SELECT *, coalesce(price - lag(price) OVER (PARTITION BY fixture_id ORDER BY us, event_id), 0.0) AS change FROM p)
SELECT event_id, round(change, 6) + 0::DOUBLE AS change, CAST(max(abs(change)) OVER (PARTITION BY fixture_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {120 * SCALE * 1000000} FOLLOWING) > 0.03 AS INTEGER) AS tick_label FROM d""")
def tick_diff_label(spark, sf):
    p = _prices(spark, sf).withColumn("change", labels.tick_change("price", "fixture_id", "us", "event_id")).withColumn("size", F.abs("change"))
    p = frames.with_extremes(p, "fixture_id", "us", "size", *frames.between(120 * SCALE, "both", ahead=True), "low", "high")
    return _r(p.select("event_id", "change", F.coalesce((F.col("high") > 0.03).cast("int"), F.lit(0)).alias("tick_label")), "change")


@query(f"WITH {P} SELECT event_id, coalesce(lag(price, 3) OVER (PARTITION BY fixture_id ORDER BY us, event_id), 0.5) AS lag3 FROM p")
def lagged_price(spark, sf):
    return _prices(spark, sf).select("event_id", F.coalesce(F.lag("price", 3).over(Window.partitionBy("fixture_id").orderBy("us", "event_id")), F.lit(0.5)).alias("lag3"))


# ---- scalars -----------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'error' THEN 4.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.0 ELSE 0.2 END::DOUBLE AS weight,
CAST(event_type IN ('purchase', 'error') AS INTEGER) AS is_high_impact FROM events""")
def threat_weight_map(spark, sf):
    e = readers.table(spark, sf, "events")
    return e.select("event_id", S.threat_weight(F.col("event_type"), WEIGHT).alias("weight"), F.col("event_type").isin("purchase", "error").cast("int").alias("is_high_impact"))


def _grid_sql() -> str:
    flat = ", ".join(str(v) for row in C.THREAT_GRID for v in row)
    return f"SELECT p_partkey, CAST(([{flat}])[least(CAST(floor(p_size / 100.0 * 12) AS INTEGER), 11) * 8 + least(CAST(floor((p_partkey % 101) / 100.0 * 8) AS INTEGER), 7) + 1] AS DOUBLE) AS threat FROM part"


@query(_grid_sql())
def threat_grid_lookup(spark, sf):
    return readers.table(spark, sf, "part").select("p_partkey", S.threat_grid(F.col("p_size").cast("double"), (F.col("p_partkey") % 101).cast("double")).alias("threat"))


def _case(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


@query(f"""SELECT l_orderkey, l_linenumber, {_case("(l_quantity % 11 - 5)", C.SCORE_EDGES)} AS score_bucket, {_case("(l_quantity * 2.5)", C.TIME_EDGES)} AS time_bucket,
{_case("(l_discount * 2)", C.VOLATILITY_EDGES)} AS grade FROM lineitem""")
def state_buckets(spark, sf):
    li = readers.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", S.score_bucket(F.col("l_quantity") % 11, F.lit(5)).alias("score_bucket"),
        S.time_bucket(F.col("l_quantity") * 2.5).alias("time_bucket"), S.volatility_grade(F.col("l_discount") * 2).alias("grade"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 100 / 60, 6) AS elapsed, round(greatest(0, 5400 - l_quantity * 100) / 60, 6) AS remaining,
round(3 * (l_quantity / 90 + 0.01), 6) AS intensity,
round(least(greatest(0.5 + 0.12 * (l_linenumber - 3) * (1 - sqrt(l_quantity / 90) * 0.3), 0.02), 0.98), 6) AS win_prob, round((l_discount + l_tax) / 2, 6) AS mid, round(l_tax - l_discount, 6) + 0::DOUBLE AS spread FROM lineitem""")
def match_clock(spark, sf):
    li = readers.table(spark, sf, "lineitem")
    sec = F.col("l_quantity") * 100
    mid, spread = S.mid_and_spread(F.col("l_discount"), F.col("l_tax"))
    df = li.select(
        "l_orderkey", "l_linenumber", S.minutes_elapsed(sec).alias("elapsed"), S.minutes_remaining(sec).alias("remaining"), S.game_intensity(F.lit(3), F.col("l_quantity")).alias("intensity"),
        S.win_probability(F.col("l_linenumber") - 3, F.col("l_quantity")).alias("win_prob"), mid.alias("mid"), spread.alias("spread"),
    )
    return _r(df, "elapsed", "remaining", "intensity", "win_prob", "mid", "spread")


@query("""SELECT event_id, coalesce(try_cast(props AS DOUBLE), 10.0) AS bad, coalesce(try_cast(substr(CAST(value AS VARCHAR), 1, 4) AS DOUBLE), 0.0) AS good,
coalesce(CAST(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS INTEGER), 0) AS whole FROM events""")
def lenient_parse(spark, sf):
    e = readers.table(spark, sf, "events")
    return e.select("event_id", S.number(F.col("props"), 10.0).alias("bad"), S.number(F.substring(F.col("value").cast("string"), 1, 4)).alias("good"), S.truncated(F.get_json_object("props", "$.k")).alias("whole"))


def _canon_sql() -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CANONICAL.items())
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CANONICAL_WEIGHT.items())
    return f"""WITH i AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Score' WHEN 1 THEN 'Goal' WHEN 2 THEN 'Attacks' WHEN 3 THEN 'Corner Kicks' ELSE event_type END AS incident FROM events),
c AS (SELECT *, CASE incident {names} ELSE 'other' END AS kind FROM i) SELECT event_id, kind, CAST(CASE kind {weights} ELSE 0.1 END AS DOUBLE) AS weight FROM c"""


@query(_canon_sql())
def canonical_incidents(spark, sf):
    i = F.when(F.col("event_id") % 5 == 0, "Score").when(F.col("event_id") % 5 == 1, "Goal").when(F.col("event_id") % 5 == 2, "Attacks").when(F.col("event_id") % 5 == 3, "Corner Kicks").otherwise(F.col("event_type"))
    return readers.table(spark, sf, "events").select("event_id", S.canonical_incident(i).alias("kind"), S.canonical_weight(i).alias("weight"))


@query("""SELECT p_partkey, CAST(CASE WHEN contains(lower(p_type), 'brass') THEN 1.0 WHEN contains(lower(p_type), 'steel') THEN 0.6 ELSE 0.05 END AS DOUBLE) AS weight,
(contains(lower(p_type), 'tin') OR contains(lower(p_type), 'copper')) AS risky FROM part""")
def substring_weights(spark, sf):
    p = readers.table(spark, sf, "part")
    return p.select("p_partkey", S.substring_weight(F.col("p_type"), (("brass", 1.0), ("steel", 0.6))).alias("weight"), S.contains_any(F.col("p_type"), ("tin", "copper")).alias("risky"))


@query(f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(c_name || ' FC & de l''United #' || c_custkey), '''', ''), '[^a-z0-9 ]', ' ', 'g'),
'\\b({"|".join(C.NOISE_TOKENS)})\\b', '', 'g'), ' +', ' ', 'g')) AS name FROM customer""")
def team_name_normalize(spark, sf):
    c = readers.table(spark, sf, "customer")
    return c.select("c_custkey", S.normalised_team(F.concat("c_name", F.lit(" FC & de l'United #"), F.col("c_custkey").cast("string"))).alias("name"))


@query("""WITH q AS (SELECT n.n_nationkey AS a, m.n_nationkey AS b, CASE (n.n_nationkey + m.n_nationkey) % 4 WHEN 0 THEN n.n_name || ' vs. ' || m.n_name || ': O/U 2.5'
  WHEN 1 THEN n.n_name || ' vs ' || m.n_name WHEN 2 THEN n.n_name || ': ' || m.n_name || ' vs. X: Draw' ELSE n.n_name END AS q FROM nation n, nation m WHERE n.n_regionkey = m.n_regionkey),
l AS (SELECT *, CASE WHEN contains(q, ': ') THEN regexp_extract(q, '^(.*): (.*)$', 1) ELSE q END AS l, CASE WHEN contains(q, ': ') THEN regexp_extract(q, '^(.*): (.*)$', 2) ELSE 'unknown' END AS kind FROM q),
s AS (SELECT *, CASE WHEN contains(l, ' vs. ') THEN ' vs. ' WHEN contains(l, ' vs ') THEN ' vs ' END AS sep FROM l)
SELECT a, b, kind, trim(substr(l, 1, instr(l, sep) - 1)) AS team_a, trim(substr(l, instr(l, sep) + length(sep))) AS team_b,
  CASE WHEN regexp_matches(q, '^(.+?)\\s+vs\\.\\s+(.+?):\\s+(.+)$') THEN regexp_extract(q, '^(.+?)\\s+vs\\.\\s+(.+?):\\s+(.+)$', 1) END AS strict_a FROM s""")
def question_parse(spark, sf):
    n = readers.table(spark, sf, "nation")
    m = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("other"), "n_regionkey")
    q = n.join(m, "n_regionkey").withColumn("_k", (F.col("n_nationkey") + F.col("b")) % 4)
    vs = F.concat("n_name", F.lit(" vs. "), "other")
    text = F.when(F.col("_k") == 0, F.concat(vs, F.lit(": O/U 2.5"))).when(F.col("_k") == 1, F.concat("n_name", F.lit(" vs "), "other")).when(F.col("_k") == 2, F.concat("n_name", F.lit(": "), "other", F.lit(" vs. X: Draw"))).otherwise(F.col("n_name"))
    q = q.withColumn("q", text)
    return q.select(F.col("n_nationkey").alias("a"), "b", S.parsed_question(F.col("q")).alias("x"), S.strict_question(F.col("q"))["team_a"].alias("strict_a")).select("a", "b", "x.kind", "x.team_a", "x.team_b", "strict_a")


@query("SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'the ')) AS hit FROM documents")
def keyword_classifier(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", S.contains_any(F.col("text"), ("license", "copyright", "the ")).alias("hit"))


@query("SELECT doc_id, (NOT regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)(^|[ ,.])(the|le|der)[ ,.]')) AS kept FROM documents")
def regex_include_exclude(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", S.include_exclude(F.col("text"), r"(?i)license", r"(?i)(^|[ ,.])(the|le|der)[ ,.]").alias("kept"))


@query("SELECT p_partkey, len(list_filter(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 3), lambda w: contains(lower(p_type || ' large brushed'), w))) > 0 AS hit FROM part")
def word_containment(spark, sf):
    return readers.table(spark, sf, "part").select("p_partkey", S.word_in_text(F.col("p_name"), F.concat("p_type", F.lit(" large brushed"))).alias("hit"))


@query("""WITH h AS (SELECT o_orderkey, unnest(generate_series(o_orderdate - INTERVAL 1 HOUR, o_orderdate + INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS h FROM orders)
SELECT strftime(h, '%Y-%m-%dT%H') AS hour, count(*) AS n, min(o_orderkey) AS first_order FROM h GROUP BY 1""")
def hour_fanout(spark, sf):
    o = readers.table(spark, sf, "orders")
    h = o.select("o_orderkey", F.explode(S.hour_range(F.col("o_orderdate").cast("timestamp"))).alias("hour"))
    return h.groupBy("hour").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


# ---- sources, sets, dedupe ---------------------------------------------------------------------


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM c)
SELECT event_type, user_id, n, rank FROM r WHERE rank <= 10""")
def topn_active_keys(spark, sf):
    return readers.top_active(readers.table(spark, sf, "events"), "event_type", "user_id", 10)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 67)")
def group_size_gate(spark, sf):
    return readers.large_enough(readers.table(spark, sf, "events").select("event_id", "user_id"), "user_id", 67)


@query(f"""WITH {P}, s AS (SELECT fixture_id, token, count(*) AS n, avg(price) AS mean_price FROM p GROUP BY 1, 2), q AS (SELECT *, n * (1 - 2 * abs(mean_price - 0.5)) AS quality FROM s WHERE mean_price > 0.05 AND mean_price < 0.95),
r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY quality DESC, token) AS r FROM q) SELECT fixture_id, token, n, round(mean_price, 6) AS mean_price, round(quality, 6) AS quality FROM r WHERE r = 1""")
def series_quality_argmax(spark, sf):
    return _r(A.series_quality(_prices(spark, sf), ["fixture_id"], "token"), "mean_price", "quality")


@query(f"""WITH {P}, s AS (SELECT fixture_id, token, arg_min(price, us) AS first_price FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY first_price DESC, token) AS r FROM s)
SELECT fixture_id, token, first_price FROM r WHERE r = 1""")
def yes_asset_pick(spark, sf):
    return A.yes_series(_prices(spark, sf), "fixture_id", "token", "us")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_last(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return readers.table(spark, sf, "events").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_split(spark, sf):
    c = readers.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return readers.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join_unmatched(spark, sf):
    o = readers.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return readers.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark, sf):
    c = readers.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = readers.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sinks.extended(c, s)


@query("""SELECT c.c_custkey, coalesce(n.n_name, '?') AS nation, coalesce(r.r_name, '?') AS region FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def lookup_defaults(spark, sf):
    n = readers.table(spark, sf, "nation").join(readers.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = readers.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("nation"), F.coalesce("r_name", F.lit("?")).alias("region"))


@query("SELECT t.threshold, CAST(count(*) FILTER (WHERE c_acctbal / 10000 >= t.threshold) AS BIGINT) AS n, count(DISTINCT CASE WHEN c_acctbal / 10000 >= t.threshold THEN c_nationkey END) AS nations FROM customer, (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS threshold) t GROUP BY 1")
def threshold_ladder(spark, sf):
    c = readers.table(spark, sf, "customer").withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.7, 0.75, 0.8, 0.85, 0.9)))))
    ok = F.col("c_acctbal") / 10000 >= F.col("threshold")
    return c.groupBy("threshold").agg(F.count_if(ok).alias("n"), F.countDistinct(F.when(ok, F.col("c_nationkey"))).alias("nations"))


# ---- dashboard ---------------------------------------------------------------------------------


@query(f"WITH {G} SELECT count(*) AS n, count(DISTINCT fixture_id) AS fixtures, round(avg(label), 6) AS label_rate FROM g")
def dataset_summary(spark, sf):
    return _r(A.dataset_summary(_scored(spark, sf)), "label_rate")


@query(f"WITH {G} SELECT fixture_id, count(*) AS n, round(avg(label), 6) AS vol_rate, round(min(mid_price), 6) AS price_min, round(max(mid_price), 6) AS price_max, round(max(mid_price) - min(mid_price), 6) AS price_range, max(prob) AS max_prob FROM g GROUP BY 1")
def fixture_list(spark, sf):
    return _r(A.fixture_list(_scored(spark, sf)), "vol_rate", "price_min", "price_max", "price_range")


@query(f"WITH {G} SELECT fixture_id, date_trunc('minute', ts) AS minute, round(avg(mid_price), 6) AS price, round(avg(prob), 6) AS mean_prob, max(prob) AS max_prob, round(avg(label), 6) AS vol_rate, count(*) AS n FROM g GROUP BY 1, 2")
def minute_rollup(spark, sf):
    df = _r(A.minute_line(_scored(spark, sf), "fixture_id"), "price", "mean_prob", "vol_rate")
    return df.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(f"WITH {G} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS t, round(avg(mid_price), 6) AS price, round(avg(prob), 6) AS mean_prob, max(prob) AS max_prob, round(avg(label), 6) AS vol_rate, count(*) AS n FROM g GROUP BY 1 ORDER BY 1 LIMIT 400")
def volatility_timeline(spark, sf):
    df = _r(A.minute_line(_scored(spark, sf)), "price", "mean_prob", "vol_rate")
    return df.orderBy("minute").limit(400).select(F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), "price", "mean_prob", "max_prob", "vol_rate", "n")


@query(f"WITH {G}, s AS (SELECT incident, avg(label) AS vol_rate, avg(predicted) AS pred_rate, avg(prob) AS mean_prob, count(*) AS n, avg(weight) AS mean_weight FROM g GROUP BY 1 HAVING count(*) >= 50 ORDER BY vol_rate DESC, incident LIMIT 20) SELECT incident, round(vol_rate, 6) AS vol_rate, round(pred_rate, 6) AS pred_rate, round(mean_prob, 6) AS mean_prob, n, round(mean_weight, 6) AS mean_weight FROM s")
def incident_stats(spark, sf):
    return _r(A.incident_stats(_scored(spark, sf)), "vol_rate", "pred_rate", "mean_prob", "mean_weight")


@query(f"WITH {G} SELECT count(*) FILTER (WHERE predicted = 1 AND label = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND label = 0) AS fp, count(*) FILTER (WHERE predicted = 0 AND label = 1) AS fn, count(*) FILTER (WHERE predicted = 0 AND label = 0) AS tn FROM g")
def confusion_counts(spark, sf):
    return A.confusion(_scored(spark, sf))


@query(f"WITH {G}, s AS (SELECT min(prob) AS lo, max(prob) AS hi FROM g), b AS (SELECT prob, label, CAST(CASE WHEN hi = lo THEN 4 ELSE least(9, greatest(0, ceil((prob - lo) / ((hi - lo) / 10)) - 1)) END AS INTEGER) AS bin FROM g, s) SELECT bin, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS vol_rate, count(*) AS n FROM b GROUP BY 1")
def calibration_bins(spark, sf):
    return _r(A.calibration(_scored(spark, sf)), "mean_prob", "vol_rate")


def _leads_sql(half: bool) -> str:
    parts = []
    for lead in LEADS:
        lo = lead * SCALE * 1_000_000
        hi = (lead // 2) * SCALE * 1_000_000 + 1 if half else 1
        parts.append(f"SELECT fixture_id, event_id, {lead} AS lead, move, avg(prob) OVER (PARTITION BY fixture_id ORDER BY us RANGE BETWEEN {lo} PRECEDING AND {hi} PRECEDING) AS mean_prob FROM g")
    return "l AS (" + " UNION ALL ".join(parts) + "), k AS (SELECT * FROM l WHERE move > 0.08 AND mean_prob IS NOT NULL)"


@query(f"WITH {G}, {_leads_sql(False)} SELECT lead, round(avg(mean_prob), 10) AS mean, round(median(mean_prob), 10) AS median, count(*) AS n FROM k GROUP BY 1")
def advance_warning(spark, sf):
    return _r(A.advance_warning(_scored(spark, sf), LEADS, scale=SCALE), "mean", "median", digits=10)


@query(f"WITH {G}, {_leads_sql(True)} SELECT fixture_id, lead, round(avg(mean_prob), 10) AS mean_prob FROM k GROUP BY 1, 2")
def warning_by_fixture(spark, sf):
    return _r(A.warning_by_fixture(_scored(spark, sf), LEADS, scale=SCALE), "mean_prob", digits=10)


@query(f"""WITH {G}, b AS (SELECT *, us - lag(us) OVER (PARTITION BY fixture_id ORDER BY us, event_id) AS gap FROM g WHERE move > 0.08),
s AS (SELECT *, sum(CASE WHEN gap > {120 * SCALE * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY fixture_id ORDER BY us, event_id) AS session FROM b)
SELECT fixture_id, CAST(session AS BIGINT) AS session, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(move) AS max_move FROM s GROUP BY 1, 2""")
def move_sessions(spark, sf):
    return A.move_sessions(_scored(spark, sf), 120 * SCALE)


@query(f"""WITH {G}, m AS (SELECT fixture_id, date_trunc('minute', ts) AS minute, avg(prob) AS p, avg(label) AS v FROM g GROUP BY 1, 2)
SELECT fixture_id, count(*) FILTER (WHERE p >= 0.52 AND v > 0.5) AS hits, count(*) FILTER (WHERE p < 0.52 AND v > 0.5) AS misses, count(*) FILTER (WHERE p >= 0.52 AND v <= 0.5) AS false_alarms FROM m GROUP BY 1""")
def minute_hit_miss(spark, sf):
    return A.hit_or_miss(_scored(spark, sf))


@query(f"""WITH {G}, k AS (SELECT event_id, fixture_id, CASE incident WHEN 'click' THEN 'Player Passes' ELSE incident END AS incident, weight FROM g),
r AS (SELECT *, rank() OVER (PARTITION BY fixture_id ORDER BY {_H.format("event_id")}, event_id) AS r FROM k WHERE incident <> 'Player Passes' AND weight < 2)
SELECT event_id, fixture_id, incident, weight FROM k WHERE incident <> 'Player Passes' AND weight >= 2 UNION ALL SELECT event_id, fixture_id, incident, weight FROM r WHERE r <= 100""")
def event_markers(spark, sf):
    rows = _scored(spark, sf).withColumn("incident", F.when(F.col("incident") == "click", C.MARKER_NOISE[3]).otherwise(F.col("incident")))
    return A.markers(rows, C.MARKER_NOISE).select("event_id", "fixture_id", "incident", "weight")


@query(f"""WITH {G}, f AS (SELECT fixture_id, count(*) AS n, round(max(mid_price) - min(mid_price), 6) AS price_range FROM g GROUP BY 1)
SELECT fixture_id, n, price_range, coalesce(n_name, '?') AS home, coalesce(r_name, '?') AS league FROM f LEFT JOIN nation ON fixture_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def fixture_list_meta(spark, sf):
    n = readers.table(spark, sf, "nation").join(readers.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    meta = n.select(F.col("n_nationkey").cast("long").alias("fixture_id"), F.col("n_name").alias("home"), F.col("r_name").alias("league"))
    return _r(A.fixture_list(_scored(spark, sf), meta).select("fixture_id", "n", "price_range", "home", "league"), "price_range")


@query(f"WITH {G}, m AS (SELECT incident AS model, avg(label) AS f1 FROM g GROUP BY 1), b AS (SELECT * FROM m ORDER BY f1 DESC, model LIMIT 1) SELECT (SELECT count(*) FROM g) AS n, (SELECT count(DISTINCT fixture_id) FROM g) AS fixtures, round((SELECT avg(label) FROM g), 6) AS label_rate, model AS best_model, round(f1, 6) AS best_f1 FROM b")
def summary_with_best(spark, sf):
    g = _scored(spark, sf)
    return _r(A.dataset_summary(g, g.groupBy(F.col("incident").alias("model")).agg(F.avg("label").alias("f1"))), "label_rate", "best_f1")


@query(f"WITH {G} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS t, round(avg(mid_price), 6) AS price, count(*) AS n FROM g WHERE fixture_id = 7 GROUP BY 1")
def fixture_minutes(spark, sf):
    line = _r(A.minute_line(_scored(spark, sf), fixture=7), "price")
    return line.select(F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), "price", "n")


@query("""SELECT event_id, i IN ('Score', 'RedCard', 'YellowCard') AS risk, i IN ('Score', 'RedCard') AS impact, upper(i) IN ('ATTACK') AS risky_type
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Score' WHEN 'error' THEN 'RedCard' WHEN 'signup' THEN 'YellowCard' WHEN 'click' THEN 'attack' ELSE event_type END AS i FROM events)""")
def risk_flags(spark, sf):
    names = {"purchase": "Score", "error": "RedCard", "signup": "YellowCard", "click": "attack"}
    e = readers.table(spark, sf, "events")
    i = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()), F.col("event_type"))
    return e.select("event_id", S.high_risk(i).alias("risk"), S.high_impact(i).alias("impact"), S.high_risk_event(i).alias("risky_type"))


@query("""SELECT l_orderkey, l_linenumber, round(l_linenumber / (l_quantity + 1), 6) AS per_minute, round(l_linenumber * l_quantity / 90, 6) AS of_match,
round((coalesce(b, 0) + coalesce(a, 0)) / 2, 6) AS mid_00, round((coalesce(b, 0) + coalesce(a, 1)) / 2, 6) AS mid_01, round((b + a) / 2, 6) AS mid_none, round(coalesce(a, 1) - coalesce(b, 0), 6) + 0::DOUBLE AS spread_01
FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS b, CASE WHEN l_linenumber % 2 <> 0 THEN l_tax END AS a FROM lineitem)""")
def intensity_and_mid_variants(spark, sf):
    li = readers.table(spark, sf, "lineitem")
    bid, ask = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_tax"))
    df = li.select(
        "l_orderkey", "l_linenumber", S.intensity_per_minute(F.col("l_linenumber"), F.col("l_quantity")).alias("per_minute"), S.intensity_of_match(F.col("l_linenumber"), F.col("l_quantity")).alias("of_match"),
        S.mid_and_spread(bid, ask, 0.0, 0.0)[0].alias("mid_00"), S.mid_and_spread(bid, ask, 0.0, 1.0)[0].alias("mid_01"), S.mid_and_spread(bid, ask)[0].alias("mid_none"), S.mid_and_spread(bid, ask, 0.0, 1.0)[1].alias("spread_01"),
    )
    return _r(df, "per_minute", "of_match", "mid_00", "mid_01", "mid_none", "spread_01")


# ---- hour store ----------------------------------------------------------------------------------


def _wanted(spark, sf) -> DataFrame:
    """A user stands for a market of fixture user_id % 50, wanted around the hour of its first event."""
    first = readers.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("at"))
    return stores.fan_out(first.select((F.col("user_id") % 50).alias("fixture_id"), F.col("user_id").alias("market"), "at"))


_W = "wanted AS (SELECT user_id % 50 AS fixture_id, user_id AS market, strftime(unnest(generate_series(a - INTERVAL 1 HOUR, a + INTERVAL 2 HOUR, INTERVAL 1 HOUR)), '%Y-%m-%dT%H') AS hour FROM (SELECT user_id, min(ts) AS a FROM events GROUP BY 1))"


@query(f"WITH {_W} SELECT w.fixture_id, w.market, w.hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM wanted w JOIN events e ON e.user_id = w.market AND strftime(e.ts, '%Y-%m-%dT%H') = w.hour GROUP BY 1, 2, 3")
def hour_store(spark, sf):
    wanted = _wanted(spark, sf)
    e = readers.table(spark, sf, "events").select(F.col("user_id").alias("market"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), "value")
    store = stores.HourStore(spark, stores.fresh_root(spark, "hours"))
    store.fill(wanted.where("market % 2 = 0"), lambda hours: e.where(F.col("hour").isin(hours)))
    store.fill(wanted, lambda hours: e.where(F.col("hour").isin(hours)))
    found = store.prices(wanted).groupBy("fixture_id", "market", "hour").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return _r(found, "mean_value")


@query(f"WITH {_W} SELECT hour, count(DISTINCT market) AS n_markets, min(market) AS first_market FROM wanted GROUP BY 1")
def markets_by_hour(spark, sf):
    return stores.ids_by_hour(_wanted(spark, sf)).select("hour", F.size("markets").cast("long").alias("n_markets"), F.get("markets", F.lit(0)).alias("first_market"))


# ---- Markov ------------------------------------------------------------------------------------

_S = f"""{G}, r AS (SELECT event_id, fixture_id, us, struct_pack(score := {_case("(event_id % 9 - 4)", C.SCORE_EDGES)}, period := CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(event_id % 3 AS INTEGER) END, time := {_case("(prob * 100)", C.TIME_EDGES)}) AS st,
  label AS win FROM g), x AS (SELECT event_id, fixture_id, us, win, st.score || '-' || st.period || '-' || st.time AS state FROM r),
v AS (SELECT state, count(*) AS visits, CAST(sum(win) AS BIGINT) AS wins, avg(win) AS win_prob FROM x GROUP BY 1),
y AS (SELECT state, lead(state) OVER (PARTITION BY fixture_id ORDER BY us, event_id) AS next_state FROM x), z AS (SELECT state, next_state, count(*) AS n FROM y WHERE next_state IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY state) AS p FROM z),
e0 AS (SELECT t.state, sum(p * coalesce(v.win_prob, 0.5)) AS m, sum(p * coalesce(v.win_prob, 0.5) * coalesce(v.win_prob, 0.5)) AS m2 FROM t LEFT JOIN v ON t.next_state = v.state GROUP BY 1),
e AS (SELECT v.state, coalesce(m, win_prob) AS expected, abs(coalesce(m, win_prob) - win_prob) AS delta, coalesce(greatest(m2 - m * m, 0.0), 0.0) AS volatility, win_prob FROM v LEFT JOIN e0 USING (state))"""


def _states(spark, sf) -> DataFrame:
    g = _scored(spark, sf)
    st = S.markov_state((F.col("event_id") % 9).cast("int"), F.lit(4), F.col("event_id") % 3, F.col("prob") * 100)
    return g.select("event_id", "fixture_id", "us", F.col("label").alias("win"), F.concat_ws("-", st["score"], st["period"], st["time"]).alias("state"))


def _chain(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _states(spark, sf)
    return rows, markov.state_values(rows), markov.transitions(rows, "fixture_id", ["us", "event_id"])


@query(f"WITH {_S} SELECT state, visits, wins, round(win_prob, 6) AS win_prob FROM v")
def markov_win_prob(spark, sf):
    return _r(_chain(spark, sf)[1], "win_prob")


@query(f"WITH {_S} SELECT state, next_state, n, round(p, 6) AS p FROM t")
def markov_transitions(spark, sf):
    return _r(_chain(spark, sf)[2], "p")


@query(f"WITH {_S} SELECT state, round(expected, 6) AS expected, round(delta, 6) AS delta, round(volatility, 6) AS volatility FROM e")
def markov_expected_price(spark, sf):
    _, v, t = _chain(spark, sf)
    return _r(markov.expected(v, t), "expected", "delta", "volatility")


@query(f"WITH {_S} SELECT (SELECT count(*) FROM v) AS n_states, (SELECT count(*) FROM t) AS n_transitions, round((SELECT avg(win_prob) FROM v), 6) AS mean_win_prob")
def markov_summary(spark, sf):
    _, v, t = _chain(spark, sf)
    return _r(markov.summary(v, t), "mean_win_prob")


@query(f"""WITH {_S}, j AS (SELECT x.event_id, x.fixture_id, x.us, e.win_prob, e.delta, e.volatility FROM x JOIN e USING (state)),
d AS (SELECT *, coalesce(win_prob - lag(win_prob) OVER (PARTITION BY fixture_id ORDER BY us, event_id), 0.0) AS d1 FROM j)
SELECT event_id, round(win_prob, 6) AS win_prob, round(delta, 6) AS delta, round(volatility, 6) AS volatility, round(d1, 6) + 0::DOUBLE AS d1, round(coalesce(d1 - lag(d1) OVER (PARTITION BY fixture_id ORDER BY us, event_id), 0.0), 6) + 0::DOUBLE AS d2 FROM d""")
def markov_features(spark, sf):
    names = ("win_prob", "delta", "volatility", "d1", "d2")
    return _r(markov.features(*_chain(spark, sf), "fixture_id", ["us", "event_id"]).select("event_id", *names), *names)


@query(f"WITH {_S} SELECT r.event_id, CASE WHEN st.score <= 6 AND st.period <= 3 AND st.time <= 5 THEN round(0.5 + (st.score - 2) * 0.12, 6) ELSE 0.5 END::DOUBLE AS win_prob FROM r")
def markov_analytic(spark, sf):
    rows = _states(spark, sf).select("event_id", F.split("state", "-").alias("s")).select("event_id", *(F.get("s", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("score", "period", "time"))))
    return _r(markov.with_analytic(rows).select("event_id", "win_prob"), "win_prob")


# ---- ML and splits -----------------------------------------------------------------------------


@query(f"""WITH {G}, h AS (SELECT round(0.1 + i * 0.02, 2) AS threshold FROM range(40) r(i)),
c AS (SELECT threshold, CAST(sum(CASE WHEN prob >= threshold THEN label ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN prob >= threshold THEN 1 - label ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN prob < threshold THEN label ELSE 0 END) AS BIGINT) AS fn FROM h, g GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def threshold_sweep(spark, sf):
    return _r(A.threshold_sweep(_scored(spark, sf)), "precision", "recall", "f1")


@query(f"""WITH {G}, c AS (SELECT prob AS s, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM g GROUP BY 1),
w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp FROM c)
SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM w""")
def metrics_auc(spark, sf):
    return _r(A.ranking_metrics(_scored(spark, sf)), "roc_auc", "average_precision")


@query("WITH t AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT event_id, n <= floor(c * 0.8) AS is_train, CAST(least(floor((n - 1) * 5 / c), 4) AS INTEGER) AS fold FROM t")
def time_split(spark, sf):
    w = Window.partitionBy("user_id")
    t = readers.table(spark, sf, "events").select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("n"), F.count("*").over(w).alias("c"))
    return t.select("event_id", (F.col("n") <= F.floor(F.col("c") * 0.8)).alias("is_train"), F.least(F.floor((F.col("n") - 1) * 5 / F.col("c")), F.lit(4)).cast("int").alias("fold"))


@query(f"""WITH k AS (SELECT user_id, row_number() OVER (ORDER BY {_H.format("user_id")}, CAST(user_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, r <= floor(0.7 * n + 1e-9) AS is_train FROM events JOIN k USING (user_id)""")
def group_split(spark, sf):
    return ml.group_split(readers.table(spark, sf, "events"), "user_id").select("event_id", "is_train")


@query(f"""WITH k AS (SELECT user_id, row_number() OVER (ORDER BY {_H.format("user_id")}, CAST(user_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, CASE WHEN r <= floor(0.56 * n + 1e-9) THEN 'train' WHEN r <= floor(0.7 * n + 1e-9) THEN 'middle' END AS split FROM events JOIN k USING (user_id)""")
def validation_split(spark, sf):
    return ml.multi_split(readers.table(spark, sf, "events"), "user_id", SPLIT).select("event_id", "split")


@query("""WITH k AS (SELECT least(greatest(count(DISTINCT user_id % 50) // 2, 2), 5) AS k, count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS r FROM events)
SELECT event_id, CAST(CASE WHEN r >= n - k * (n // (k + 1)) THEN (r - (n - k * (n // (k + 1)))) // (n // (k + 1)) + 1 ELSE 0 END AS INTEGER) AS fold FROM r, k""")
def expanding_folds(spark, sf):
    e = _events(spark, sf)
    return ml.with_fold(e, "us", "event_id", ml.n_folds(e)).select("event_id", "fold")


@query()
def cross_validation(spark, sf):
    rows = _features(spark, sf).withColumn("label", F.col("high_volatility"))
    return ml.cross_validate(rows, list(FEATURES), trees=10, only=("logistic_regression",))


@query(f"WITH {G} SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS balance FROM g")
def class_balance(spark, sf):
    c = _scored(spark, sf).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return _r(c.withColumn("balance", F.col("negatives") / F.col("positives")), "balance")


@query()
def model_comparison(spark, sf):
    rows = ml.complete(_features(spark, sf).withColumn("label", F.col("high_volatility")), list(FEATURES))
    rows = stores.written(rows.select("fixture_id", "label", *FEATURES), "rows")
    rows = ml.multi_split(rows, "fixture_id", SPLIT)
    out = ml.train_and_evaluate(rows.where("split = 'train'"), rows.where("split is null and fixture_id is not null"), list(FEATURES), trees=40, middle=rows.where("split = 'middle'"))
    return ml.best_model(out)


@query()
def fuzzy_match_best(spark, sf):
    c = readers.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.normalised_team(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("block"))
    s = readers.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cand_id"), S.normalised_team(F.col("s_name")).alias("cand_name"), F.col("s_nationkey").alias("block"))
    return match.best_match(c, s, "block", 0.4)


@query()
def fuzzy_match_markets(spark, sf):
    both = readers.table(spark, sf, "orders")  # orders of even key stand for markets, of odd key for fixtures
    o = both.where("o_orderkey % 2 = 0")
    day = F.to_date("o_orderdate")
    m = o.select(F.col("o_orderkey").alias("market_id"), F.concat(F.lit("team "), (F.col("o_custkey") % 97).cast("string")).alias("team_a"), F.concat(F.lit("side "), (F.col("o_custkey") % 89).cast("string")).alias("team_b"), day.alias("date"))
    f = both.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("fixture_id"), F.concat(F.lit("team "), (F.col("o_custkey") % 91).cast("string")).alias("home"), F.concat(F.lit("side "), (F.col("o_custkey") % 83).cast("string")).alias("away"), day.alias("date"))
    return match.match_by_date(m, f)


@query()
def synthetic_matches(spark, sf):
    return synthetic.matches(readers.table(spark, sf, "customer").select(F.col("c_custkey").alias("match_id")))


# ---- state, scalars and filters ------------------------------------------------------------------


@query(f"WITH {GS} SELECT * FROM st")
def game_state_columns(spark, sf):
    return _r(_stated(_events(spark, sf)).select("event_id", *STATE_FEATURES), "minutes_elapsed", "minutes_remaining", "game_intensity")


@query("SELECT event_id, CASE upper(event_type) WHEN 'GOAL' THEN 5.0 ELSE 0.1 END::DOUBLE AS weight, CASE WHEN event_id % 2 = 0 THEN round_even(greatest(0, 90 - (event_id % 6000) / 60), 2) ELSE round_even(greatest(0, 45 - (event_id % 6000) / 60), 2) END AS minutes_left FROM events")
def period_minutes(spark, sf):
    e = readers.table(spark, sf, "events")
    left = S.minutes_by_period((F.col("event_id") % 6000).cast("double"), F.when(F.col("event_id") % 2 == 0, 10).otherwise(20))
    return e.select("event_id", S.event_weight(F.col("event_type")).alias("weight"), left.alias("minutes_left"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_id % 5 <> 0")
def lenient_timestamps(spark, sf):
    e = readers.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("CreatedAt"))
    return S.first_timestamp(S.renamed(e, {})).select("event_id", S.micros(F.col("timestamp")).alias("us"))


@query("SELECT c_custkey AS match_id, c_nationkey AS sport_id, 0.5::DOUBLE AS confidence, substr(md5(c_name), 1, 32) AS market FROM customer")
def renamed_and_defaulted(spark, sf):
    c = readers.table(spark, sf, "customer").select(F.col("c_custkey").alias("MatchId"), F.col("c_nationkey").alias("SportId"), F.concat(F.lit("0x"), F.upper(F.md5("c_name")), F.lit("ff")).alias("market"))
    df = S.with_defaults(S.renamed(c, {"matchid": "match_id", "sportid": "sport_id"}), confidence=F.lit(0.5))
    return df.withColumn("market", S.market_key(F.col("market")))


@query(f"WITH {M}, {P}, s AS (SELECT fixture_id, min(us) AS lo, max(us) AS hi FROM p GROUP BY 1) SELECT event_id, us BETWEEN lo AND hi AS in_play FROM m JOIN s USING (fixture_id) WHERE us BETWEEN lo - 3600000000 AND hi + 7200000000")
def price_window_filters(spark, sf):
    m, p = _messages(spark, sf), _prices(spark, sf)
    inside = A.within_prices(m, p, "fixture_id", "us").select("event_id", F.lit(True).alias("in_play"))
    return A.within_prices(m, p, "fixture_id", "us", 3_600_000_000, 7_200_000_000).select("event_id").join(inside, "event_id", "left").na.fill(False, ["in_play"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE contains(CAST(o_orderdate AS VARCHAR), '1995') AND abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 2")
def date_filters(spark, sf):
    rows = readers.table(spark, sf, "lineitem").join(readers.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    near = S.days_apart(F.to_date("o_orderdate"), F.to_date("l_shipdate")) <= 2
    return rows.where(F.contains(F.col("o_orderdate").cast("string"), F.lit("1995")) & near).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, coalesce(contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass'), FALSE) AS major, substr(o, 1, 10) AS day, CASE WHEN length(o) > 10 THEN substr(o, 12, 2) ELSE '18' END AS hour FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '2026-05-01' ELSE '2026-05-01T0' || (p_partkey % 10) END AS o FROM part)")
def league_and_slices(spark, sf):
    p = readers.table(spark, sf, "part").withColumn("o", F.expr("case when p_partkey % 3 = 0 then '2026-05-01' else concat('2026-05-01T0', p_partkey % 10) end"))
    return p.select("p_partkey", S.major_league(F.col("p_type"), ("Steel", "BRASS")).alias("major"), S.date_part(F.col("o")).alias("day"), S.hour_part(F.col("o")).alias("hour"))


@query("SELECT p_partkey FROM part ORDER BY contains(p_type, 'STEEL'), p_partkey LIMIT 50")
def preferred_first(spark, sf):
    return A.preferred(readers.table(spark, sf, "part"), F.contains("p_type", F.lit("STEEL")), ["p_partkey"], 50).select("p_partkey")


#: questions about a customer and a nation, in the forms that markets have; the words of other sports and terms take turns
FORMS = ("Will {c} FC win on 2026-05-01?", "{c} vs. {n}: O/U 2.5", "{c} vs. {n}: O/U 210.5", "{s}: {c} soccer draw?", "{t} in {c} vs. {n}", "Who wins {n}", "Will {c} win the {n} cup", "{c} title", "Will {n} end in a draw", "{c} {s}", "{c} {t}")
_SAID = [re.sub(r"\\b|[\\*?]", "", x.replace(r"\d{3}", "210").replace(r"\d+", "2").replace(".", " ")) for x in C.OTHER_SPORTS]
_TERMS = [re.sub(r"\[- \]", " ", x) for x in C.FOOTBALL_TERMS if "(" not in x and ".*" not in x]


def _questions_sql() -> str:
    text = lambda f: "'" + f.replace("'", "''").replace("{c}", "' || c_name || '").replace("{n}", "' || n_name || '").replace("{s}", "' || s || '").replace("{t}", "' || t || '") + "'"
    listed = lambda x: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in x) + "]"
    forms = " ".join(f"WHEN {i} THEN {text(f)}" for i, f in enumerate(FORMS))
    exclude, include = S.market_patterns(["Customer#00000007"])
    return f"""WITH w AS (SELECT *, {listed(_SAID)}[c_custkey % {len(_SAID)} + 1] AS s, {listed(_TERMS)}[c_custkey % {len(_TERMS)} + 1] AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT c_custkey, CASE c_custkey % {len(FORMS)} {forms} END AS question FROM w)
SELECT c_custkey, NOT regexp_matches(question, '{exclude}') AND regexp_matches(question, '{include}') AS football FROM q"""


@query(_questions_sql())
def market_classifier(spark, sf):
    c = readers.table(spark, sf, "customer").join(readers.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    picked = lambda x: F.get(F.array(*(F.lit(v) for v in x)), (F.col("c_custkey") % len(x)).cast("int"))
    c = c.withColumns({"s": picked(_SAID), "t": picked(_TERMS)})
    named = {"{c}": "c_name", "{n}": "n_name", "{s}": "s", "{t}": "t"}
    texts = [F.concat(*(F.col(named[p]) if p in named else F.lit(p) for p in re.split(r"(\{[cnst]\})", f) if p)) for f in FORMS]
    question = F.get(F.array(*texts), (F.col("c_custkey") % len(FORMS)).cast("int"))
    return c.select("c_custkey", S.strict_market(question, ["Customer#00000007"]).alias("football"))


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, sf):
    return _r(A.value_counts(readers.table(spark, sf, "events"), "event_type"), "share")


@query("SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events")
def described(spark, sf):
    return _r(A.described(readers.table(spark, sf, "events"), "value"), "mean", "std", "q1", "median", "q3")


@query(f"WITH {P}, t AS (SELECT fixture_id, token, count(*) AS n, avg(price) AS mean_price FROM p GROUP BY 1, 2 HAVING avg(price) > 0.05 AND avg(price) < 0.95), r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY n DESC, token) AS r FROM t) SELECT fixture_id, token, n, round(mean_price, 6) AS mean_price FROM r WHERE r = 1")
def longest_series(spark, sf):
    return _r(A.longest_series(_prices(spark, sf), "fixture_id", "token"), "mean_price")


@query(f"WITH {P}, n AS (SELECT token, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 5), r AS (SELECT fixture_id, token, n, row_number() OVER (PARTITION BY fixture_id ORDER BY token DESC) AS r FROM (SELECT DISTINCT fixture_id, token FROM p) JOIN n USING (token)) SELECT fixture_id, token, n FROM r WHERE r = 1")
def first_usable_source(spark, sf):
    p = _prices(spark, sf)
    return A.first_usable(p.select("fixture_id", "token").distinct().withColumn("ordinal", -F.col("token")), p, "fixture_id", "ordinal", "token")


@query("SELECT event_id, round(0.7 * coalesce(lag(k, 3) OVER w, 0.5) + 0.3 * k, 6) AS market_base FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS k FROM events) WINDOW w AS (PARTITION BY user_id % 50 ORDER BY epoch_us(ts), event_id)")
def simulated_market(spark, sf):
    e = _events(spark, sf).withColumnRenamed("conf", "win_prob")
    return _r(markov.simulated_prices(e, "fixture_id", ["us", "event_id"]).select("event_id", "market_base"), "market_base")


# ---- matchups ------------------------------------------------------------------------------------


def _markets(spark, sf) -> DataFrame:
    o = readers.table(spark, sf, "orders").where("o_orderkey % 2 = 0")
    team = lambda word, n: F.concat(F.lit(word), (F.col("o_custkey") % n).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("market_id"), team("team ", 31).alias("team_a"), team("side ", 29).alias("team_b"), F.to_date("o_orderdate").alias("date"),
        F.concat(team("Team ", 31), F.lit(" vs. "), team("Side ", 29), F.lit(": O/U 2.5")).alias("question"),
    )


def _fixtures(spark, sf) -> DataFrame:
    o = readers.table(spark, sf, "orders").where("o_orderkey % 2 = 1")
    team = lambda word, n: F.concat(F.lit(word), (F.col("o_custkey") % n).cast("string"))
    return o.select(F.col("o_orderkey").alias("fixture_id"), team("team ", 37).alias("home"), team("side ", 23).alias("away"), F.to_date("o_orderdate").alias("date"))


@query("""WITH k AS (SELECT o_orderkey AS id, 'team ' || (o_custkey % 31) AS team_a, 'side ' || (o_custkey % 29) AS team_b, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 2 = 0)
SELECT team_a, team_b, date, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS ids FROM k GROUP BY 1, 2, 3""")
def market_matchups(spark, sf):
    g = match.matchups(_markets(spark, sf))
    return g.select("team_a", "team_b", "date", F.size("market_ids").cast("long").alias("n"), F.array_join(F.transform("market_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def fuzzy_match_matchups(spark, sf):
    return match.match_matchups(_markets(spark, sf), _fixtures(spark, sf))


@query()
def fuzzy_fixture_matchups(spark, sf):
    return match.fixture_classes(_fixtures(spark, sf), _markets(spark, sf))


@query()
def fuzzy_best_question(spark, sf):
    return match.best_question(_fixtures(spark, sf), _markets(spark, sf))
