"""Frames by differences of running sums, against Spark's own range frames and against numpy, and as-of joins over many cells."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, frames, windows
from tidemark.operators.features import rolling_block

US = 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 3]), i, rng.randint(-200, 400) * US + rng.choice([0, 0, 1, -1]), rng.choice([None, round(rng.random(), 3)]), rng.randint(0, 1)) for i in range(600)]
    return spark.createDataFrame([*data, (1, 1000, None, 0.5, 1)], "k int, id long, us long, x double, flag int").cache()


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_sums_equal_range_frames(rows, closed):
    values = {"n": F.lit(1), "f": F.col("flag"), "s": F.col("x")}
    asked = {f"{v}{w}": (v, *frames.between(w, closed)) for v in values for w in (5, 60, 61, 300)}
    got = frames.with_sums(rows, "k", "us", values, asked).where("us is not null")
    for v, c in (("n", F.count("*")), ("f", F.sum("flag")), ("s", F.sum("x"))):
        for w in (5, 60, 61, 300):
            got = got.withColumn(f"w_{v}{w}", F.coalesce(c.over(windows.past("k", "us", w, closed)), F.lit(0)))
    assert got.count() == 600
    for name in asked:
        assert got.where(f"abs({name} - w_{name}) > 1e-9 or {name} is null").isEmpty(), name


def test_future_frames_extremes_and_lines(rows):
    prices = rows.where("x is not null and us is not null").groupBy("k", "us").agg(F.max("x").alias("x"))
    for closed in ("right", "both"):
        got = frames.joined(rows, frames.extremes(rows, prices, "k", "us", "x", *frames.between(120, closed, ahead=True)), "k", "us").where("us is not null")
        both = rows.select("k", "us", "id").unionByName(prices, allowMissingColumns=True)
        w = windows.future("k", "us", 120, closed)
        want = both.withColumns({"l": F.min("x").over(w), "h": F.max("x").over(w)}).where("id is not null").select("id", "l", "h")
        assert got.join(want, "id").where("not (low <=> l and high <=> h)").isEmpty()
    series = windows.Window.partitionBy("k").orderBy("us")
    numbered = prices.withColumn("o", F.row_number().over(series))
    both = rows.select("k", "us", "id").unionByName(numbered, allowMissingColumns=True)
    w = windows.past("k", "us", 90, "left")
    want = both.withColumns({"n": F.count("x").over(w), "s": F.regr_slope("x", "o").over(w)}).where("id is not null").select("id", "n", "s")
    found = frames.framed(rows, prices, "k", "us", {"x": F.col("x")}, {}, {"p": ("x", *frames.between(90, "left"))})
    got = frames.joined(rows, found, "k", "us").where("us is not null").join(want, "id")
    assert got.count() == 600 and got.where("p_n <> n or abs(p_slope - coalesce(s, 0)) > 1e-9").isEmpty()


def test_rolling_block_defaults(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0, "a"), (1, 60 * US, 0.4, 2.0, "b"), (1, 60 * US, 0.2, 4.0, "a"), (1, 120 * US, None, 8.0, None)], "fixture_id int, us long, conf double, w double, incident string")
    out = rolling_block(df, {"conf": "conf", "weight": "w"}, (60,), flags={"shot": F.col("incident") == "a"})
    got = [tuple(r) for r in out.select("us", "event_density_60s", "weight_sum_60s", "conf_mean_60s", "conf_min_60s", "shot_60s").distinct().orderBy("us").collect()]
    # the left end doesn't belong to the frame
    assert got == [(0, 1, 1.0, 0.5, 1.0, 1), (60 * US, 2, 6.0, pytest.approx(0.3), 0.2, 1), (120 * US, 1, 8.0, 0.5, 1.0, 0)]


def test_a_busy_key_takes_linear_time(spark):
    """All rows of one key lie in each other's frames: twice the rows take about twice the time, not four times."""
    took = []
    for n in (20_000, 40_000):
        df = spark.range(0, n, 1, 4).select(F.lit(1).alias("k"), "id", (F.col("id") * 1500).alias("us"), (F.col("id") % 7).alias("x"))
        asked = {"n": ("n", *frames.between(60)), "s": ("x", *frames.between(60, "left"))}
        began = time.time()
        got = frames.with_sums(df, "k", "us", {"n": F.lit(1), "x": F.col("x")}, asked).select("id", "us", "n", "s").toPandas()
        took.append(time.time() - began)
        at = list(range(0, n * 1500, 1500))
        for r in got.sample(200, random_state=1).itertuples():
            lo = bisect.bisect_left(at, r.us - 60 * US)
            assert r.n == r.id - lo + 1 and r.s == sum(i % 7 for i in range(lo, r.id))
    assert took[1] < 60


def test_asof_over_many_cells(spark):
    rng = random.Random(5)
    events = [(rng.choice([None, 1, 2]), i, rng.randint(0, 5000)) for i in range(300)]
    prices = [(rng.choice([None, 1, 2]), 1000 + i, rng.randint(1000, 4500), i / 100) for i in range(40)]
    e, p = spark.createDataFrame(events, "k int, id long, us long"), spark.createDataFrame(prices, "k int, id long, us long, price double")
    last = {}
    for k, i, us, v in sorted(prices, key=lambda r: r[1]):
        last[k, us] = v
    for cell in (7, 100, 10**9):
        got = {r["id"]: (r["price"], r["price_at"]) for r in asof.backward(e, p, "k", "us", "price", "id", cell).collect()}
        near = {r["id"]: r["price"] for r in asof.nearest(e, p, "k", "us", "price", "id", 100 / US, cell).collect()}
        for k, i, us in events:
            own = sorted((t, v) for (q, t), v in last.items() if q == k)
            before, after = [x for x in own if x[0] <= us], [x for x in own if x[0] >= us]
            assert got[i] == ((before[-1][1], before[-1][0]) if before else (None, None))
            pick = min((abs(t - us), t > us, v) for t, v in [*before[-1:], *after[:1]]) if before or after else (10**9, False, None)
            assert near[i] == (pick[2] if pick[0] <= 100 else None)
