"""Edges of frames, joins, labels and buckets on hand-made rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import analytics, asof, labels, markov, match, windows
from tidemark.sources import readers, sinks
from tidemark.streaming import queries as streams

US = 1_000_000


def stream(spark, rows, schema="k int, us long, id int, x double"):
    return spark.createDataFrame(rows, schema)


def values(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_past_frames_with_ties(spark, closed):
    # the last row is exactly 60 s after the two at the same time, whose window starts at the first row
    df = stream(spark, [(1, 40 * US, 1, 1.0), (1, 100 * US, 2, 1.0), (1, 100 * US, 3, 1.0), (1, 160 * US, 4, 1.0), (1, 130 * US, 5, 1.0), (2, 130 * US, 6, 1.0)])
    got = values(df.withColumn("n", F.count("*").over(windows.past("k", "us", 60, closed))), "id", "n")
    base = {"both": {1: 1, 2: 3, 3: 3, 4: 4, 5: 3, 6: 1}, "left": {1: 0, 2: 1, 3: 1, 4: 3, 5: 2, 6: 0}, "right": {1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 1}, "neither": {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 0}}
    assert got == base[closed]


def test_asof_takes_last_of_equal_times_and_nothing_later(spark):
    ev = stream(spark, [(1, 10, 1, 0.0), (1, 20, 2, 0.0), (1, 5, 3, 0.0), (2, 10, 4, 0.0)]).drop("x")
    pr = stream(spark, [(1, 10, 1, 0.1), (1, 10, 2, 0.2), (1, 15, 3, 0.3)]).withColumnRenamed("x", "price")
    assert values(asof.backward(ev, pr, "k", "us", "price", "id"), "id", "price") == {1: 0.2, 2: 0.3, 3: None, 4: None}


def test_asof_nearest_prefers_earlier_and_keeps_tolerance(spark):
    ev = stream(spark, [(1, 100 * US, 1, 0.0), (1, 500 * US, 2, 0.0), (1, 501 * US, 3, 0.0)]).drop("x")
    pr = stream(spark, [(1, 90 * US, 1, 0.1), (1, 110 * US, 2, 0.2), (1, 200 * US, 3, 0.3)]).withColumnRenamed("x", "price")
    assert values(asof.nearest(ev, pr, "k", "us", "price", "id", 300), "id", "price") == {1: 0.1, 2: 0.3, 3: None}


def test_carried_value_takes_first_of_equal_times(spark):
    df = stream(spark, [(1, 1, 1, 5.0), (1, 2, 2, 7.0), (1, 2, 3, 8.0), (1, 3, 4, 9.0)])
    got = values(asof.carried(df, "k", "us", "id", "x", "id in (2, 3)", 0.0), "id", "carried_x")
    assert got == {1: 0.0, 2: 7.0, 3: 7.0, 4: 7.0}


def test_labels_at_the_edges(spark):
    df = stream(spark, [(1, 0, 1, 0.5), (1, 120 * US, 2, 0.75), (1, 240 * US + 1, 3, 0.1)])
    move = labels.max_move("x", F.col("x"), windows.future("k", "us", 120))
    got = values(df.withColumn("m", F.round(move, 6)), "id", "m")
    assert got == {1: 0.25, 2: 0.0, 3: 0.0}
    edge = spark.createDataFrame([(0.25, 1.0), (0.5, 1.0), (0.5, 0.0)], "m double, p double")
    rows = edge.select(labels.absolute_label(F.col("m"), 0.25).alias("a"), labels.relative_label(F.col("m"), F.col("p"), 0.25).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(0, 1), (1, 1), (1, 0)]


def test_trend_of_last_five(spark):
    rows = [(1, i * US, i, None if i == 3 else float(i * i)) for i in range(1, 9)]
    df = stream(spark, rows).withColumn("t", F.round(windows.trend("us", "id", "x", windows.past("k", "us", 60)), 6))
    got = values(df, "id", "t")
    assert got[1] == 0.0 and got[2] == 3.0
    ys = [16.0, 25.0, 36.0, 49.0, 64.0]
    mean = sum(ys) / 5
    assert got[8] == round(sum((i - 2) * (y - mean) for i, y in enumerate(ys)) / 10, 6)


def test_sessions_split_only_above_the_gap(spark):
    df = stream(spark, [(1, 0, 1, 0.0), (1, 119, 2, 0.0), (1, 239, 3, 0.0), (1, 360, 4, 0.0)])
    assert values(windows.sessions(df, "k", "us", 120, "id"), "id", "session") == {1: 0, 2: 0, 3: 0, 4: 1}


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.55,), (1.0,), (None,)], "p double")
    assert [r["bin"] for r in S.binned(df, "p").orderBy("p").collect()] == [None, 0, 0, 1, 5, 9]
    same = spark.createDataFrame([(0.3,), (0.3,)], "p double")
    assert {r["bin"] for r in S.binned(same, "p").collect()} == {4}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first()["c"]
    assert [get(S.score_bucket(F.lit(h), F.lit(a))) for h, a in ((0, 4), (0, 3), (1, 1), (2, 1), (5, 0))] == [0, 1, 4, 5, 7]
    assert [get(S.time_bucket(F.lit(m))) for m in (0, 15, 89.9, 90, 130)] == [0, 1, 5, 6, 6]
    assert [get(S.volatility_grade(F.lit(x))) for x in (0.0, 0.01, 0.19, 0.2)] == [0, 1, 4, 5]
    assert get(S.threat_grid(F.lit(100.0), F.lit(100.0))) == 0.65 and get(S.threat_grid(F.lit(None).cast("double"), F.lit(0.0))) == 0.0
    assert get(S.number(F.lit("x"), 10)) == 10.0 and get(S.truncated(F.lit("-2.9"))) == -2
    assert get(S.substring_weight(F.lit(None).cast("string"))) == 0.0 and get(S.substring_weight(F.lit("Own GOAL"))) == 1.0
    assert get(S.normalised_team(F.lit("FC  O'Neill-United 1900"))) == "oneill 1900"
    assert get(S.normalised_team(F.lit("Real Club"))) == ""
    state = get(S.markov_state(F.lit(None).cast("int"), F.lit(1), F.lit(0), F.lit(None).cast("double")))
    assert tuple(state) == (3, 1, 0)
    assert len(get(S.hour_range(F.to_timestamp(F.lit("2024-01-01 23:30:00"))))) == 4
    assert get(S.market_key(F.lit("0xABCDEF"))) == "abcdef"


def test_questions(spark):
    q = spark.createDataFrame([("A vs. B: O/U 2.5",), ("A vs B",), ("x: A vs. B: Draw",), ("no teams",)], "q string")
    got = [tuple(r["x"]) for r in q.select(S.parsed_question(F.col("q")).alias("x")).collect()]
    assert got == [("A", "B", "O/U 2.5"), ("A", "B", "unknown"), ("x: A", "B", "Draw"), (None, None, "unknown")]


def test_similarity_equals_difflib_and_its_bound_holds(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("manchester", "man chester")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", match.similarity(F.col("a"), F.col("b")).alias("s"), match.ratio_bound(F.col("a"), F.col("b")).alias("u")).collect():
        assert r["s"] == SequenceMatcher(None, r["a"], r["b"]).ratio() <= r["u"]


def test_match_prefers_same_day(spark):
    m = spark.createDataFrame([(1, "alpha", "beta"), (2, "xyzzy", "quux")], "market_id int, team_a string, team_b string").withColumn("date", F.to_date(F.lit("2024-03-01")))
    f = spark.createDataFrame([(10, "beta", "alpha", "2024-03-01"), (11, "alpha", "beta", "2024-03-02"), (12, "xyzzy", "quux", "2024-02-29")], "fixture_id int, home string, away string, d string")
    f = f.withColumn("date", F.to_date("d")).drop("d")
    assert {(r["market_id"], r["fixture_id"]) for r in match.match_by_date(m, f).collect()} == {(1, 10)}


def test_markov_rows_sum_to_one_and_absorbing_state(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "a", 0), (1, 4, "c", 0)], "k int, t int, state string, win int")
    v, t = markov.state_values(rows), markov.transitions(rows, "k", ["t"])
    assert {r["state"]: r["s"] for r in t.groupBy("state").agg(F.round(F.sum("p"), 9).alias("s")).collect()} == {"a": 1.0, "b": 1.0}
    e = {r["state"]: (r["expected"], r["delta"], r["volatility"]) for r in markov.expected(v, t).collect()}
    assert e["c"] == (0.0, 0.0, 0.0) and e["a"] == (0.5, 0.0, 0.25)


def test_confusion_sums_to_all(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (0, 0)], "predicted int, label int")
    assert sum(analytics.confusion(df).first()) == 5


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    sinks.overwrite(df, f"{tmp_path}/p")
    sinks.append(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    sinks.json_lines(df, f"{tmp_path}/j")
    sinks.csv(df, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/j").count() == spark.read.option("header", "true").csv(f"{tmp_path}/c").count() == 2
    (tmp_path / "c.json").write_text('{"history":[{"t":1778000000,"p":0.51},{"t":1778000060,"p":0.52}]}')
    assert [r["mid"] for r in readers.candles(spark, f"{tmp_path}/c.json").orderBy("timestamp").collect()] == [0.51, 0.52]


def test_minute_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000)).alias("ts"), (F.col("id") / 200).alias("mid_price"), (F.col("id") % 10 / 10).alias("prob"), (F.col("id") % 2).cast("int").alias("label"))
    rows.write.parquet(f"{tmp_path}/in")
    q = streams.minute_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    run = q.writeStream.outputMode("complete").format("memory").queryName("minutes").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted((str(r["window"]["start"]), round(r["mean_prob"], 9), r["n"]) for r in df.collect())
    assert key(spark.table("minutes")) == key(streams.minute_stream(rows))


def test_sliding_and_session_streams_equal_batch(spark, tmp_path):
    rows = spark.range(120).select(
        (F.col("id") % 3).alias("fixture_id"), F.timestamp_seconds(F.col("id") * F.when(F.col("id") > 60, 40).otherwise(5) + 1_700_000_000).alias("ts"),
        F.lit(1.5).alias("weight"), (F.col("id") / 500).alias("move"),
    )
    rows.write.parquet(f"{tmp_path}/in")
    for name, of in (("density", streams.density_stream), ("sessions", streams.session_stream)):
        q = of(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        q.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, of(rows).collect()))


def test_rolling_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f, i, i // 2 * 7 * US, i % 3 > 0, rng.random() if i % 3 == 0 else None, rng.choice([None, rng.random()]) if i % 3 else None) for i in range(120) for f in (1, 2)]
    df = spark.createDataFrame(rows, "fixture_id long, event_id long, us long, is_event boolean, price double, conf double")
    for part, (lo, hi) in enumerate(((0, 40), (40, 80), (80, 120))):
        df.where(f"event_id >= {lo} and event_id < {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    events = df.where("is_event").drop("price", "is_event")
    want = windows.with_trend(events, "fixture_id", "us", "event_id", "conf", 60, "conf_trend")
    want = asof.backward(want, df.where("not is_event").select("fixture_id", "event_id", "us", "price"), "fixture_id", "us", "price", "event_id")
    incoming = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # a file a batch, in the order in which they were written
    streams.rolling_stream(incoming).writeStream.format("memory").queryName("rolled").trigger(availableNow=True).start().awaitTermination()
    round_ = lambda d: sorted((r["fixture_id"], r["event_id"], round(r["price"], 9) if r["price"] is not None else None, round(r["conf_trend"], 9)) for r in d.collect())
    assert round_(spark.table("rolled")) == round_(want)
