"""Exact quantiles, splits, folds, the model registry, the hour store, markers and files' first rows."""

import datetime as dt
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import analytics, markov, ml, quantiles, stores
from tidemark.operators import frames as fr
from tidemark.sources import readers, synthetic


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    rows = [(g, x) for g, n in (("a", 500), ("b", 1), ("c", 2), (None, 37), ("ties", 300)) for x in ([round(rng.gauss(0, 1), 2) for _ in range(n)] if g != "ties" else [rng.choice([0.0, 1.0]) for _ in range(n)])]
    df = spark.createDataFrame([*rows, ("a", None), ("none", None)], "g string, x double")
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.95, "q10": 1.0}
    for splits in (None, [], [0.0, 0.5], [-1.0]):
        got = {r["g"]: [r[q] for q in shares] for r in quantiles.quantiles(df, "x", shares, "g", splits=splits).collect()}
        assert set(got) == {"a", "b", "c", None, "ties"}
        for g, q in got.items():
            assert q == pytest.approx([float(np.quantile([x for h, x in rows if h == g], s)) for s in shares.values()])
    whole = quantiles.quantiles(df, "x", shares).collect()
    assert [list(r) for r in whole] == [pytest.approx([float(np.quantile([x for _, x in rows], s)) for s in shares.values()])]
    nothing = analytics.described(df.where("g = 'none'"), "x").first()
    assert nothing["count"] == 0 and nothing["median"] is None


def test_quantiles_hold_no_group_in_one_place(spark):
    """A group's distinct values reach no window but in a bucket's share."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.xxhash64("id").cast("double").alias("x"))
    splits = quantiles.split_points(df, "x")
    assert len(splits) > 900
    sizes = quantiles._bucketed(df, "x", splits).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 200_000 / 200
    got = quantiles.quantiles(df, "x", {"m": 0.5}, "g", splits=splits).first()["m"]
    assert got == pytest.approx(df.agg(F.median("x")).first()[0])


def hashed(seed, k):
    return int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16)


def test_group_and_validation_splits_are_exact(spark):
    df = spark.createDataFrame([(k, i) for k in range(101) for i in range(1 + k % 3)] + [(None, 0)], "k int, i int")
    order = sorted(range(101), key=lambda k: (hashed(42, k), str(k)))
    got = {r["k"] for r in ml.group_split(df, "k").where("is_train").select("k").distinct().collect()}
    assert got == set(order[:70]) and ml.group_split(df, "k").count() == df.count()
    split = {r["k"]: r["split"] for r in ml.multi_split(df, "k", {"train": 0.5, "middle": 0.25}).collect()}
    assert split[None] is None
    assert [split[k] for k in order] == ["train"] * 50 + ["middle"] * 25 + [None] * 26
    assert ml.group_split(df.where("false"), "k").count() == 0


def test_folds_expand_over_time(spark):
    rows = [(f % 7, 10_000 - 10 * i if i % 2 else 5000, i) for i, f in enumerate(range(103))]
    df = spark.createDataFrame(rows, "fixture_id int, us long, event_id long")
    assert ml.n_folds(df) == 3 and ml.n_folds(df.where("fixture_id < 2")) == 2 and ml.n_folds(df.withColumn("fixture_id", F.col("event_id"))) == 5
    got = {r["event_id"]: r["fold"] for r in ml.with_fold(df, "us", "event_id", 3).collect()}
    order = [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]
    size = 103 // 4
    assert [got[i] for i in order] == [0] * (103 - 3 * size) + [1] * size + [2] * size + [3] * size
    assert {r["fold"] for r in ml.with_fold(df.limit(2), "us", "event_id", 5).collect()} == {0}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        x, y = rng.random(), rng.random()
        rows.append((i % 12, i, i * 1000, x, None if i % 50 == 0 else y, int(x + 0.3 * y + 0.2 * rng.random() > 0.8)))
    return spark.createDataFrame(rows, "fixture_id int, event_id long, us long, x double, y double, label int")


def test_cross_validation_scores_later_rows_only(labelled):
    out = ml.cross_validate(labelled, ["x", "y"], only=("logistic_regression",)).collect()
    assert sorted(r["fold"] for r in out) == [1, 2, 3, 4, 5] and {r["folds"] for r in out} == {5}
    assert [r["n_train"] for r in sorted(out, key=lambda r: r["fold"])] == [100, 200, 300, 400, 500] and all(r["n_test"] == 100 for r in out)
    assert all(r["roc_auc"] > 0.8 and r["f1"] > 0.6 for r in out)


def test_cross_validation_keeps_folds_of_one_class(labelled):
    """Folds before which there is one class only, and folds of one class, have their rows."""
    only = ("logistic_regression",)
    one = ml.cross_validate(labelled.withColumn("label", F.lit(1)), ["x", "y"], only=only).collect()
    assert sorted((r["fold"], r["n_train"], r["n_test"], r["f1"], r["roc_auc"]) for r in one) == [(i, 100 * i, 100, None, None) for i in range(1, 6)]
    late = labelled.withColumn("label", F.when(F.col("us") < 250_000, 1).when(F.col("us") < 400_000, 0).otherwise(1))
    got = {r["fold"]: r for r in ml.cross_validate(late, ["x", "y"], only=only).collect()}
    assert [got[i]["f1"] is None for i in range(1, 6)] == [True, True, False, False, False]
    assert got[3]["roc_auc"] == got[3]["average_precision"] == 0.0 and got[4]["roc_auc"] == 0.0 and got[4]["average_precision"] == 1.0
    nothing = ml.cross_validate(labelled.where("false"), ["x", "y"], only=only).collect()
    assert [(r["n_test"], r["f1"]) for r in nothing] == [(0, None)] * 2


def test_registry_gives_equal_probabilities_and_the_best_run(labelled, spark, tmp_path):
    rows = ml.multi_split(ml.complete(labelled, ["x", "y"]), "fixture_id", {"train": 0.5, "middle": 0.25})
    assert rows.count() == 588
    store = ml.Registry(spark, str(tmp_path / "registry"))
    train, test = rows.where("split = 'train'"), rows.where("split is null")
    only = {k: v for k, v in ml.models(["x", "y"], 5).items() if k in ("logistic_regression", "random_forest")}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ml, "models", lambda *_: only)
        out = ml.train_and_evaluate(train, test, ["x", "y"], 5, middle=rows.where("split = 'middle'"), into=store)
    found = {r["model"]: r for r in out.collect()}
    assert set(found) == set(only) and all(r["f1_chosen"] <= r["f1"] + 1e-9 and 0 <= r["threshold_chosen"] <= 1 for r in found.values())
    store.record(out, "first")
    store.record(spark.createDataFrame([("later", 0.1), ("other", 2.0)], "model string, f1 double"), "second")
    assert store.history().count() == 4 and store.best().first()["model"] == "other"
    best = store.best(run="first").first()
    assert best["model"] == max(found.values(), key=lambda r: (r["f1"], r["model"] == "logistic_regression"))["model"]
    fitted = only["logistic_regression"].fit(ml.class_weight(train))
    store.save("again", fitted)
    a = {r["event_id"]: r["prob"] for r in ml.score(fitted, test, 0.5).collect()}
    b = {r["event_id"]: r["prob"] for r in ml.score(store.load("again"), test, 0.5).collect()}
    assert a == b and len(a) > 50


def test_minutes_add_in_order_of_events(spark):
    """A mean that lies at the threshold is the one of a sum from the first event to the last, wherever the rows lie."""
    rows = [(i % 3, i, dt.datetime(2024, 1, 1, 0, i // 180), (52 + (i // 3) % 2 * (i // 180 - 20) - (i // 3 % 2 == 0) * (i // 180 - 20)) / 100, 1) for i in range(180 * 40)]
    want = {f: [0, 0] for f in range(3)}
    for f in range(3):
        for minute in range(40):
            probs = [p for g, _, t, p, _ in rows if g == f and t.minute == minute]
            total = 0.0
            for p in probs:
                total += p
            want[f][total / len(probs) < 0.52] += 1
    df = spark.createDataFrame(rows, "fixture_id int, event_id long, ts timestamp, prob double, label int").repartition(7).withColumn("mid_price", F.col("prob"))
    got = {r["fixture_id"]: [r["hits"], r["misses"]] for r in analytics.hit_or_miss(df).collect()}
    assert got == want and all(min(v) > 0 for v in want.values())


def test_metrics_of_models_compute_nothing_again(labelled, monkeypatch):
    """Rows of metrics are read back: choosing the best one doesn't score the test rows again."""
    rows = ml.multi_split(ml.complete(labelled, ["x", "y"]), "fixture_id", {"train": 0.5, "middle": 0.25})
    only = {k: v for k, v in ml.models(["x", "y"], 5).items() if k == "logistic_regression"}
    monkeypatch.setattr(ml, "models", lambda *_: only)
    out = ml.best_model(ml.train_and_evaluate(rows.where("split = 'train'"), rows.where("split is null"), ["x", "y"], 5, middle=rows.where("split = 'middle'")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "Window" not in plan and out.first()["is_best"]


def test_hour_store_reads_no_hour_twice(spark, tmp_path):
    day = dt.datetime(2026, 5, 1, 10, 30)
    markets = spark.createDataFrame([(1, "m1", day), (1, "m2", day), (2, "m3", day + dt.timedelta(hours=20)), (2, "quiet", day), (3, "m1", None)], "fixture_id int, market string, at timestamp")
    wanted = stores.fan_out(markets)
    assert wanted.count() == 16 and stores.ids_by_fixture(wanted).where("fixture_id = 1").first()["markets"] == ["m1", "m2"]
    files = tmp_path / "files"
    prices = [(h, m, 0.5 + i / 100) for i, (h, m) in enumerate((f"2026-05-01T{h:02d}", m) for h in range(24) for m in ("m1", "m2", "m9"))] + [("2026-05-02T06", "m3", 0.9)]
    for h in {p[0] for p in prices}:
        spark.createDataFrame([p for p in prices if p[0] == h], "hour string, market string, price double").coalesce(1).write.parquet(f"{files}/{h}")
    asked = []

    def source(hours):
        asked.append(hours)
        held = [f"{files}/{h}" for h in hours if (files / h).exists()]
        return spark.read.parquet(*held) if held else spark.createDataFrame([], "hour string, market string, price double")

    store = stores.HourStore(spark, str(tmp_path / "store"))
    first = wanted.where("market = 'm1'")
    assert store.fill(first, source) == [f"2026-05-01T{h:02d}" for h in range(9, 13)]
    assert len(store.fill(wanted, source)) == 8 and store.fill(wanted, source) == [] and len(asked) == 2
    # hours without prices, and a market without any, aren't asked for again; what an hour held stays when another market is added
    got = Counter((r["fixture_id"], r["market"], r["hour"]) for r in store.prices(wanted).collect())
    assert got == Counter({(1, m, f"2026-05-01T{h:02d}"): 1 for m in ("m1", "m2") for h in range(9, 13)} | {(2, "m3", "2026-05-02T06"): 1})
    plan = store.prices(wanted.where("fixture_id = 2"))._jdf.queryExecution().toString()
    assert "hour" in plan


def test_markers_sample_each_fixture(spark):
    rows = [(f, 1000 * f + i, "Timer" if i % 10 == 0 else "Shot", 5.0 if i % 9 == 0 else None if i % 7 == 0 else 0.5) for f, n in ((1, 400), (2, 50), (3, 101)) for i in range(n)]
    df = spark.createDataFrame(rows + [rows[1]] + [(None, 1, None, 0.1)], "fixture_id int, event_id long, incident string, weight double")
    got = Counter(tuple(r) for r in analytics.markers(df, ("Timer",), 20).collect())
    want = Counter()
    for f in (1, 2, 3, None):
        mine = [tuple(r) for r in df.where(F.col("fixture_id").eqNullSafe(F.lit(f))).where("incident is null or incident <> 'Timer'").collect()]
        light = sorted((r for r in mine if r[3] is None or r[3] < 2), key=lambda r: (hashed(42, r[1]), r[1]))
        last = (hashed(42, light[19][1]), light[19][1]) if len(light) > 19 else (1 << 61, 0)
        want.update(r for r in mine if (r[3] is not None and r[3] >= 2) or (hashed(42, r[1]), r[1]) <= last)
    assert got == want


def test_first_rows_of_files(spark, tmp_path):
    root = str(tmp_path / "m")
    for day, fixture, home in (("2026-05-01", 7, "Ajax"), ("2026-05-02", 8, "PSV")):
        spark.range(500).select(F.when(F.col("id") == 0, home).otherwise(F.lit("later")).alias("home"), F.lit(day).alias("event_date"), "id").coalesce(1).write.parquet(f"{root}/{day}/{fixture}")
    got = sorted(tuple(r)[1:] for r in readers.first_rows(spark, root, "home", "event_date", "nothing").collect())
    assert got == [("2026-05-01", 7, "Ajax", "2026-05-01", None), ("2026-05-02", 8, "PSV", "2026-05-02", None)]


def test_analytic_states_and_synthetic_matches(spark):
    rows = spark.createDataFrame([(3, 1, 0), (7, 1, 0), (0, 3, 5), (2, 9, 1)], "score int, period int, time int")
    assert sorted(r["win_prob"] for r in markov.with_analytic(rows).collect()) == pytest.approx([0.26, 0.5, 0.5, 0.62])
    two = synthetic.matches(spark.createDataFrame([(5,), (9,), (5,)], "match_id long"), 40)
    assert two.count() == 80 and two.where("price < 0.01 or price > 0.99 or confidence < 0 or confidence > 1").isEmpty()
    base = markov.simulated_prices(spark.range(5000).select(F.lit(1).alias("k"), "id", F.lit(0.5).alias("win_prob")), "k", ["id"])
    noise = base.agg(F.avg(F.col("simulated_price") - F.col("market_base")), F.stddev(F.col("simulated_price") - F.col("market_base"))).first()
    assert abs(noise[0]) < 4 * 0.02 / 5000**0.5 and abs(noise[1] - 0.02) < 0.001


def test_synthetic_sums_follow_the_steps_without_a_sort(spark):
    """Running sums of 1 to 40 steps against the windows that they stand for; no plan sorts, and few ids still make several tasks."""
    ids = spark.createDataFrame([(5,), (9,), (None,), (5,)], "match_id long")
    for n in (1, 2, 3, 4, 5, 16, 17, 40):
        got = synthetic.matches(ids, n)
        w = Window.partitionBy("match_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        goal = lambda side: F.sum(((F.col("event_type") == "GOAL") & side).cast("int")).over(w)
        home = synthetic._u(42, "side") < 0.55
        want = got.select("match_id", "step", F.sum(-18.0 * F.log(synthetic._u(42, "gap"))).over(w).alias("elapsed_time"), goal(home).alias("score_home"), goal(~home).alias("score_away"))
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() == 3 * n
    plan = synthetic.matches(ids)._jdf.queryExecution().sparkPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    assert synthetic.matches(spark.range(500).select(F.col("id").alias("match_id"))).rdd.getNumPartitions() == 4


def test_frames_ends():
    assert fr.between(1) == (-1_000_001, 0) and fr.between(1, "left") == (-1_000_001, -1) and fr.between(1, "right", ahead=True) == (0, 1_000_000)
