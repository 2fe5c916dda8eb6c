"""Readers over files of their own, fuzzy matching against difflib, and the growing form of the trend."""

import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cells, markov, match, names, windows
from tidemark.plans import registry
from tidemark.sources import readers, sinks


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_messages_by_path(spark, tmp_path):
    root = str(tmp_path / "messages")
    for day, fixture, n in (("2026-05-01", 7, 30), ("2026-05-02", 8, 5)):
        spark.range(n).select(F.col("id").alias("seq")).coalesce(1).write.parquet(f"{root}/{day}/{fixture}")
    got = readers.messages(spark, root).groupBy("event_date", "fixture_id").count().collect()
    assert {(r["event_date"], r["fixture_id"], r["count"]) for r in got} == {("2026-05-01", 7, 30), ("2026-05-02", 8, 5)}
    assert readers.fixture(spark, root, "2026-05-01", 7).count() == 30
    assert readers.fixture(spark, root, "2026-05-02", 8) is None and readers.fixture(spark, root, "2026-05-03", 1) is None


def test_first_files_of_a_sport(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        spark.range(10).select((F.col("id") + 10 * i).alias("id"), (F.col("id") % 2).alias("sportId")).coalesce(1).write.parquet(f"{root}/f{i}")
    got = sorted(r["id"] for r in readers.first_files(spark, root, 2, sport=1).collect())
    assert got == [i for i in range(20) if i % 2 == 1]


def test_candles_markets_and_order_book(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"history": [{"t": 1778000000, "p": 0.51}, {"t": 1778000060, "p": 0.52}]}))
    got = readers.candles(spark, str(tmp_path / "c.json")).orderBy("timestamp").collect()
    assert [r["mid"] for r in got] == [0.51, 0.52] and (got[1]["timestamp"] - got[0]["timestamp"]).seconds == 60
    (tmp_path / "m.json").write_text(json.dumps([{"condition_id": "0xAB", "question": "A vs. B: x"}, {"condition_id": "c", "question": None}]))
    assert readers.markets(spark, str(tmp_path / "m.json")).count() == 2
    when = dt.datetime(2026, 5, 1, tzinfo=dt.UTC)
    rows = [(when, when, b"m1", "price_change", "a", 0.5, 1.0, "B", 0.4, 0.6), (when, when, b"m2", "price_change", "a", 0.5, 1.0, "B", 0.4, 0.6), (when, when, b"m1", "book", "a", 0.5, 1.0, "B", 0.4, 0.6)]
    path = str(tmp_path / "book")
    spark.createDataFrame(rows, readers.ORDER_BOOK).write.parquet(path)
    got = readers.price_changes(spark, [path], spark.createDataFrame([("m1",)], "market string")).collect()
    assert [r["market"] for r in got] == ["m1"]


def test_markov_chain_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, i % 3, i % 2) for i in range(9)], "k int, t int, state int, win int")
    values, moves = markov.state_values(rows), markov.transitions(rows, "k", ["t"])
    markov.save(values, moves, str(tmp_path / "chain"))
    a, b = markov.load(spark, str(tmp_path / "chain"))
    assert a.exceptAll(values).isEmpty() and b.exceptAll(moves).isEmpty() and b.count() == moves.count()
    assert sinks.extended(a, b).count() == a.count() + b.count()


def test_aliases_and_timestamps(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "2026-05-01 10:00:00")], "MatchId string, CreatedAt string")
    out = S.first_timestamp(S.renamed(df, {"matchid": "match_id"}))
    assert [r["match_id"] for r in out.collect()] == ["2"]
    assert S.first_timestamp(df.select("MatchId")).count() == 2
    got = spark.createDataFrame([("UEFA champions league U19",), (None,), ("Cup",)], "n string").select(S.major_league(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in got] == [True, False, False]


NAMES = ["arsenal", "arsenal london", "chelsea", "chelsey", "leeds", "leicester", "real madrid", "real betis", "ajax", "psv"]


def best_pairings(fixtures, markets, least=0.65):
    """Each fixture's (score, first market) by all pairs of team names."""
    groups = {}
    for j, a, b, *_ in sorted(markets):
        groups.setdefault((a.lower(), b.lower()), j)
    sims, best, want = {}, {}, {}

    def sim(x, y):
        if (x, y) not in sims:
            sims[x, y] = ratio(x, y)
        return sims[x, y]

    for i, home, away, _ in fixtures:
        h, w = home.lower(), away.lower()
        if (h, w) not in best:
            scores = [(-(sim(h, a) + sim(w, b)) / 2, j) for (a, b), j in groups.items() if sim(h, a) >= least and sim(w, b) >= least]
            best[h, w] = min(scores) if scores else None
        if best[h, w]:
            want[i] = (round(-best[h, w][0], 3), best[h, w][1])
    return want


def test_fixture_matchups_equal_difflib_on_whole_tables(spark, sf):
    f, m = registry._fixtures(spark, sf), registry._markets(spark, sf)
    got = {r["fixture_id"]: (r["match_score"], r["market_ids"][0]) for r in registry.QUERIES["fuzzy_fixture_matchups"](spark, sf).collect()}
    want = best_pairings([tuple(r) for r in f.collect()], [(r["market_id"], r["team_a"], r["team_b"]) for r in m.collect()])
    assert len(got) > 500 and got == want


def test_fixture_matchups_list_each_market_once_and_expand_to_all(spark, tmp_path, sf):
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), F.lit(dt.date(2026, 5, 1)).alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    for at in (str(tmp_path), sf):
        f, m = registry._fixtures(spark, at), registry._markets(spark, at)
        got = registry.QUERIES["fuzzy_fixture_matchups"](spark, at)
        held = got.agg(F.sum(F.size("market_ids")), F.sum(F.size("questions"))).first()
        assert max(held) <= m.count() + f.count()
        whole = match.fixture_matchups(f, match.pairings(m)).collect()
        assert sorted(map(repr, match.expanded(got).collect())) == sorted(map(repr, whole))
        assert {r["fixture_id"]: r["n_markets"] for r in got.collect()} == {r["fixture_id"]: len(r["market_ids"]) for r in whole} and len(whole) > 150


def test_fixture_classes_of_odd_rows(spark):
    """Repeated and null ids, names in other cases, null names and questions."""
    f = spark.createDataFrame([(1, "Ajax", "PSV"), (1, "AJAX", "psv"), (None, "ajax", "psv"), (2, "ajaxx", "psv"), (None, "leeds", "chelsea"), (None, "Leeds", "chelsea"), (3, None, "psv"), (4, "xyz", "q")], "fixture_id long, home string, away string")
    m = spark.createDataFrame([(7, "ajax", "psv", None), (5, "AJAX", "PSV", "b"), (None, "ajax", "psv", "c"), (8, "leeds", "chelsea", "d"), (9, None, "psv", "e")], "market_id long, team_a string, team_b string, question string")
    got, whole = match.expanded(match.fixture_classes(f, m)).collect(), match.fixture_matchups(f, match.pairings(m)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, whole)) and len(got) == 6


def test_market_matches_equal_difflib_on_whole_tables(spark, sf):
    """By date, with neighbours only where a date has no fixture."""
    f, m = [tuple(r) for r in registry._fixtures(spark, sf).collect()], [tuple(r) for r in registry._markets(spark, sf).select("market_id", "team_a", "team_b", "date").collect()]
    got = {r["market_id"]: (r["fixture_id"], r["score"]) for r in match.match_by_date(registry._markets(spark, sf), registry._fixtures(spark, sf)).collect()}
    by, want = {}, {}
    for x in f:
        by.setdefault(x[3], []).append(x)
    for i, a, b, day in m:
        held = by.get(day) or by.get(day - dt.timedelta(1), []) + by.get(day + dt.timedelta(1), [])
        best = None
        for j, home, away, _ in held:
            s = ratio(a, home), ratio(b, away), ratio(a, away), ratio(b, home)
            score = max(s[0] + s[1], s[2] + s[3]) / 2
            if (min(s[:2]) > 0.35 or min(s[2:]) > 0.35) and score >= 0.5 and (best is None or (-score, j) < best):
                best = (-score, j)
        if best:
            want[i] = (best[1], round(-best[0], 4))
    assert len(got) > 300 and got == want


@pytest.mark.parametrize("least", [0.35, 0.5, 0.65, 0.8])
def test_similar_names_lose_no_pair(spark, least):
    rng = random.Random(8)
    some = ["", "a", "b", "ab", "ba", "abc", "éa", "日本", "日本人", "aa", "aaa", "  ", "a b", "11", "1 1", "ajax", "psv", None]
    some += ["".join(rng.choice("abcdeé 1") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    left, right = some[:50] + some[:5], some[5:] + [""]
    a, b = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((left, "a"), (right, "b")))
    got = {(r["a"], r["b"]): r["score"] for r in names.similar_names(a, b, "a", "b", least).collect()}
    want = {(x, y): ratio(x, y) for x in left for y in right if x is not None and y is not None and ratio(x, y) >= least}
    assert got == want


def test_scored_names_grow_with_matches_not_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "BUCKET", 20)
    rng = random.Random(9)
    counts = []
    for n in (300, 600):
        clubs = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(n)]
        a = spark.createDataFrame([(c,) for c in clubs], "a string")
        b = spark.createDataFrame([(c[:9] + "x" + c[9:],) for c in clubs], "b string")
        scored = names.candidate_names(a, b, "a", "b", 0.65)
        counts.append(scored.count())
        assert scored.distinct().count() == counts[-1] and n <= counts[-1] <= 1.2 * n
    assert counts[1] < 2.3 * counts[0]


def test_matching_equals_difflib(spark):
    rng = random.Random(4)
    day = dt.date(2026, 5, 1)
    fixtures = [(i, rng.choice(NAMES), rng.choice(NAMES), day + dt.timedelta(rng.randint(0, 6)) if i else None) for i in range(40)]
    markets = [(100 + i, (a := rng.choice(NAMES)), (b := rng.choice(NAMES)), day + dt.timedelta(rng.randint(0, 6)), f"{a} vs. {b}: win") for i in range(40)]
    f = spark.createDataFrame(fixtures, "fixture_id long, home string, away string, date date")
    m = spark.createDataFrame(markets, "market_id long, team_a string, team_b string, date date, question string")

    got = {r["fixture_id"]: (r["market_id"], r["match_score"]) for r in match.best_question(f, m).collect()}
    want = {}
    for i, home, away, date in fixtures:
        best = (0.4, None)
        for j, _, _, when, q in markets:
            if date is None or abs((when - date).days) > 2:
                continue
            side = lambda x, q=q: max(ratio(x, q), 0.6 * any(len(w) > 3 and w in q for w in x.split()))
            score = (side(home) + side(away)) / 2
            if score > best[0]:
                best = (score, j)
        if best[1] is not None:
            want[i] = (best[1], round(best[0], 3))
    assert got == want

    groups = match.pairings(m)
    assert sum(len(r["market_ids"]) for r in groups.collect()) == len(markets)
    got = {r["fixture_id"]: (r["match_score"], r["market_ids"][0]) for r in match.fixture_matchups(f, groups).collect()}
    assert got == best_pairings(fixtures, markets)

    alone = {r["market_id"]: (r["fixture_id"], r["score"]) for r in match.match_by_date(m, f).collect()}
    fanned = {r["market_id"]: (r["fixture_id"], r["score"]) for r in match.match_matchups(m, f).collect()}
    assert fanned == alone


def test_best_by_cell_equals_all_pairs(spark, monkeypatch):
    """Cells cut into parts of both sides, names beyond 63 characters, empty and repeated ones; few pairs are scored."""
    monkeypatch.setattr(cells, "LEFT", 7)
    monkeypatch.setattr(cells, "RIGHT", 5)
    rng = random.Random(12)
    pick = lambda: rng.choice(["", "é日", "abc" * 40, *NAMES]) + "".join(rng.choice("abcé 1") for _ in range(rng.randint(0, 9)))
    left = [(i, pick() if i % 9 else None, i % 3 if i % 10 else None) for i in range(60)]
    right = [(i, pick() if i % 9 else None, i % 4) for i in range(60)] + [(100, right_name, 1) for right_name in ("ajax", "ajax")]
    a, b = spark.createDataFrame(left, "id long, name string, block int"), spark.createDataFrame(right, "cand_id long, cand_name string, block int")
    for least in (0.0, 0.4, 0.7):
        got = {r["id"]: (r["cand_id"], r["score"]) for r in match.best_match(a, b, "block", least).collect()}
        want = {}
        for i, name, block in left:
            found = [(-ratio(name, c), j) for j, c, k in right if name is not None and c is not None and k == block and ratio(name, c) >= least]
            if found:
                want[i] = (min(found)[1], round(-min(found)[0], 4))
        assert got == want


def test_search_scores_few_pairs():
    names_ = [f"supplier {i:09d}" for i in range(0, 5000, 25)]
    held, scored = cells.Names(names_), []
    for i in range(0, 50_000, 1000):
        name = f"customer {i:09d}"
        bounds = held.bounds(name)
        best = cells.search(bounds, lambda j: scored.append(j) or cells.ratio(name, names_[j]), 0.4)  # noqa: B023
        assert best == min(((j, ratio(name, x)) for j, x in enumerate(names_)), key=lambda r: (-r[1], r[0]))
    assert len(scored) < 50 * 200 / 5


def test_growing_trend_equals_framed_trend(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 2), i, rng.randint(0, 40) * 5_000_000, rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, id long, us long, x double")
    for closed in ("both", "left"):
        out = windows.with_trend(df, "k", "us", "id", "x", 60, "a", closed).withColumn("b", windows.trend("us", "id", "x", windows.past("k", "us", 60, closed)))
        assert out.where("abs(a - b) > 1e-9").isEmpty() and out.count() == 300
