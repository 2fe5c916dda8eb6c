"""Fill-in-middle, sort-means and host-level rules against brute force and on edge cases."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from helpers import SCHEMA, edge_rows, words  # noqa: E402

from tidemark.llm import fim, hosts, kmeans  # noqa: E402


@pytest.fixture(scope="module")
def edges(spark):
    """Edge rows with more columns, whose names operators use inside."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("_k", "_t", "i", "k", "_host", "_salt", "kept_", "v")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 --------------------------------------------------------------------------------------------


def filled(doc_id, text):
    """The digest of one document, and its output."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


def test_fim_equals_brute_force(spark, edges, empty, monkeypatch):
    rng = random.Random(4)
    bits = ["word", "é", "😀", "\n", "\r", "\x00", " ", "<P", ">", "<", "S>", "<M>", "<S>", "12", "日本", " ", "Z" * 50]
    rows = [(i, "".join(rng.choice(bits[: 12 if i % 3 else 17]) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(1000, "x y " * 200_000), (1001, "a" * 300_000), (1002, None), (7, "same"), (7, "same"), (None, "no id"), (-5, "negative id")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    monkeypatch.setattr(fim, "SLICE", 100)
    want = Counter(filled(i, t)[0] for i, t in rows)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fim.digest(fim.transform(df)).collect())) == want
    texts = {(r["doc_id"], r["output"]) for r in fim.transform(df).select("doc_id", "output").collect()}
    assert texts == {(i, filled(i, t)[1]) for i, t in rows}
    out = fim.transform(edges.withColumn("n", F.lit(3)))
    assert out.columns == [c for c in edges.columns] + fim.RESULTS.names and out.where("_k = 7 and _t = 7 and i = 7").count() == edges.count()
    assert Counter(map(tuple, fim.digest(fim.transform(edges)).collect())) == Counter(filled(i, t)[0] for i, t, *_ in edge_rows())
    assert fim.transform(empty).count() == 0


def test_fim_slices_are_bounded():
    import pyarrow as pa

    texts = pa.array(["a" * n for n in (10, 10, 95, 300, 1, 0, 5)])
    got = list(fim.slices(texts, 100))
    assert [n for _, n in got] == [2, 1, 1, 3] and [lo for lo, _ in got] == [0, 2, 3, 4]
    assert list(fim.slices(pa.array([], pa.string()), 100)) == []


def test_fim_rates(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words in a text").alias("text"))
    got = {(r["form"]): r["count"] for r in fim.transform(df, seed=9, rate=50, spm=100).groupBy("form").count().collect()}
    assert set(got) == {"plain", "spm"} and abs(got["spm"] - 1000) < 120


# 12 --------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds):
    """(cluster, distance) of each (id, integer vector), and the centroids, by all distances."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in vectors:
            held[near(v)[1]].append(v)
        for j, vs in held.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in vectors], cents


def run_means(spark, rows, dim, k, rounds):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, cents = kmeans.sort_means(df, k, rounds, dim)
    return Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), cents, (found, cents)


def test_sort_means_equals_all_distances(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(7, 3))
    rows = [(i, [float(x) for x in middles[i % 7] + rng.normal(size=3) / 10], 0) for i in range(300)]
    rows += [(300 + i, [0.25 * (i % 3), 0.0, 0.5], 0) for i in range(30)]  # ties and repeated vectors
    bad = [(900, None, 0), (901, [1.0, 2.0], 0), (902, [1.0, None, 2.0], 0), (903, [1.0, float("nan"), 2.0], 0), (904, [float("inf"), 0.0, 0.0], 0), (905, [], 0)]
    rows += [(5, [0.1, 0.2, 0.3], 0), (5, [0.1, 0.2, 0.3], 0), (None, [0.5, 0.5, 0.5], 0)]
    for k, rounds in ((16, 3), (1, 2), (5, 0)):
        got, cents, made = run_means(spark, rows + bad, 3, k, rounds)
        want, right = lloyd([(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows], k, rounds)
        assert got == Counter(want) and cents == right
        by = defaultdict(int)
        for _, c, d in want:
            by[c] += d
        for r in kmeans.with_inertia(*made).collect():
            assert r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values())
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, right[r["cluster"]])).encode()).hexdigest()


def test_sort_means_of_huge_few_and_no_vectors(spark):
    rows = [(i, [float((-1) ** i * 10.0**12 * (i + 1)), 3.0 * i], 0) for i in range(12)] + [(50, [1e-9, -1e-9], 0)]
    got, cents, _ = run_means(spark, rows, 2, 4, 3)
    want, right = lloyd([(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows], 4, 3)
    assert cents == right and got == Counter((i, c, min(d, (1 << 63) - 1)) for i, c, d in want)
    beyond, _, _ = run_means(spark, [(1, [1e300, 0.0], 0), (2, [-1e300, 0.0], 0), (3, [0.0, 0.0], 0)], 2, 2, 1)
    assert sum(beyond.values()) == 3
    few, cents, _ = run_means(spark, rows[:2], 2, 16, 3)
    assert len(cents) == 2 and sorted(d for *_, d in few) == [0, 0]
    none, cents, made = run_means(spark, [(1, None, 0)], 2, 16, 3)
    assert not none and cents == [] and kmeans.with_inertia(*made).count() == 0
    with pytest.raises(ValueError):
        run_means(spark, rows, 2, kmeans.MODEL, 1)


def test_sort_means_avoids_distances():
    """On clustered vectors most centroids lie beyond twice a vector's distance to its own, and results are those of a full scan."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-1000, 1000, size=(32, 8))
    x = middles[rng.integers(0, 32, 4000)] + rng.integers(-5, 6, size=(4000, 8))
    plan = kmeans.Plan(middles.tolist())
    first, distance, all_of_them = plan.assign(x, np.zeros(4000, np.int32))
    again, same, few = plan.assign(x, first)
    full = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (full.argmin(axis=1) == first).all() and (again == first).all() and (distance == full.min(axis=1)).all() and (same == distance).all()
    assert few < 1.1 * len(x) and few < all_of_them / 5


# 13 --------------------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    blank = "\x20\x09-\x0d"
    w = re.findall(f"[^{blank}]+", text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(f"[^{blank}]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark, edges):
    rng = random.Random(7)
    bits = ["a", "A", "b c", " ", "\n", "\n", "\t", "é", "日本", "#", "<x>", "\r", "\x00", "　", "😀 ", "a b a b a b "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", "\n", "\n\n a\n a\n", "x " * 100_000, "one two three one two three", "end\n", "a\n\na"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    for r in hosts.measure(df, "doc_id").collect():
        assert tuple(r[c] for c in hosts.COUNTS) == counted(texts[r["doc_id"]]), repr(texts[r["doc_id"]])
    got = Counter((r["doc_id"], *(r[c] for c in hosts.COUNTS)) for r in hosts.measure(edges, "doc_id").collect())
    assert got == Counter((i, *counted(t)) for i, t, *_ in edge_rows())


def verdicts(docs):
    """kept by doc_id, with exact fractions where the operator has floating numbers."""
    rows = [(i, host, dict(zip(hosts.COUNTS, counted(t), strict=True))) for i, t, host in docs]
    fails = lambda rule, c, strict=0: eval(hosts.RULES[rule][strict].replace(" OR ", " or "), {}, c)  # noqa: E731, S307
    n_of = Counter(h for _, h, _ in rows)
    bad = defaultdict(set)
    for rule in hosts.RULES:
        f_of = Counter(h for _, h, c in rows if fails(rule, c))
        n, f = len(rows), sum(f_of.values())
        m = Fraction(f, n)
        between = sum(Fraction(f_of[h] ** 2, n_of[h]) for h in n_of) / n - m * m - m * (1 - m) * len(n_of) / n
        size = m * (1 - m) / between - 1 if between > 0 else Fraction(int(hosts.STRONGEST))
        size = min(max(size, Fraction(int(hosts.WEAKEST))), Fraction(int(hosts.STRONGEST)))
        a, b = (m * size, (1 - m) * size) if 0 < f < n else ((0, 1) if not f else (1, 0))
        for h in n_of:
            if (f_of[h] + a) / (n_of[h] + a + b) >= hosts.LIMIT:
                bad[h].add(rule)
    return {i: not any(fails(r, c) for r in hosts.BASE) and not any(fails(r, c, 1) for r in bad[h]) for i, h, c in rows}, bad


def host_docs():
    rng = random.Random(5)
    clean = lambda i, n=120: words(n, f"d{i}")
    noisy = lambda i: words(100, f"n{i}") + " #" * 8
    noisier = lambda i: words(100, f"m{i}") + " #" * 20
    docs = [(i, clean(i), f"good{i % 5}") for i in range(60)]
    docs += [(100 + i, noisier(i) if rng.random() < 0.9 else clean(i), "bad") for i in range(40)]
    docs += [(200, noisy(1), "bad"), (201, clean(201), "bad"), (202, noisy(2), "good0"), (203, noisier(3), "small"), (204, noisy(4), "small"), (205, "few words", "good1"), (206, "again and " * 60, "good1")]
    return docs + [(300, clean(300), None), (301, None, None), (302, noisier(302), "https://WWW.bad.org/x"), (303, noisy(303), "https://www.bad.org/y?z")]


def test_host_verdicts_equal_brute_force(spark, empty, monkeypatch):
    docs = host_docs()
    df = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], SCHEMA)
    want, bad = verdicts([(i, t, re.sub("^https://([^/]+).*", r"\1", s.lower()) if s and "//" in s else s) for i, t, s in docs])
    assert "symbols" in bad["bad"] and not bad["good0"]
    for limit in (1 << 24, 0):  # by broadcast, and by a shuffle with salt
        monkeypatch.setattr(hosts, "BROADCAST_BYTES", limit)
        got = {r["doc_id"]: r for r in hosts.digest(df).collect()}
        assert {i: r["kept"] for i, r in got.items()} == want
    # on the bad host a doubtful document goes and a clean one stays; elsewhere the doubtful one stays
    assert not want[200] and want[201] and want[202] and not want[205] and not want[206] and want[300] and not want[301]
    assert hosts.digest(empty).count() == 0


def test_host_rates_shrink_by_size():
    """A host of one failing document is judged by what hosts are like; one of many by its own rate."""
    a, b = hosts.prior(100, 10_000, 1000, 150.0)
    assert a / (a + b) == pytest.approx(0.1) and (1 + a) / (1 + a + b) < 0.2 and (900 + a) / (1000 + a + b) > 0.85
    assert hosts.prior(3, 0, 0, 0.0) == (0.0, 1.0) and hosts.prior(1, 5, 5, 5.0) == (1.0, 0.0)
    alike = hosts.prior(10, 1000, 100, 10.0)  # no variance between hosts: the strongest prior
    assert sum(alike) == pytest.approx(hosts.STRONGEST)


def test_judge_keeps_columns(spark, edges):
    out = hosts.judge(edges, F.col("source"), "doc_id", "text", "_host", "_salt", "kept_")
    assert out.count() == edges.count() and out.where("_host = 7 and _salt = 7 and kept_ = 7").count() == edges.count()
    assert out.where("text is null and kept").count() == 0
