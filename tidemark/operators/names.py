"""Similarity joins of names without blocks: an index of shared characters finds the pairs that a Ratcliff-Obershelp ratio can reach.

Names of lengths n and m whose ratio is at least t share at least t (n + m) / 2 characters, counted with repeats. So of each name's
characters (each with the number of its occurrence), put in one order, rarest first, a prefix suffices: if o must be shared, prefixes of
n - o + 2 share two. Pairs of characters of the prefix are the keys of the join; names so short that one shared character may do have single ones.
A pair of names is kept at its first common key alone, if it passes the bounds on lengths, shared characters and
Levenshtein distance (what the ratio leaves unmatched can be deleted and inserted). Only then is the ratio computed, by the library's one
Python expression. The bounds are exact: no pair is lost. A key that many names hold is dealt to several tasks.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship

#: names of one key that a task holds against the other side's
BUCKET = 2000
EPS = 1e-9


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    cache: dict = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if (x, y) not in cache:
            cache[x, y] = None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
        out.append(cache[x, y])
    return pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio; the order of arguments matters."""
    ship(SparkSession.active())
    return _ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """Never below the ratio: lets a filter on lengths go first."""
    return F.coalesce(F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(1.0))


def characters(name: Column) -> Column:
    """A name's characters, sorted, each with the number of its occurrence: a set that stands for the multiset."""
    chars = F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    # the sorted array is bound once, by an array of it alone
    return F.flatten(F.transform(F.array(F.array_sort(chars)), lambda s: F.transform(s, lambda c, i: F.concat(c, (i + 1 - F.array_position(s, c)).cast("string")))))


def _ordered(names: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    """name, chars: the characters, rarest first; an empty name has none."""
    rows = names.select(name, F.explode(characters(F.col(name))).alias("c")).join(tokens, "c")
    rows = rows.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("chars"))
    return rows.unionByName(names.where(F.length(name) == 0).select(name, F.array().cast("array<string>").alias("chars")))


def _keys(rows: DataFrame, name: str, least: float) -> DataFrame:
    """name, chars, need (shared characters at least) and the keys of its prefix: those of two characters, and of one where one may do."""
    n = F.size("chars")
    need = F.greatest(F.ceil(F.lit(least) * n / (2 - least) - EPS), F.lit(1)).cast("int")
    rows = rows.withColumn("need", need)
    short = int(math.floor((2 - least) / least + EPS)) if least > 0 else 1 << 30
    widest = int(math.floor(short * (2 - least) / least + EPS)) if least > 0 else 1 << 30
    part = lambda k: F.slice("chars", F.lit(1), F.greatest(n - F.col("need") + k, F.lit(0)))
    rows = rows.withColumns({"two": F.when(F.col("need") >= 2, part(2)).otherwise(F.array().cast("array<string>")), "one": F.when(n <= widest, part(1)).otherwise(F.array().cast("array<string>"))})
    pairs = F.flatten(F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.size("two")), lambda y: F.concat(x, F.lit(" "), y))))
    single = F.when(n == 0, F.array(F.lit(""))).otherwise(F.col("one"))
    return rows.select(name, "two", "one", "need", F.explode(F.concat(pairs, single)).alias("key"))


def candidate_names(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b): the pairs of distinct names whose ratio may reach `least` by all bounds."""
    left, right = (d.select(c).where(F.col(c).isNotNull()).distinct() for d, c in ((left, a), (right, b)))
    both = left.select(F.col(a).alias("s")).unionByName(right.select(F.col(b).alias("s"))).distinct()
    tokens = both.select(F.explode(characters(F.col("s"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    x, y = _keys(_ordered(left, tokens, a), a, least), _keys(_ordered(right, tokens, b), b, least)
    y = y.select(b, F.col("two").alias("two_"), F.col("one").alias("one_"), F.col("need").alias("need_"), "key")
    crowded = y.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    x = x.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    y = y.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64(b), parts).cast("int")).drop("parts")
    met = x.join(y, ["key", "part"]).where(ratio_bound(F.col(a), F.col(b)) >= least - EPS)
    single = F.col("need").eqNullSafe(1) | (F.col("need_") == 1)
    common = F.when(single, F.slice(F.array_intersect("one", "one_"), 1, 1)).otherwise(F.slice(F.array_intersect("two", "two_"), 1, 2))
    met = met.where(F.array_join(common, " ") == F.col("key")).select(a, b)
    length = F.length(a) + F.length(b)
    shared = F.size(F.array_intersect(characters(F.col(a)), characters(F.col(b))))
    met = met.where((length == 0) | (2.0 * shared >= (least - EPS) * length))
    far = F.floor((1 - least) * length + EPS).cast("int")
    return met.where(F.levenshtein(a, b) <= far)


def similar_names(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, score): all pairs of distinct names of a ratio of at least `least`."""
    return candidate_names(left, right, a, b, least).withColumn("score", similarity(F.col(a), F.col(b))).where(F.col("score") >= least)


def containing(names: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): the texts that hold a word of the name of more than three characters, by the word's first four."""
    words = F.filter(F.split(F.lower(a), " "), lambda w: F.length(w) > 3)
    x = names.where(F.col(a).isNotNull()).select(a).distinct().select(a, F.explode(F.array_distinct(words)).alias("word")).withColumn("gram", F.substring("word", 1, 4))
    low = F.lower(b)
    grams = F.when(F.length(b) >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(b) - 3), lambda i: F.substring(low, i, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    y = texts.where(F.col(b).isNotNull()).select(b).distinct().select(b, F.explode(grams).alias("gram"))
    return x.join(y, "gram").where(F.contains(low, F.col("word"))).select(a, b).distinct()
