"""Operator 10: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over its share of the corpus.
Each document's uniform number comes from a hash of its id and the seed; the count is the
Poisson quantile at that number for its source's rate. Documents are exploded by their counts,
and copies are shuffled globally: dealt to partitions by a hash of id, copy number and seed, and
sorted by it inside each. So counts and order follow from the rows alone, however they are
partitioned. Expected sizes meet the targets; rates below one leave some documents out.

The target of a source is proportional to size ** TEMPERATURE, or given by `targets`.

Rates are broadcast after a check that there are at most BROADCAST_SOURCES sources; beyond that
they are joined by a shuffle (skewed sources are split by the adaptive join).

Defined cases: a null source is a source of its own; a null doc_id hashes like an empty string;
rows that share a doc_id get the same count; a source without target has rate 0 when targets are
given; an empty table gives an empty result; other columns are kept, but ones called copy,
repeats or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

TEMPERATURE = 0.7
SEED = 17
BROADCAST_SOURCES = 50_000
NO_SOURCE = "\x00null"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: its first 52 bits."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _first_count(rate: Column) -> Column:
    """The least count that a document can have: what lies below is rarer than any number that uniform() gives."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 25), F.lit(0)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k) for k from _first_count() on, until what is left is below any number that uniform() gives.

    The first probability is taken from its logarithm, so that high rates don't underflow.
    """
    first = _first_count(rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    faculty = F.when(first < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(first, F.lit(1))), F.lit(0.0), lambda acc, k: acc + F.log(k.cast("double"))))
    p = F.exp(F.when(first < 1, -rate).otherwise(first * F.log(rate) - rate - faculty))
    return F.aggregate(
        F.sequence(first + 1, last),
        F.struct(p.alias("p"), F.array(p).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * rate / k).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )


def rates(documents: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """_source, rate: mean repetitions of each source's documents, for a mixture as large as the corpus."""
    sizes = documents.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("_source")).agg(F.count("*").cast("double").alias("n"))
    if targets is None:
        want = F.pow(F.col("n"), F.lit(temperature))
    else:
        want = F.coalesce(*(F.when(F.col("_source") == k, F.lit(float(v))) for k, v in targets.items()), F.lit(0.0))
    sizes = sizes.withColumn("want", want)
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("want").alias("all_want"))
    mixed = sizes.crossJoin(F.broadcast(total))
    return mixed.select("_source", (F.col("want") / F.col("all_want") * F.col("all_n") / F.col("n")).alias("rate"))


def with_counts(documents: DataFrame, targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """documents with `repeats`, the number of copies of each row."""
    source, cdf, first, u = (fresh_name(documents, x) for x in ("_source", "_cdf", "_first", "_u"))
    table = rates(documents, targets)
    table = table.select(F.col("_source").alias(source), poisson_cdf(F.col("rate")).alias(cdf), _first_count(F.col("rate")).alias(first))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = documents.withColumn(source, F.coalesce("source", F.lit(NO_SOURCE))).join(table, source, "left")
    rows = rows.withColumn(u, uniform(F.lit(seed), F.col("doc_id")))
    count = F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    return rows.withColumn("repeats", F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))).drop(source, cdf, first, u)


def mix(documents: DataFrame, targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """documents replicated and shuffled, with copy (from 0) and shuffle_key."""
    rows = with_counts(documents, targets, seed).where("repeats > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).drop("repeats")
    key = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"))
    return rows.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def sql(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The same mixture of documents in SQL, without the order."""
    return f"""
WITH n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {temperature}) / (SELECT sum(pow(n, {temperature})) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 26) AS BIGINT))) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.*, CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
t AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars,
             (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS repeats FROM u),
e AS (SELECT *, unnest(range(repeats)) AS copy FROM t)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('order-{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM e
"""
