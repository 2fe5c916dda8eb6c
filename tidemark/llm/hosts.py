"""Operator 13: host-level quality rules with rates shrunk by an empirical beta prior.

Every document is measured (numpy in Arrow tasks, whole texts) and fails a rule or doesn't. Failures are summed by host, before the
shuffle, so that a host with a third of all rows costs a row a task. For each rule a beta prior is fitted to all hosts' rates by
their moments: mean m and variance between hosts, beyond what counts of their sizes vary by chance; a host's
rate is then (failures + a) / (documents + a + b), so that a host of few documents is judged mostly
by what hosts are like. A host whose rate reaches LIMIT fails the rule, and its verdict is joined back: the host's documents have to pass the rule's strict form.
So a bad host loses its doubtful documents, a good host keeps them, and a document without any such
fault stays wherever it comes from. Documents that fail a base rule (too few words, repetition) go on any host.

Only the verdicts of hosts that fail are joined: by broadcast up to BROADCAST_BYTES of them, beyond that by a shuffle that
deals each host's documents to SALT places.

Defined cases: a null text has no words, and fails for that; a null host is a host of its own; one host has a
prior by its own rate; repeated rows count as often as they stand; columns of the input that aren't named are left out; columns
named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh_name, materialize, ship
from .words import chunks, mix, powers

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: rule: (failed, failed in its strict form); whole numbers only
RULES = {
    "short": ("n_words < 50", "n_words < 100"),
    "repeated": ("100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words > 30 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "20 * n_symbols > n_words"),
    "lines": ("100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines > 15 * n_lines"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 10 * n_words", "2 * word_chars < 7 * n_words OR word_chars > 9 * n_words"),
}
BASE = ("short", "repeated")
#: a host fails a rule if its shrunken rate is at least this
LIMIT = 0.5
#: documents that a prior counts for, at most and at least
STRONGEST, WEAKEST = 1e6, 1.0
BROADCAST_BYTES = 16 << 20
SALT = 32
URL_HOST = "^[a-z][a-z0-9+.-]*://([^/:?#]+)"

_RAW = np.random.default_rng(613).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_ODD = np.array([0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags hold in each row's stretch, at[r] to at[r + 1]."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A hash of (row, hash)."""
    return mix(h + (row.astype(np.uint64) + np.uint64(1)) * _ODD[3])


def count_chunk(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """COUNTS of the texts that lie one after the other in data, a row each."""
    n, rows = len(data), len(off) - 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_RAW[data] * up[:n], out=total[1:])
    hashed = lambda a, b: mix((total[b] - total[a]) * down[a])
    inked = ~_BLANK[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = ~inked[:-1], ~inked[1:]
    some = off[:-1] < off[1:]
    before[off[:-1][some]], after[off[1:][some] - 1] = True, True
    start, end = np.flatnonzero(inked & before), np.flatnonzero(inked & after) + 1
    at = np.searchsorted(start, off)
    out = np.zeros((rows, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.diff(at)
    out[:, 1] = _per_row(inked & ((data & 0xC0) != 0x80), off)
    out[:, 2] = _per_row(_SYMBOL[data], off)

    # lines: starts and ends both rise along the lines, so sorting pairs them
    breaks = np.flatnonzero(data == 10)
    begin, stop = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, off[1:]]))
    row = np.repeat(np.arange(rows), _per_row(data == 10, off) + 1)
    ink = np.concatenate([[0], np.cumsum(inked, dtype=np.int64)])
    held = ink[stop] > ink[begin]
    row, begin, stop = row[held], begin[held], stop[held]
    _, firsts = np.unique(_keyed(hashed(begin, stop), row), return_index=True)
    out[:, 3] = np.bincount(row, minlength=rows)
    out[:, 4] = out[:, 3] - np.bincount(row[firsts], minlength=rows)

    # windows of three words within a row, found twice or more there
    if len(start) >= 3:
        w = hashed(start, end)
        row = np.repeat(np.arange(rows), out[:, 0])
        inside = np.flatnonzero(row[:-2] == row[2:])
        key = _keyed(w[inside] * _ODD[0] + w[inside + 1] * _ODD[1] + w[inside + 2] * _ODD[2], row[inside])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        again = inside[times[which] >= 2]
        covered = np.zeros(len(start), bool)
        for j in range(3):
            covered[again + j] = True
        out[:, 5] = _per_row(covered, at)
    return out


def measure(documents: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns, and COUNTS of each whole text."""
    ship(documents.sparkSession)
    keep = [c for c in keep if c not in COUNTS]
    schema = StructType([documents.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS])
    t = fresh_name(documents, "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [np.zeros((0, len(COUNTS)), dtype=np.int64)]
            counted += [count_chunk(data, off) for _, _, data, off in chunks(b.column(t))]
            table = np.concatenate(counted)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(table[:, i]) for i in range(len(COUNTS))], schema=None, names=[*keep, *COUNTS])

    return documents.select(*keep, F.col(text).alias(t)).mapInArrow(run, schema)


def host_of(x: Column) -> Column:
    """The host of a URL; what isn't one stands for itself."""
    found = F.regexp_extract(F.lower(x), URL_HOST, 1)
    return F.when(found != "", found).otherwise(x)


def _fails(rule: str, strict: bool = False) -> Column:
    return F.expr(RULES[rule][strict])


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """host, documents, and for each rule the host's shrunken rate of failures."""
    by = measured.groupBy(host).agg(F.count("*").alias("documents"), *(F.count_if(_fails(r)).alias(f"f_{r}") for r in RULES))
    by = materialize(by, "hosts")
    f = lambda r: F.col(f"f_{r}").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum("documents").alias("n")]
    sums += [x for r in RULES for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(f(r) * f(r) / F.col("documents")).alias(f"q_{r}"))]
    whole = by.agg(*sums).first()  # one row
    rates = {}
    for r in RULES:
        a, b = prior(whole["hosts"], whole["n"] or 0, whole[f"f_{r}"] or 0, whole[f"q_{r}"] or 0.0)
        rates[r] = (f(r) + a) / (F.col("documents") + (a + b))
    return by.select(host, "documents", *(v.alias(f"rate_{r}") for r, v in rates.items()))


def prior(hosts: int, n: int, failures: int, squares: float) -> tuple[float, float]:
    """(a, b) of the beta prior by moments; squares is the sum over hosts of failures^2 / documents."""
    if not n or not 0 < failures < n:
        return (0.0, WEAKEST) if not failures else (WEAKEST, 0.0)
    m = failures / n
    between = squares / n - m * m - m * (1 - m) * hosts / n
    size = m * (1 - m) / between - 1 if between > 0 else STRONGEST
    size = min(max(size, WEAKEST), STRONGEST)
    return m * size, (1 - m) * size


def judge(documents: DataFrame, host: Column, *keep: str, text: str = "text") -> DataFrame:
    """The named columns with COUNTS, base_failed, host_failed (the rules that the row's host fails, joined by commas), host_rate (its largest rate) and kept."""
    h, salt = (fresh_name(documents, x) for x in ("_host", "_salt"))
    measured = materialize(measure(documents.withColumn(h, host), *keep, h, text=text), "measured")
    rates = host_rates(measured, h)
    failed = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"rate_{r}") >= LIMIT, F.lit(r)) for r in RULES))), ",")
    verdicts = rates.select(h, failed.alias("host_failed"), F.greatest(*(F.col(f"rate_{r}") for r in RULES)).alias("host_rate"))
    bad = materialize(verdicts.where("host_failed <> ''"), "verdicts")
    size = bad.agg(F.sum(F.coalesce(F.octet_length(h), F.lit(0)) + 64)).first()[0] or 0
    key = F.coalesce(F.concat(F.lit("="), h), F.lit("null"))
    bad, rows = bad.withColumn(h, key), measured.drop("host_failed", "host_rate").withColumn(h, key)
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(bad), h, "left").drop(h)
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(*COUNTS, *keep), F.lit(SALT)))
        rows = rows.join(bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"))), [h, salt], "left").drop(h, salt)
    base = F.lit(False)
    for r in BASE:
        base = base | _fails(r)
    of_host = F.split(F.coalesce("host_failed", F.lit("")), ",")
    doubtful = F.lit(False)
    for r in RULES:
        doubtful = doubtful | (F.array_contains(of_host, r) & _fails(r, strict=True))
    return rows.withColumns({"host_failed": F.coalesce("host_failed", F.lit("")), "base_failed": base, "kept": ~base & ~doubtful})


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, counts and verdicts by each document's source."""
    judged = judge(documents, host_of(F.col("source")), "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


def sql() -> str:
    """The same digest in SQL."""
    counts = ", ".join(f"count(*) FILTER (WHERE {r[0]}) AS f_{k}" for k, r in RULES.items())
    sums = ", ".join(f"sum(f_{k}) AS s_{k}, sum(CAST(f_{k} AS DOUBLE) * f_{k} / documents) AS q_{k}" for k in RULES)
    between = lambda k: f"(q_{k} / n - s_{k} / n * (s_{k} / n) - s_{k} / n * (1 - s_{k} / n) * hosts / n)"
    size = lambda k: f"CASE WHEN {between(k)} > 0 THEN least(greatest(s_{k} / n * (1 - s_{k} / n) / {between(k)} - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END"
    rate = lambda k: f"(f_{k} + CASE WHEN s_{k} = 0 THEN 0 WHEN s_{k} = n THEN {WEAKEST} ELSE s_{k} / n * z_{k} END) / (documents + CASE WHEN s_{k} IN (0, n) THEN {WEAKEST} ELSE z_{k} END)"
    flags = " || ".join(f"CASE WHEN {rate(k)} >= {LIMIT} THEN ',{k}' ELSE '' END" for k in RULES)
    strict = " OR ".join(f"(contains(',' || host_failed || ',', ',{k},') AND ({r[1]}))" for k, r in RULES.items())
    base = " OR ".join(f"({RULES[k][0]})" for k in BASE)
    blank = "\\x20\\x09-\\x0D"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN regexp_matches(lower(source), '{URL_HOST}') THEN regexp_extract(lower(source), '{URL_HOST}', 1) ELSE source END AS host FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^{blank}]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^{blank}]+'), 1) AS i FROM d),
w3 AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS again FROM w3),
c AS (SELECT r, length(w) AS len, again OR coalesce(lag(again, 1) OVER o, FALSE) OR coalesce(lag(again, 2) OVER o, FALSE) AS covered FROM g WINDOW o AS (PARTITION BY r ORDER BY i)),
cw AS (SELECT r, count(*) AS n_words, CAST(sum(len) AS BIGINT) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY 1),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
cl AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^{blank}]') GROUP BY 1),
m AS (SELECT d.r, doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN cw USING (r) LEFT JOIN cl USING (r)),
h AS (SELECT host, count(*) AS documents, {counts} FROM m GROUP BY 1),
s AS (SELECT count(*) AS hosts, sum(documents) AS n, {sums} FROM h),
z AS (SELECT *, {", ".join(f"{size(k)} AS z_{k}" for k in RULES)} FROM s),
v AS (SELECT host, substr({flags}, 2) AS host_failed FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ({base}) AS base_failed, host_failed, NOT ({base}) AND NOT ({strict}) AS kept
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
"""
