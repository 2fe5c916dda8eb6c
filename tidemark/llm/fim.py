"""Operator 11: fill-in-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered with an in-memory DuckDB of one thread, and one SQL statement
tokenises (regexp_extract_all), draws the cuts (sha256 of seed and id), cuts (list_slice), joins
(array_to_string) and hashes; its result returns as Arrow. No row passes through Python. A batch
goes to DuckDB in slices of about SLICE bytes of text, and DuckDB may take MEMORY and writes no
files, so a task's memory is bounded by the slice or, if larger, the longest text. Nothing is shuffled.

A text's units are runs of A-Z and a-z, and single other characters. The prefix ends after the
smaller of two drawn numbers of units, the middle after the larger. Forms: plain (the text), psm
(<P>prefix<S>suffix<M>middle) and spm (<S>suffix<P>prefix<M>middle). restore() rebuilds the text from
output and form: a text that is cut holds no marker, and no marker can arise where parts meet.

Defined cases: a null text counts as empty; empty texts and texts that hold a marker stay plain;
plain rows have no prefix_chars and middle_chars; a null id is drawn like an empty one; rows that
share id and text give equal results; other columns are kept, but ones named like a result are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh_name, ship

SLICE = 2 << 20
MEMORY = "1GB"
SEED = 1
#: in hundredths: documents that are transformed, and of those the ones in the form spm
RATE = 90
SPM = 20
UNIT = "[A-Za-z]+|[^A-Za-z]"
RESULTS = StructType([
    StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
    StructField("output", StringType()), StructField("output_sha256", StringType()),
])


def batch_sql(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """The statement that DuckDB runs over each slice, registered as `batch` (i, k, t)."""
    draw = lambda part: f"CAST('0x' || substr(h, {8 * part + 1}, 8) AS BIGINT)"
    return f"""
WITH u AS MATERIALIZED (SELECT i, t, regexp_extract_all(t, '{UNIT}') AS units, sha256('{seed}:' || coalesce(k, '')) AS h FROM batch),
d AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {draw(0)} % (len(units) + 1) AS x, {draw(1)} % (len(units) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= {rate} THEN 'plain'
       WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT i, t, n, form,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(x, y)), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(x, y) + 1, n), '') END AS suffix FROM d),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END AS output FROM p)
SELECT i, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars, output, sha256(output) AS output_sha256 FROM o
"""


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows that hold about `size` bytes, one row at least."""
    total = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + size, "right")) - 1)
        yield lo, hi - lo
        lo = hi


def transform(documents: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """documents with n (units), form, prefix_chars, middle_chars, output and output_sha256."""
    ship(documents.sparkSession)
    k, t = fresh_name(documents, "_k"), fresh_name(documents, "_t")
    rows = documents.withColumns({k: F.col(key).cast("string"), t: F.coalesce(text, F.lit(""))})
    kept = [c for c in documents.columns if c not in RESULTS.names]
    sql = batch_sql(seed, rate, spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for batch in batches:
                for lo, n in slices(batch.column(t)):
                    part = batch.slice(lo, n)
                    con.register("batch", pa.table({"i": np.arange(n), "k": part.column(k), "t": part.column(t)}))
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    order = found.column("i").to_numpy()
                    if not np.array_equal(order, np.arange(n)):
                        found = found.take(np.argsort(order))
                    columns = [part.column(c) for c in kept] + [found.column(c).combine_chunks() for c in RESULTS.names]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULTS.names])

    return rows.select(*kept, k, t).mapInArrow(run, StructType([documents.schema[c] for c in kept] + RESULTS.fields))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form stands for."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(b), F.lit(1)), F.lit(a), F.lit(2))
    middle = F.split_part(output, F.lit("<M>"), F.lit(2))
    psm = F.concat(between("<P>", "<S>"), middle, between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), middle, between("<S>", "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of output and restored text."""
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored)


#: The same digest with other functions: units are numbered and cut by position, hashes are read digit by digit.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
  [list_sum(list_transform(range(1, 9), lambda j: (instr('0123456789abcdef', substr(h, CAST(8 * p + j AS INTEGER), 1)) - 1) * CAST(pow(16, 8 - j) AS BIGINT))) for p in range(4)] AS hs FROM d),
n AS (SELECT *, len(u) AS n, CAST(hs[1] AS BIGINT) % (len(u) + 1) AS x, CAST(hs[2] AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST(hs[3] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST(hs[4] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT *, coalesce(list_sum(list_transform(u[1:least(x, y)], lambda z: length(z))), 0) AS a,
  coalesce(list_sum(list_transform(u[1:greatest(x, y)], lambda z: length(z))), 0) AS b FROM n),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, CAST(a AS BIGINT)) || '<S>' || substr(t, CAST(b AS BIGINT) + 1) || '<M>' || substr(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))
  ELSE '<S>' || substr(t, CAST(b AS BIGINT) + 1) || '<P>' || left(t, CAST(a AS BIGINT)) || '<M>' || substr(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) END AS output FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
