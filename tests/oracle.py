"""A Spark result held against DuckDB's."""

from decimal import Decimal

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{float(v):.12g}" if isinstance(v, float | Decimal) else str(v)


def rows(table: pa.Table | pd.DataFrame) -> list[tuple]:
    """Rows with their columns in order of name, sorted. Arrow tables keep whole numbers beside nulls."""
    names = sorted(table.columns) if isinstance(table, pd.DataFrame) else sorted(table.column_names)
    columns = [list(table[c]) if isinstance(table, pd.DataFrame) else table[c].to_pylist() for c in names]
    return sorted(zip(*([shown(v) for v in c] for c in columns), strict=True))


def want(sql: str, sf: str) -> pa.Table:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).to_arrow_table()


def check(got: pa.Table | pd.DataFrame, sql: str, sf: str) -> None:
    expected = want(sql, sf)
    if isinstance(got, pd.DataFrame):
        expected = expected.to_pandas()
    names = lambda t: sorted(t.columns if isinstance(t, pd.DataFrame) else t.column_names)
    assert names(got) == names(expected)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)
