"""Sinks: Parquet, JSON and CSV; models are saved by pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Append files; columns that either side lacks are null when read with mergeSchema."""
    df.write.mode("append").parquet(path)


def extended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; missing columns are null."""
    return old.unionByName(new, allowMissingColumns=True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
