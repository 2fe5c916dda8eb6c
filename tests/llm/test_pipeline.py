"""The pipeline's stages against their operators, and each stage's decisions on its input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]

import corpus_pipeline as P  # noqa: E402
from helpers import SCHEMA, components, edge_rows  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_are_the_named_ones():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]


def test_each_stage_takes_effect(spark, sf, docs):
    kept = P.language(spark, docs, sf)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.97 * docs.count()
    one = {r["doc_id"] for r in P.near_duplicates(spark, docs, sf).collect()}
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert one == {c for _, c in want.values()}
    clean = P.personal_data(spark, docs, sf)
    assert clean.count() == docs.count() and clean.where(F.length("text") != F.col("n_chars")).count() == 0
    assert clean.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    mixed = P.mixture(spark, docs, sf)
    assert mixed.columns == docs.columns and 0.7 * docs.count() < mixed.count() < 1.3 * docs.count()


def test_near_duplicates_without_or_with_repeated_ids(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (None, a), (2, a + " end"), (3, b), (3, c), (None, c), (4, None), (4, ""), (None, ""), (None, " ".join(f"d{i}" for i in range(40))), (None, " ".join(f"d{i}" for i in range(40)))]
    df = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in P.near_duplicates(spark, df, sf).collect()))
    d = " ".join(f"d{i}" for i in range(40))
    assert got == sorted([(1, a), (3, b), (3, c), (4, ""), (4, ""), (0, ""), (0, d)])


def test_edges_pass_all_stages(spark, sf):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == list(P.COLUMNS)
    assert P.pack(spark, df, sf).count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
