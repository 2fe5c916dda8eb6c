"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, hosts, jaccard, kmeans, langid, licenses, merkle, mixing, mtree, packing, pii, shards, warc
from .common import fresh_path, materialize, table


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_probe(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the production tokenizer lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # the archives are parsed once
    records = materialize(warc.read(spark, path, with_payload=False), "records")
    return warc.digest(warc.assemble(records))


SQL_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM m
"""


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


SQL_MTREE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.ingest(table(spark, sf_dir, "documents"), fresh_path(spark, "store"))
    rows = store.read()
    return rows.select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


SQL_SHARDS = """
SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.with_inertia(*kmeans.sort_means(table(spark, sf_dir, "embeddings")))


def op13_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard, op2_warc, op3_packing, op4_pii, op5_langid, op6_mtree, op7_merkle, op8_shards, op9_licenses, op10_mixing, op11_fim, op12_kmeans, op13_hosts)
}
SQL: dict[str, str] = {
    "op2_warc": SQL_WARC, "op6_mtree": SQL_MTREE, "op8_shards": SQL_SHARDS, "op10_mixing": mixing.sql(), "op11_fim": fim.SQL, "op12_kmeans": kmeans.sql(), "op13_hosts": hosts.sql(),
}
