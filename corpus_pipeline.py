"""The corpus pipeline: language ID, near duplicates, personal data, mixture, packing.

Each stage takes the documents that its predecessor kept and gives their columns back; the last
gives the pieces of the packed sequences.

1. language: texts whose words can't be told (no letters, or a mean below MIN_SCORE of each word's largest
   probability) go; the others, code-switched ones included, carry the most probable language.
2. near_duplicates: of each group of linked texts the row of the smallest doc_id stays, whole. Of rows that share
   that id, the one of the smallest text stays; of linked rows without any id, one for each set of shingles.
3. personal_data: texts are sanitised; n_chars follows.
4. mixture: sources are brought to their target weights by Poisson replication.
5. packing: BM25 retrieval packing into windows.

No stage's result is kept in memory; run() chains them lazily where an operator allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, mixing, packing, pii
from tidemark.llm.common import materialize
from tidemark.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.4
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.filter_known(docs, model, MIN_SCORE).select(*COLUMNS)


def _small_side(ids: DataFrame) -> DataFrame:
    """A written list of ids, to be broadcast if it has at most BROADCAST_IDS rows (8 MB) and shuffled beyond."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(jaccard.jaccard_components(docs), "components")
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(_small_side(dropped), "doc_id", "left_anti").select(*COLUMNS)
    # an id that several rows share, or none, doesn't tell which row is meant; only such rows are told apart by their sets
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    twice = materialize(twice, "repeated")
    if twice.isEmpty():
        return kept
    repeated = _small_side(twice.where("doc_id is not null"))
    rest = kept.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(*COLUMNS)
    unclear = docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))
    of_set = found.where("set_key is not null").groupBy("set_key").agg(F.first("component_key").alias("component_key"), F.min("component_id").alias("component_id"))
    unclear = jaccard.with_key(unclear).join(of_set, "set_key", "left")
    # of a component the row of the smallest id stays, of equal ids that of the smallest text; without any id, one row a set
    first = unclear.where("set_key is not null and (doc_id = component_id or component_id is null)")
    first = first.groupBy("component_key")
    first = first.agg(F.min(F.struct("text", *(c for c in COLUMNS if c != "text"))).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in COLUMNS))
    # texts without words are linked with nothing
    return rest.unionByName(unclear.where("set_key is null").select(*COLUMNS)).unionByName(first)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs.select(*COLUMNS))
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", pack),
]

#: Conditional random fields and BM25 packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
