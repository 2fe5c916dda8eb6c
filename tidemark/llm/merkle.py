"""Operator 7: document fingerprints from a Merkle tree (native).

A text is cut into paragraphs (after a line end) and those into leaves (after white space that
follows punctuation or one of a few letters); a run of paragraphs up to one whose digest is
small makes a section. So a boundary depends on nearby text alone, and an edit moves no other
one. Nothing is lost in the cuts: a node's digest is the SHA-256 of its children's digests, so
equal roots mean equal texts, and differing branches say where texts differ.

A fingerprint is the text `root|sections|paragraphs|leaves`: the root's digest, and the
first eight hex digits of every other node's, level by level.

Defined cases: a null text counts as empty; the empty text has one empty leaf; repeated
rows give repeated results; where rows share a doc_id, the smallest start stands for "the
next document"; rows without doc_id stand in no order and have an empty next document; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, next_ids
from .spans import bound

PARAGRAPH = r"(?<=\n)"
LEAF = r"(?<=[.!?;:#ywz]\s)"


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _short(digests: Column) -> Column:
    return F.transform(digests, lambda d: F.substring(d, 1, 8))


def add_fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of a text column. Each level is a projection of its own, so none is computed twice; other columns are kept."""
    leaves, paragraphs, sections = (fresh_name(df, x) for x in ("_l", "_p", "_s"))
    leaf_lists = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH, -1),
        lambda p: F.transform(F.split(p, LEAF, -1), lambda x: F.sha2(x, 256)),
    )
    # a section ends with a paragraph whose digest falls in the lowest quarter
    marked = F.transform(paragraphs, lambda d: F.concat(d, F.when(d < "4", F.lit("|")).otherwise(F.lit(""))))
    return (
        df.withColumn(leaves, leaf_lists)
        .withColumn(paragraphs, F.transform(leaves, _digest))
        .withColumn(sections, F.transform(F.split(F.array_join(marked, ""), r"\|"), lambda s: F.sha2(s, 256)))
        .withColumn(
            into,
            F.concat_ws(
                "|",
                _digest(F.col(sections)),
                F.array_join(_short(F.col(sections)), "."),
                F.array_join(_short(F.col(paragraphs)), "."),
                F.array_join(_short(F.flatten(leaves)), "."),
            ),
        )
        .drop(leaves, paragraphs, sections)
    )


def _level(fp: Column, level: int) -> Column:
    return F.split(F.get(F.split(fp, r"\|"), F.lit(level)), r"\.")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the leaves that both list over those that each lists (Dice)."""
    x, y = _level(a, 3), _level(b, 3)
    return F.when(a == b, F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)))
    )


def changed_branches(a: Column, b: Column, level: int = 2) -> Column:
    """Positions in a of the nodes of a level (1 sections, 2 paragraphs, 3 leaves) that b doesn't have; repeated nodes count once, at the first.

    A node that b lacks lies below nodes that b lacks, so these are what a descent into
    differing branches alone would reach. Both sides are sorted together: a node of a is b's
    too if it doesn't begin its digest's run. So a long text takes no pair of nodes.
    """
    theirs = F.transform(F.array_distinct(_level(b, level)), lambda d: F.struct(d.alias("d"), F.lit(-1).alias("i")))
    mine = F.transform(_level(a, level), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    lacking = bound(
        F.array_sort(F.concat(theirs, mine)),
        lambda z: F.transform(z, lambda x, k: F.when((x["i"] >= 0) & ((k == 0) | (F.get(z, k - 1)["d"] != x["d"])), x["i"])),
    )
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast("array<int>")).otherwise(
        F.array_sort(F.array_compact(lacking))
    )


def edit_probe(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the next one's start, their likeness,
    and the sections, paragraphs and leaves of the edited text (numbers from 0, joined by commas) that the text doesn't have.

    The texts are shuffled once, by doc_id. A second exchange takes to each document only as
    much of the next one's start as its edit needs, and that one's fingerprint.
    """
    every = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both uses of these rows filter alike, so that one exchange serves both
    docs = add_fingerprint(every.where("doc_id is not null"))
    lengths = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("most"))
    order = next_ids(documents.select("doc_id"))
    before = order.join(lengths, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("owner"), F.floor(F.col("most") / 2).cast("int").alias("need")
    )
    heads = docs.join(before, "doc_id").select(
        F.col("owner").alias("doc_id"),
        F.substring("text", F.lit(1), F.col("need")).alias("head"),
        F.col("fingerprint").alias("next_fingerprint"),
    )
    # one row an owner: equal but where rows share a doc_id
    heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next_fingerprint")).alias("h")).select("doc_id", "h.*")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    aside = add_fingerprint(every.where("doc_id is null")).withColumns(
        {"head": F.lit(None).cast("string"), "next_fingerprint": F.lit(None).cast("string")}
    )
    both = docs.join(heads, "doc_id", "left").unionByName(aside).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(
            F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half)
        ).alias("edited"),
        "fingerprint",
        F.coalesce("next_fingerprint", F.lit("")).alias("next_fingerprint"),
    )
    both = add_fingerprint(both, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
        *(
            F.array_join(changed_branches(F.col("edited_fingerprint"), F.col("fingerprint"), level), ",").alias(f"changed_{name}")
            for level, name in ((1, "sections"), (2, "paragraphs"), (3, "leaves"))
        ),
    )
