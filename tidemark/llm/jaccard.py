"""Operator 1: n-gram Jaccard join by parity sketches.

A text's set holds the 64-bit hashes of its distinct shingles of five words. Texts with equal
sets form one class; classes are joined, copies are not.

Sketch. Each shingle flips a place in a long bit sketch, cut into k blocks, so a block is the
parity (XOR) of the shingles in it, and the number of blocks in which two sketches differ is at
most their sets' symmetric difference. For two sets that link, of sizes a <= b <= 4a/3, that
is at most (a + b) / 7. k depends on the size band (powers of four); a set whose partners may
reach into the next band is a guest there too. A pair meets in the band of its larger set.

Pigeonhole. A set offers all its non-zero blocks. At most (a + b) / 7 of them can differ from a
partner's, so partners meet in buckets of equal blocks. Sets below _FIRST_BAND shingles have a
block for each shingle; of these at most (4a - 3b) / 7 can differ.

Prefixes. Blocks stand in one order for all sets: by popularity, rarest first, then by hash. The
popularity comes from counters of hashed blocks (COUNTERS of them, whatever the corpus), so it is
an estimate; any common order gives right results. If at most d of a set's blocks can differ from
a partner's, the first block common to both is among its first d + 1, so a set offers no more
than those, and a pair is a candidate only where both ranks allow for that first common block,
given both sizes. Passages that many texts share and the noise of single copies keep apart.

Buckets. 1. Every member of a bucket is held against the bucket's first member, which joins
families of near copies in linear time; components follow from large-star/small-star contraction.
2. In buckets of at most SMALL sets, the other pairs are candidates if their components differ. In
larger ones, members of several components are held against the LEADERS most central ones; once
more with other leaders. 3. What is left meets under the most central member of each bucket: sets
with the same one are held against each other, a pair only under the first such member that both
have in common, so that it is made once however many blocks it shares.

Candidates are pruned by the Hamming distance of compact bit sketches and verified by the exact
intersection of their sets. No links are dropped and no bucket is cut.

Defined cases: null or wordless text: n_shingles 0, its own component; repeated rows: equal
results; rows without doc_id: the component of their class if another row of it has an id, else
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, ship, shuffle_partitions
from .words import mix, shingle_sets

SMALL = 6
LEADERS = 4
FLUSH = 500_000
_FIRST_BAND = 512
FILTER_BITS = 25
COUNTERS = 1 << 21
_PIECE = 1 << 16  # counters a row


def _band(n: int) -> int:
    """0 below _FIRST_BAND shingles, then one for each factor of four."""
    return 0 if n < _FIRST_BAND else ((n // _FIRST_BAND).bit_length() + 1) // 2


def _native(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether sets of a band belong to it; the others are guests from the one below."""
    return (band == 0) | (4 * n >= _FIRST_BAND << 2 * band)


def _key(u: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(np.array([mix(mix(u ^ np.uint64(0x5DEECE66D)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(u)))[0]]).view(np.int64)[0])


def _compact(u: np.ndarray) -> np.ndarray:
    """Bit sketch of two to four places a shingle, as 64-bit words."""
    bits = max(6, int(2 * len(u) - 1).bit_length())
    place = u & np.uint64((1 << bits) - 1)  # low bits, so that a sketch folds in halves
    odd, times = np.unique(place, return_counts=True)
    odd = odd[times % 2 == 1]
    words = np.zeros((1 << bits) // 64, dtype=np.uint64)
    np.bitwise_xor.at(words, (odd >> np.uint64(6)).astype(np.int64), np.uint64(1) << (odd & np.uint64(63)))
    return words.view(np.int64)


def offered(u: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(band, signatures of the blocks that a set offers) for its bands."""
    n = len(u)
    for band in {_band(n), _band(4 * n // 3)}:
        if band == 0:  # a block a shingle
            block, word = u, u
        else:
            bits = 10 + 2 * band
            block = u >> np.uint64(64 - bits)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            word = np.bitwise_xor.reduceat(mix(u), first)
            block = block[first]
            block, word = block[word != 0], word[word != 0]
        yield band, mix(block * np.uint64(0xD1342543DE82EF95) ^ word ^ np.uint64(band << 56))


def _differ(n: np.ndarray, m: np.ndarray, band: np.ndarray) -> np.ndarray:
    """How many of the blocks of sets of n shingles can differ from those of a linked set of m."""
    return np.where(band == 0, (4 * n - 3 * m) // 7, (n + m) // 7)


def _prefix(n: int, band: int) -> int:
    """How many blocks a set of n shingles offers: one more than can differ from any partner's."""
    most = n // 4 if band == 0 else (n + 4 * n // 3) // 7
    return most + 1


def _counter(sig: np.ndarray) -> np.ndarray:
    return (sig % np.uint64(COUNTERS)).astype(np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a text; after them the task's block counters (up to 255 each) in pieces."""
    counts, kind = None, None

    def batch_of(ids: pa.Array, n: list, key: list, sketch: list, piece: list, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(piece, pa.int32()), pa.array(held, pa.binary())],
            names=["doc_id", "n", "key", "sketch", "piece", "counts"],
        )

    for batch in batches:
        ids, rows, kind = batch.column(0), [], batch.schema.field(0).type
        if counts is None:
            counts = np.zeros(COUNTERS, np.uint32)
        sigs, waiting = [], 0
        for row, u in shingle_sets(batch.column(1)):
            rows.append((row, len(u), _key(u) if len(u) else None, _compact(u) if len(u) else None))
            for _, sig in offered(u) if len(u) else ():
                sigs.append(_counter(sig))
                waiting += len(sig)
            if waiting > FLUSH:
                counts += np.bincount(np.concatenate(sigs), minlength=COUNTERS).astype(np.uint32)
                sigs, waiting = [], 0
        if sigs:
            counts += np.bincount(np.concatenate(sigs), minlength=COUNTERS).astype(np.uint32)
        if rows:
            at, n, key, sketch = zip(*rows, strict=True)
            yield batch_of(ids.take(pa.array(at)), n, key, sketch, [None] * len(rows), [None] * len(rows))
    if counts is not None:
        few = np.minimum(counts, 255).astype(np.uint8)
        for piece in range(COUNTERS // _PIECE):
            yield batch_of(pa.nulls(1, kind), [None], [None], [None], [piece], [few[piece * _PIECE : (piece + 1) * _PIECE].tobytes()])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of counters, as levels: eight to an octave."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            now = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
            held[piece] = held[piece] + now if piece in held else now
    for piece, total in held.items():
        level = np.minimum(np.round(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["piece", "levels"])


def _levels(digest: DataFrame) -> bytes:
    """The popularity level of every counter: COUNTERS bytes, whatever the corpus."""
    pieces = digest.where("piece is not null").select("piece", "counts").repartition("piece")
    found = {r["piece"]: bytes(r["levels"]) for r in pieces.mapInArrow(_added, "piece int, levels binary").collect()}
    return b"".join(found.get(i, bytes(_PIECE)) for i in range(COUNTERS // _PIECE))


def _chosen(bitmap) -> object:
    """Sets of the rows whose doc_id is in a bitmap of hashed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            rows, held = [], 0
            for _, u in shingle_sets(batch.column(1).take(pa.array(chosen))):
                key = _key(u) if len(u) else None
                if len(u) and key not in seen:  # repeated rows give one set a task
                    seen.add(key)
                    rows.append((key, u.view(np.int64)))
                    held += len(u)
                if held > FLUSH:
                    yield _set_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, members = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["key", "members"])


def _sets_of(docs: DataFrame, ids: DataFrame, scratch: Scratch, repeated: bool = True) -> DataFrame:
    """(key, members, n) of the texts of some ids, and of a few others; each set once, if it is said that ids may be repeated.

    The ids' hashes go into a bitmap of 2^FILTER_BITS places (4 MB, whatever the corpus), which is
    broadcast, so that other texts are neither shuffled nor hashed. A full bitmap only lets more through.
    """
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(1 << FILTER_BITS))
    at = ids.select(place(F.col("doc_id")).alias("p")).select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    words = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    held = spark.sparkContext.broadcast(bitmap.tobytes())
    rows = docs.where("doc_id is not null").select(place(F.col("doc_id")).alias("p"), "text")
    found = rows.mapInArrow(_chosen(held), "key long, members array<bigint>")
    sets = scratch(found.withColumns({"n": F.size("members"), "at": F.monotonically_increasing_id()}), "sets")
    held.unpersist()
    if not repeated:
        return sets.drop("at")
    # rows that several tasks hold: of equal sets the first stays
    first = sets.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "first")
    first = scratch(first, "keys")
    if not first.isEmpty():
        sets = sets.join(first, "key", "left").where("first is null or at = first").drop("first")
    return sets.drop("at")


def _part_labels(spark, parts: int) -> list[int]:
    """For each partition, a number whose hash Spark deals to it."""
    dealt = spark.range(parts * 16).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    found = {r["p"]: r["i"] for r in dealt.groupBy("p").agg(F.min("i").alias("i")).collect()}
    return [found.get(p, p) for p in range(parts)]


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the smallest unsigned type that holds all of them."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _wide(blob: bytes, count: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // count}").astype(np.int64)


_PACKED = "part int, sigs binary, keys binary, sizes binary, ranks binary, bands binary"


def _packed(labels: list[int], levels):
    """The blocks that sets offer, one row per target part, with signatures of 48 bits."""
    parts = len(labels)

    def flush(found: list[tuple]) -> pa.RecordBatch:
        sig = np.concatenate([x[0] for x in found])
        count = np.array([len(x[0]) for x in found])
        key, n, band = (np.repeat(np.array(x, dtype=np.int64), count) for x in zip(*(x[1:] for x in found), strict=True))
        rank = np.arange(len(sig)) - np.repeat(np.cumsum(count) - count, count)
        part = ((sig >> np.uint64(16)) % np.uint64(parts)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        sig, key, n, band, rank, part = (x[order] for x in (sig, key, n, band, rank, part))
        edge = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p in range(parts):
            cut = slice(edge[p], edge[p + 1])
            if edge[p] < edge[p + 1]:
                six = sig[cut].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
                rows.append((labels[p], six.tobytes(), key[cut].tobytes(), *(_narrow(x[cut]) for x in (n, rank, band))))
        p, *blobs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "sigs", "keys", "sizes", "ranks", "bands"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        found, held, seen = [], 0, set()
        for batch in batches:
            for _, u in shingle_sets(batch.column(0)):
                if len(u) and (key := _key(u)) not in seen:
                    seen.add(key)
                    for band, sig in offered(u):
                        sig = sig[np.lexsort((sig, level[_counter(sig)]))][: _prefix(len(u), band)]
                        found.append((sig, key, len(u), band))
                        held += len(sig)
                if held > FLUSH:
                    yield flush(found)
                    found, held, seen = [], 0, set()
        if found:
            yield flush(found)
        give_back()

    return run


_MEET = "kind int, a long, b long, sig long, n long, rank long, band int"


def _unique_pairs(a: np.ndarray, b: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs whose sizes and ranks allow a link."""
    a, b = a[fit], b[fit]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def _bucket(sig: np.ndarray, key: np.ndarray, n: np.ndarray, rank: np.ndarray, band: np.ndarray) -> Iterator[tuple]:
    """(kind, a, b, sig, n, rank, band) arrays of one part: 0 leader and member, 1 pair of a small bucket, 2 member of a large one."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
    order, sig, key = order[keep], sig[keep], key[keep]
    n, rank, band = n[order], rank[order], band[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    native = _native(n, band)
    of_use = (size > 1) & np.logical_or.reduceat(native, first)
    first, size = first[of_use], size[of_use]

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sizes = 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
        ranks = (rank[x] <= _differ(n[x], n[y], band[x])) & (rank[y] <= _differ(n[y], n[x], band[x]))
        return sizes & ranks & (native[x] | native[y])

    def pairs(kind: int, x: np.ndarray, y: np.ndarray) -> tuple:
        a, b = _unique_pairs(key[x], key[y], fit(x, y))
        z = np.zeros(len(a), np.int64)
        return kind, a, b, z, z, z, z

    if len(first):
        lead = np.repeat(first, size - 1)
        member = lead + np.arange(len(lead)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1
        yield pairs(0, lead, member)
    for s in range(3, SMALL + 1):
        at = first[size == s]
        if len(at):
            i, j = np.triu_indices(s - 1, 1)
            yield pairs(1, (at[:, None] + 1 + i).ravel(), (at[:, None] + 1 + j).ravel())
    big = size > SMALL
    if big.any():
        reps = size[big]
        at = np.repeat(first[big], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        yield 2, key[at], np.zeros(len(at), np.int64), sig[at].view(np.int64), n[at], rank[at], band[at]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            six = np.frombuffer(row["sigs"], np.uint8).reshape(-1, 6)
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six
            counts = (_wide(row[x], len(six)) for x in ("sizes", "ranks", "bands"))
            parts.setdefault(row["part"], []).append((wide.view("<u8").ravel(), np.frombuffer(row["keys"], np.int64), *counts))
    for p in sorted(parts):
        found = parts.pop(p)
        for kind, *columns in _bucket(*(np.concatenate(x) for x in zip(*found, strict=True))):
            for lo in range(0, len(columns[0]), 100_000):
                a, b, sig, n, rank, band = (x[lo : lo + 100_000] for x in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x) for x in (a, b, sig, n, rank)), pa.array(band.astype(np.int32))],
                    names=["kind", "a", "b", "sig", "n", "rank", "band"],
                )
    give_back()


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, scratch: Scratch, repeated: bool) -> DataFrame:
    """The pairs (a, b) whose sets link; pairs is a written table."""
    keys = scratch(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "keys")
    sets = _sets_of(docs, sketches.join(keys, "key").select(F.col("rep").alias("doc_id")), scratch, repeated)
    # sets that stand on one side only need not be moved for the other
    on = lambda side: sets.join(scratch(pairs.select(F.col(side).alias("key")).distinct(), "keys"), "key", "left_semi")
    left = on("a").select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = on("b").select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("ma", "mb"))
    links = scratch(both.where(100 * common >= 75 * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct(), "links")
    scratch.drop("keys", "sets")
    return links


def _folded(sketch: Column) -> Column:
    """A sketch of half as many places: the parity of both halves together."""
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and the Hamming distance of compact sketches don't rule out."""
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    # sizes within 4/3 of each other make sketches of one length, or of one and its double
    x = F.when(F.size("sa") > F.size("sb"), _folded(F.col("sa"))).otherwise(F.col("sa"))
    y = F.when(F.size("sb") > F.size("sa"), _folded(F.col("sb"))).otherwise(F.col("sb"))
    apart = F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda acc, v: acc + v)
    return both.where(7 * apart <= F.col("na") + F.col("nb")).select(*pairs.columns)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of every end of a link: root is the smallest key reachable.

    Each partition first joins its own links to stars; star contraction joins those.
    """
    links = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u")
    stars = links.mapInArrow(_joined, "v long, u long").where("v <> u")
    return scratch(_contraction(stars, scratch), "roots")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one partition's links, by hooking to smaller labels and pointer jumping."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not pairs:
        return
    v, u = (np.concatenate(side) for side in zip(*pairs, strict=True))
    if not len(v):
        return
    key, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    v, u = at[: len(v)], at[len(v) :]
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[v], root[u])
        new = root.copy()
        for end in (v, u):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for lo in range(0, len(key), 500_000):
        part = slice(lo, lo + 500_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(key[root[part]])], names=["v", "u"])


def _contraction(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Alternates large-star and small-star on ever smaller stars until nothing changes."""
    edges, mark = scratch(links.distinct(), "cc"), None
    while True:
        # large-star: each vertex's larger neighbours go to its smallest neighbour or itself
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small-star: each vertex and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        edges = scratch(small.union(low.select("v", F.col("m").alias("u"))).distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("v").agg(F.min("u").alias("root")).union(edges.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct()).groupBy("v").agg(F.min("root").alias("root"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    a = roots.select(F.col("v").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


_SIZES = "4 * least(n, nw) >= 3 * greatest(n, nw)"
_LIMIT = "case when {band} = 0 then floor((4 * {n} - 3 * {m}) / 7) else floor(({n} + {m}) / 7) end"


def _mixed(probes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of large buckets, with their roots, where a bucket holds several components."""
    ends = probes.join(roots, "v", "left").select(*probes.columns, F.coalesce("root", "v").alias("root"))
    mixed = ends.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    return ends.join(mixed, "sig", "left_semi")


def _to_leaders(ends: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and its most central members; other ones each turn."""
    few = [F.min(F.struct("slack", F.xxhash64("v", F.lit(turn * LEADERS + i)), "v", "n", "rank", "root")).alias(f"p{i}") for i in range(LEADERS)]
    lead = ends.groupBy("sig").agg(*few).select("sig", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(LEADERS))))).alias("p"))
    lead = lead.select("sig", F.col("p.v").alias("w"), F.col("p.n").alias("nw"), F.col("p.rank").alias("rank_w"), F.col("p.root").alias("root_w"))
    fit = f"root <> root_w and {_SIZES} and rank <= {_LIMIT.format(band='band', n='n', m='nw')} and rank_w <= {_LIMIT.format(band='band', n='nw', m='n')}"
    return ends.join(lead, "sig").where(fit).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def _met_once(ends: DataFrame) -> DataFrame:
    """Every pair (a, b) of members of a bucket in different components that sizes and ranks allow, made once.

    A bucket goes by its most central member (a spot: that member and the band). A set keeps its
    lowest rank at each of its spots; a pair is made at the smallest spot where both ranks allow it.
    """
    lead = ends.groupBy("sig", "band").agg(F.min(F.struct("slack", F.xxhash64("v"), "v"))["v"].alias("w"))
    at = ends.join(lead, ["sig", "band"]).select("v", "n", "root", "rank", "band", F.xxhash64("w", "band").alias("spot"))
    at = at.groupBy("v", "spot").agg(F.min("rank").alias("rank"), F.first("n").alias("n"), F.first("root").alias("root"), F.first("band").alias("band"))
    held = at.groupBy("v").agg(F.collect_list(F.struct("spot", "rank", "band")).alias("held"))
    left = at.join(held, "v").select("spot", "v", "n", "root", "held")
    right = left.select("spot", *(F.col(c).alias(f"{c}w" if c == "n" else f"{c}_w") for c in ("v", "n", "root", "held")))
    able = lambda held, n, m: f"transform(filter({held}, h -> h.rank <= {_LIMIT.format(band='h.band', n=n, m=m)}), h -> h.spot)"
    once = f"spot = array_min(array_intersect({able('held', 'n', 'nw')}, {able('held_w', 'nw', 'n')}))"
    pairs = left.join(right, "spot").where(f"v < v_w and root <> root_w and {_SIZES} and {once}")
    return pairs.select(F.col("v").alias("a"), F.col("v_w").alias("b"))


def with_key(documents: DataFrame) -> DataFrame:
    """documents with set_key, the 64-bit identity of the text's set (null without words)."""
    ship(documents.sparkSession)
    at = documents.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(u) if len(u) else None for _, u in shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "set_key"])

    return documents.mapInArrow(task, T.StructType([*documents.schema.fields, T.StructField("set_key", T.LongType())]))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_key (equal for equal sets) and component_key (equal within a component) of every row of documents(doc_id, text)."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    labels = _part_labels(spark, shuffle_partitions(spark))
    docs = documents.select("doc_id", "text")
    made = scratch(docs.mapInArrow(_digests, f"{_id(docs)}, n long, key long, sketch array<bigint>, piece int, counts binary"), "digest")
    digest = made.where("piece is null").select("doc_id", "n", "key", "sketch")
    repeated = not digest.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").isEmpty()
    levels = spark.sparkContext.broadcast(_levels(made))
    packed = docs.select("text").mapInArrow(_packed(labels, levels), _PACKED)
    meet = scratch(packed.repartition(len(labels), "part").mapInArrow(_meetings, _MEET), "meet")
    levels.unpersist()

    classes = digest.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    wanted = meet.select("a").union(meet.where("kind < 2").select("b")).distinct().withColumnRenamed("a", "key")
    wanted = classes.join(wanted, "key").select(F.col("key").alias("k"), F.col("rep").alias("doc_id"))
    sketches = digest.join(wanted, "doc_id").where("key = k")
    sketches = scratch(sketches.dropDuplicates(["key"]).select("key", "n", "sketch", F.col("doc_id").alias("rep")), "sketch")

    pairs = meet.where("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind"))
    close = scratch(_near(pairs, sketches), "near")
    roots = components(_verified(close.where("kind = 0").select("a", "b"), docs, sketches, scratch, repeated), scratch)

    def joined(candidates: DataFrame) -> DataFrame:
        """The components after the links among some written candidates."""
        if candidates.isEmpty():
            return roots
        found = _verified(candidates, docs, sketches, scratch, repeated)
        return roots if found.isEmpty() else components(_contracted(roots, found), scratch)

    # the fewer blocks of its own stand before the first shared one, the more central a set is in its family
    large = meet.where("kind = 2").select("sig", F.col("a").alias("v"), "n", "rank", "band")
    first = large.groupBy("v").agg((F.min("rank") / F.max("n")).alias("slack"))
    probes = scratch(_mixed(large.join(first, "v"), roots).drop("root"), "probes")
    small = _across(close.where("kind = 1"), roots)
    for turn in range(2):
        leaders = _near(_to_leaders(_mixed(probes, roots), turn), sketches)
        roots = joined(scratch(small.union(leaders).distinct() if turn == 0 else leaders, "apart"))
    ends = scratch(_mixed(probes, roots), "ends")
    if not ends.isEmpty():
        roots = joined(scratch(_near(_met_once(ends), sketches), "apart"))
    scratch.drop("meet", "near", "apart", "probes", "ends", "links", "cc", "sketch")

    named = classes.join(roots, F.col("key") == F.col("v"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id", F.col("root").alias("component_key"))
    return digest.drop("sketch").join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("set_key"), "component_key"
    )


def _contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Links that give the components of all so far: each end with its root, and the new links."""
    return roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(found)


def _id(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
