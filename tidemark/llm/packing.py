"""Operator 3: lexical retrieval packing.

Documents become token ids (closed by END) and fill windows of WINDOW tokens. The corpus is
indexed in shards: each task reads its split of the table and indexes up to SHARD_DOCS documents
or SHARD_TOKENS tokens at a time in a BM25 inverted index over token ids, so an index is bounded
whatever the corpus, and texts are never shuffled. A window opens with a seed (what is left of
the last document cut, or the first unused one); BM25 with all of the seed's terms
ranks the shard's unused documents, which follow greedily until the window is full. The last one
is cut where the window ends, and its rest seeds the next.

A window that a shard leaves open goes on in the task's next shard. What is open at the end of a
task is cut into sequences whose lengths are powers of two. So no sequence is padded, and every
id lies in exactly one piece.

Defined cases: a null or empty text is the single id END; rows that share a doc_id are packed
each (a window takes another copy of its seed last); ties in score go by order of reading; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back, ship
from .tokens import Encoder

WINDOW = 4096
END = 2
SHARD_DOCS = 1024
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75


class Index:
    """BM25 inverted index over one shard: a list of token id arrays."""

    def __init__(self, docs: list[np.ndarray]):
        size = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), size)
        pair, times = np.unique((np.concatenate(docs).astype(np.int64) << 20) | owner, return_counts=True)
        self.term, self.doc = pair >> 20, pair & ((1 << 20) - 1)
        self.terms, self.begin, df = np.unique(self.term, return_index=True, return_counts=True)
        self.end = self.begin + df
        self.idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / size.mean())
        self.weight = np.repeat(self.idf, df) * times * (K1 + 1) / (times + norm[self.doc])
        self.n = len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every document for a seed's distinct terms."""
        at = np.searchsorted(self.terms, query)
        at = at[at < len(self.terms)]
        at = at[np.isin(self.terms[at], query)]
        if not len(at):
            return np.zeros(self.n)
        size = self.end[at] - self.begin[at]
        run = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[run], self.weight[run], self.n)


class Packer:
    """Fills windows; keeps what is open between shards."""

    def __init__(self, first_sequence: int):
        self.next = first_sequence
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.used = 0
        self.query = np.zeros(0, np.int64)
        self.seed_id = None
        self.out: list[tuple] = []

    def _close(self) -> None:
        at = 0
        for doc_id, start, ids, total in self.open:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1
        self.open, self.used = [], 0

    def _add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(WINDOW - self.used, len(ids) - at)
            if not self.open:
                self.query, self.seed_id = np.unique(ids[at:]).astype(np.int64), doc_id
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.used += take
            at += take
            if self.used == WINDOW:
                self._close()

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index = Index(docs)
        unused = np.ones(len(docs), bool)
        same: dict = {}
        for i, d in enumerate(doc_ids):
            same.setdefault(d, []).append(i)
        first = 0
        while first < len(docs):
            if not unused[first]:
                first += 1
                continue
            if not self.open:
                unused[first] = False
                self._add(doc_ids[first], docs[first])
                continue
            score = index.scores(self.query)
            score[same.get(self.seed_id, [])] = -1.0
            left = np.flatnonzero(unused)
            sequence = self.next
            for i in left[np.argsort(-score[left], kind="stable")]:
                unused[i] = False
                self._add(doc_ids[i], docs[i])
                if self.next != sequence:
                    break

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        left, sizes = self.open, [1 << b for b in range(12, -1, -1) if self.used >> b & 1]
        self.open, self.used = [], 0
        for size in sizes:
            room = size
            while room:
                doc_id, start, ids, total = left[0]
                self.open.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left = [(doc_id, start + room, ids[room:], total), *left[1:]]
                    room = 0
                else:
                    room -= len(ids)
                    left = left[1:]
            self._close()

    def take(self) -> Iterator[tuple]:
        out, self.out = self.out, []
        return out


_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = Encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33)
        ids_type = None
        doc_ids, docs, held = [], [], 0

        def rows() -> pa.RecordBatch:
            doc_id, *rest = zip(*packer.take(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc_id, ids_type), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", *_FIELDS])

        for batch in batches:
            ids_type = batch.schema.field(0).type
            own = batch.column(0).to_pylist()
            for row, ids in encoder.encode(batch.column(1)):
                doc_ids.append(own[row])
                docs.append(np.append(ids, np.uint32(END)).astype(np.uint16 if encoder.small else np.uint32))
                held += len(ids) + 1
                if len(docs) == SHARD_DOCS or held >= SHARD_TOKENS:
                    packer.shard(doc_ids, docs)
                    doc_ids, docs, held = [], [], 0
                    if packer.out:
                        yield rows()
        if docs:
            packer.shard(doc_ids, docs)
        packer.finish()
        if packer.out:
            yield rows()
        del encoder, packer, doc_ids, docs
        give_back()

    return documents.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in _FIELDS))
