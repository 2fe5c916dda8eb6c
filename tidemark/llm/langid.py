"""Operator 5: language identification by a linear-chain conditional random field.

Words are runs of ASCII letters and non-ASCII characters, lower-cased in ASCII. A word's scores
are sums of learned weights of its features, hashed into a table: the word itself (a learned
lexicon), and all n-grams of two to four bytes of ^word$, so those at the ends are its affixes.
Learned transitions join the words of a text; forward-backward gives each word's probability of
each language. A text's language has the highest mean probability over its words; that mean is
the score.

Training maximises the likelihood of labelled sequences (AdaGrad). They are spliced from
segments of labelled texts, a third of them from several languages, so that transitions are
learned from code-switched sequences. The sample is bounded: of every language the TRAIN_DOCS
texts (MAX_DOCS over the number of languages, if that is less) of the lowest hashes of doc_id and
text, of a longer text the TRAIN_CHARS characters from a place by hash, and TRAIN_SEQUENCES
sequences. More than MAX_DOCS languages are an error.

Prediction is one pass over the texts in Arrow tasks, many texts side by side, with no shuffle.

Defined cases: null text or no letter: `und`, score 0; no labelled row to learn from: every text
is `und`; rows without doc_id are predicted, count as not held out and aren't learned from;
repeated rows: equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship
from .words import chunks, forget_powers, word_spans

TRAIN_DOCS = 400
MAX_DOCS = 4000
TRAIN_CHARS = 1 << 14
TRAIN_SEQUENCES = 6000
EPOCHS = 6
TABLE = 1 << 17
CHUNK = 1 << 20  # many texts side by side
WORDS = 1 << 15  # words whose features are held at once
_HASHES = 1 << 53
UNDETERMINED = "und"
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # TABLE x languages
    transitions: np.ndarray  # from x to
    initial: np.ndarray


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table places of all features of all words, place of each word's first feature)."""
    size = end - start
    width = size + 2  # with ^ and $
    first = np.cumsum(width) - width
    text = np.empty(int(width.sum()), dtype=np.uint32)
    text[first], text[first + width - 1] = 1, 2
    inner = np.ones(len(text), bool)
    inner[first] = inner[first + width - 1] = False
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    text[inner] = _LOWER[data[at]]
    left = np.repeat(first + width, width) - np.arange(len(text))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(start)), width)
    places, owners = [], []
    h = text.copy()
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + text[n - 1 :] if len(h) > 1 else h[:0]
        ok = left[: len(h)] >= n
        g = h[ok] * np.uint32(0x9E3779B1) + np.uint32(n)
        places.append((g ^ (g >> np.uint32(15))) % np.uint32(TABLE))
        owners.append(owner[: len(h)][ok])
    mult = (np.uint32(0x85EBCA6B) * (np.arange(len(text), dtype=np.uint32) - np.repeat(first, width).astype(np.uint32)) + np.uint32(1)) | np.uint32(1)
    whole = np.add.reduceat(text * mult * np.uint32(0xC2B2AE35), first) if len(first) else np.zeros(0, np.uint32)
    places.append((whole ^ (whole >> np.uint32(13))) % np.uint32(TABLE))
    owners.append(np.arange(len(start)))
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return place[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(start)))


def _scores(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Words x languages: scores of each word, computed once for equal words."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    out = np.empty((len(first), model.weights.shape[1]), model.weights.dtype)
    for lo in range(0, len(first), WORDS):
        part = first[lo : lo + WORDS]
        place, at = features(data, start[part], end[part])
        out[lo : lo + len(part)] = np.add.reduceat(model.weights[place], at, axis=0)
    return out[inverse]


def forward_backward(
    scores: np.ndarray, at: np.ndarray, transitions: np.ndarray, initial: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words x languages: probabilities; forward values; backward values times the word's own. at: number of each sequence's first word, and the end; all sequences go side by side."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    start, size = at[:-1][order], size[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(transitions).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    steps = int(size[0]) if len(size) else 0
    live = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
    a = np.exp(initial).astype(e.dtype)[None, :] * e[start]
    for i in range(steps):
        now = start[: live[i]] + i
        if i:
            a = (a[: live[i]] @ t) * e[now]
        a /= a.sum(axis=1, keepdims=True)
        alpha[now] = a
    for i in range(steps - 2, -1, -1):
        now = start[: live[i + 1]] + i
        b = (beta[now + 1] * e[now + 1]) @ t.T
        beta[now] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), alpha, beta * e


def _all_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """word_spans of many texts, a few of them at a time."""
    found, words, lo = [], 0, 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        base = off[lo]
        start, end, key, at = word_spans(data[base : off[hi]], off[lo : hi + 1] - base, _SEPARATOR)
        found.append((start + base, end + base, key, at[:-1] + words))
        words, lo = words + len(start), hi
    start, end, key, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, end, key, np.append(at, words)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Fit a model to labelled texts."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    blob = [x.encode() for x in texts]
    data = np.frombuffer(b" ".join(blob), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in blob])])
    off[-1] -= 1
    start, end, key, at = _all_words(data, off)
    n = len(languages)
    weights = np.zeros((TABLE, n), dtype=np.float64)
    trans, initial = np.zeros((n, n)), np.zeros(n)
    by = [[d for d in range(len(texts)) if langs[d] == lang and at[d + 1] > at[d]] for lang in languages]
    usable = [i for i in range(n) if by[i]]
    if not usable:
        return None
    _, first, word = np.unique(key, return_index=True, return_inverse=True)
    g2w, g2t, g2i = np.full_like(weights, 1e-3), np.full_like(trans, 1e-3), np.full_like(initial, 1e-3)

    def sequence() -> tuple[np.ndarray, np.ndarray]:
        words, labels = [], []
        for _ in range(1 if rng.random() < 0.67 else int(rng.integers(2, 5))):
            k = usable[int(rng.integers(len(usable)))]
            d = by[k][int(rng.integers(len(by[k])))]
            take = int(rng.integers(3, 50))
            a = int(rng.integers(at[d], max(at[d] + 1, at[d + 1] - take + 1)))
            piece = word[a : min(a + take, at[d + 1])]
            words.append(piece)
            labels.append(np.full(len(piece), k))
        return np.concatenate(words), np.concatenate(labels)

    made = [sequence() for _ in range(TRAIN_SEQUENCES)]
    # features of the words that the sequences use
    used, local = np.unique(np.concatenate([w for w, _ in made]), return_inverse=True)
    split = np.cumsum([len(w) for w, _ in made])[:-1]
    made = list(zip(np.split(local.astype(np.int32), split), [y for _, y in made], strict=True))
    first = first[used]
    place, begin = features(data, start[first], end[first])
    place = place.astype(np.int32)
    word_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(begin, len(place))))
    for _ in range(EPOCHS):
        for lo in range(0, len(made), 500):
            part = made[lo : lo + 500]
            w, y = np.concatenate([a for a, _ in part]), np.concatenate([b for _, b in part])
            cut = np.concatenate([[0], np.cumsum([len(a) for a, _ in part])])
            seen, local = np.unique(w, return_inverse=True)
            mine = np.isin(word_of, seen)
            p_of, w_of = place[mine], np.searchsorted(seen, word_of[mine])
            edge = np.searchsorted(w_of, np.arange(len(seen)))
            s = np.add.reduceat(weights[p_of], edge, axis=0)[local]
            prob, alpha, onward = forward_backward(s, cut, trans, initial)
            err = -prob
            err[np.arange(len(y)), y] += 1
            # seen less expected transitions
            inner = np.ones(len(w), bool)
            inner[cut[:-1]] = False
            b = np.flatnonzero(inner)
            seenpair = np.zeros_like(trans)
            np.add.at(seenpair, (y[b - 1], y[b]), 1)
            joint = alpha[b - 1][:, :, None] * np.exp(trans)[None] * onward[b][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            gt = seenpair - joint.sum(axis=0)
            gi = err[cut[:-1]].sum(axis=0)
            by_word = np.stack([np.bincount(local, err[:, i], len(seen)) for i in range(n)], axis=1)
            touched, inv = np.unique(p_of, return_inverse=True)
            gw = np.stack([np.bincount(inv, by_word[w_of, i], len(touched)) for i in range(n)], axis=1) - 1e-3 * weights[touched]
            g2w[touched] += gw**2
            weights[touched] += 0.2 * gw / np.sqrt(g2w[touched])
            g2t += gt**2
            trans += 0.2 * gt / np.sqrt(g2t)
            g2i += gi**2
            initial += 0.2 * gi / np.sqrt(g2i)
    forget_powers()
    return Model(languages, weights.astype(np.float32), trans, initial)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _cutoffs(rows: DataFrame, counts: dict[str, int], quota: int) -> dict[str, int]:
    """By language, the hash of its quota-th row by hash (of its last row if it has fewer).

    Rows below a share that should hold enough of them are listed; languages with too few get a larger share.
    """
    cutoffs, share = {}, {k: (2 * quota + 50) / n for k, n in counts.items()}
    while share:
        bounds = [(k, min(_HASHES, int(x * _HASHES))) for k, x in share.items()]
        near = rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang")
        listed: dict[str, list[int]] = {k: [] for k in share}
        for r in near.where("h < bound").select("lang", "h").distinct().collect():
            listed[r["lang"]].append(r["h"])
        done = [k for k, x in share.items() if x >= 1 or len(listed[k]) >= quota]
        cutoffs |= {k: sorted(listed[k])[:quota][-1] for k in done}
        share = {k: 8 * x for k, x in share.items() if k not in cutoffs}
    return cutoffs


def sample(documents: DataFrame) -> DataFrame | None:
    """doc_id, text, lang of the rows to learn from: of each language the same number (or all), those of the lowest hashes."""
    rows = documents.where("doc_id is not null and text is not null and lang is not null").where(~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    if len(counts) > MAX_DOCS:
        raise ValueError(f"{len(counts)} languages, more than the {MAX_DOCS} texts to learn from")
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(_HASHES)))
    cutoffs = _cutoffs(rows, counts, min(TRAIN_DOCS, MAX_DOCS // len(counts)))
    last = F.broadcast(documents.sparkSession.createDataFrame(list(cutoffs.items()), "lang string, cutoff long"))
    start = F.pmod("h", F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    picked = rows.join(last, "lang").where("h <= cutoff").select("doc_id", F.substring("text", start, F.lit(TRAIN_CHARS)).alias("text"), "lang")
    return picked.distinct()


def fit(documents: DataFrame) -> Model | None:
    """Learn from a bounded sample of the rows that aren't held out."""
    picked = sample(documents)
    if picked is None:
        return None
    rows = picked.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), rows["lang"].to_pylist())


def _runs(best: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words of one language: number of the first and last word, and language."""
    edge = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(edge[1:], len(best)) - 1
    return [{"first": int(a), "last": int(b), "lang": languages[best[a]]} for a, b in zip(edge, last, strict=True)]


def _label(m: Model | None, texts: pa.Array, parts: list | None = None, sure: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; parts, if given, gets the runs of words of one language, sure the mean of each word's largest probability."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for lo, _, data, off in chunks(texts, CHUNK):
        if m is None:
            break
        start, end, key, at = word_spans(data, off, _SEPARATOR)
        if not len(start):
            continue
        prob, _, _ = forward_backward(_scores(m, data, start, end, key), at, m.transitions, m.initial)
        full = np.flatnonzero(at[1:] > at[:-1])
        mean = np.add.reduceat(prob, at[:-1][full], axis=0) / np.diff(at)[full][:, None]
        plain = np.logical_or.reduceat((data[start] < 128) | (data[end - 1] < 128), at[:-1][full])
        for r, row, has_ascii in zip(full, mean, plain, strict=True):
            if not has_ascii and not any(c.isalpha() for c in texts[lo + r].as_py()):
                continue
            k = int(row.argmax())
            lang[lo + r], score[lo + r] = m.languages[k], min(1.0, float(row[k]))
            if sure is not None:
                sure[lo + r] = prob[at[r] : at[r + 1]].max(axis=1).mean()
            if parts is not None:
                parts[lo + r] = _runs(prob[at[r] : at[r + 1]].argmax(axis=1), m.languages)
    return lang, score


def predict(documents: DataFrame, model: Model | None, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with runs, also the runs of words of one language."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list | None = [[] for _ in range(batch.num_rows)] if runs else None
            lang, score = _label(held.value, batch.column(1), parts)
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(score)]
            if runs:
                out.append(pa.array(parts, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "runs"][: len(out)])

    extra = ", runs array<struct<first:int,last:int,lang:string>>" if runs else ""
    return documents.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, lang_pred string, score double{extra}")


def identify(documents: DataFrame) -> DataFrame:
    """Fit, then predict every row: doc_id, held_out, lang_pred, score."""
    return predict(documents, fit(documents)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def filter_known(documents: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows whose words are known with at least a mean probability, each in its own language, with the text's most probable one as lang.

    So a text that switches between languages stays, however many they are. Rows pass whole through the Arrow tasks, so no join by doc_id and no shuffle is needed.
    """
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = documents.columns.index("text"), documents.columns.index("lang")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = np.zeros(batch.num_rows)
            lang, _ = _label(held.value, batch.column(at[0]), sure=sure)
            keep = pa.array([g != UNDETERMINED and s >= least for g, s in zip(lang, sure, strict=True)])
            columns = [pa.array(lang, pa.string()) if i == at[1] else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)
            pa.default_memory_pool().release_unused()
        give_back()

    return documents.mapInArrow(task, documents.schema)
