"""Token ids of whole texts by a public tokenizer, each distinct unit encoded once.

The tokenizer normalises, cuts at white space, and matches runs of letters, single digits and
runs of other characters. A piece between ASCII white space is therefore encoded alike wherever
it stands, and so are runs of letters, digits and ASCII marks in pieces that hold nothing but
ASCII (without apostrophe or control characters) and Latin-1 letters. Those units are told apart
by 64-bit hashes, and ids are gathered from a table of units.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import chunks, mix, powers

MAX_UNITS = 1_000_000
_SPACE, _LETTER, _MARK, _DIGIT, _LEAD, _WHOLE = 0, 1, 2, 3, 4, 5
_CLASS = np.full(256, _WHOLE, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[39] = _WHOLE  # apostrophes join what they stand between
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[0xC3] = _LEAD
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # the tokenizer lower-cases
#: byte to character in the vocabulary's alphabet: printable Latin-1 stays, others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit and, by row, the number of its first unit."""
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(kind[:-1] == _LEAD)
    nxt = data[lead + 1]
    good = (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
    kind[lead[good]], kind[lead[good] + 1] = _LETTER, _LETTER
    kind[lead[~good]] = _WHOLE
    if n and kind[-1] == _LEAD:
        kind[-1] = _WHOLE
    space = kind == _SPACE
    edge = np.zeros(n, bool)
    edge[off[:-1][off[:-1] < off[1:]]] = True
    piece = edge.copy()
    piece[1:] |= space[:-1]
    piece &= ~space
    first = np.flatnonzero(piece)
    if not len(first):
        return first, first, np.zeros(len(off), np.int64)
    whole = np.zeros(len(first), bool)
    whole[np.searchsorted(first, np.flatnonzero(kind == _WHOLE), "right") - 1] = True
    of = np.cumsum(piece) - 1
    turn = np.zeros(n, bool)
    turn[1:] = (kind[1:] != kind[:-1]) & ~space[1:]
    start = np.flatnonzero(piece | (turn & ~whole[np.maximum(of, 0)]))
    stop = space.copy()
    stop[: n - 1] |= edge[1:]
    ends = np.flatnonzero(np.concatenate([space[1:] | edge[1:], [True]]) & ~space) + 1
    limit = ends[np.searchsorted(ends, start, "right")]
    end = np.minimum(np.append(start[1:], n), limit)
    return start, end, np.searchsorted(start, off)


class Encoder:
    """Encodes columns of texts; remembers units between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, units: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(units)
        rest = []
        for i, u in enumerate(units):
            if u.isalpha() and len(u) < 40:
                out[i] = [t.id for t in self.model.tokenize(u.lower().decode())]
            elif len(u) < 40 and (s := u.decode("utf-8", "replace")).isalpha() and all(c < "Ā" for c in s):
                out[i] = [t.id for t in self.model.tokenize("".join(_ALPHABET[b] for b in s.lower().encode()))]
            else:
                rest.append(i)
        for lo in range(0, len(rest), 1000):
            part = rest[lo : lo + 1000]
            coded = self.tokenizer.encode_batch([units[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)
            for i, e in zip(part, coded, strict=True):
                out[i] = e.ids
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each row; a null text has none."""
        for lo, hi, data, off in chunks(texts):
            # texts that spell special tokens are rare and go whole through the tokenizer
            special = {}
            if (raw := data.tobytes()).find(b"<|") >= 0:
                for r in range(hi - lo):
                    text = raw[off[r] : off[r + 1]]
                    if any(x in text for x in self.special):
                        special[r] = np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            start, end, at = _units(data, off)
            n = len(data)
            up, down = powers(n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * up[:n], out=total[1:])
            key = mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            place = np.searchsorted(self.key, distinct)
            known = np.zeros(len(distinct), bool)
            inside = place < len(self.key)
            known[inside] = self.key[place[inside]] == distinct[inside]
            if not known.all():
                fresh = np.flatnonzero(~known)
                coded = self._encode([raw[start[i] : end[i]] for i in first[fresh]])
                if len(self.key) + len(fresh) > MAX_UNITS:
                    keep = known.nonzero()[0]
                    old = [self.ids[self.at[p] : self.at[p] + self.size[p]] for p in place[keep]]
                    self.forget()
                    coded = [*coded, *old]
                    fresh = np.concatenate([fresh, keep])
                size = np.array([len(x) for x in coded], dtype=np.int64)
                begin = len(self.ids) + np.cumsum(size) - size
                self.ids = np.concatenate([self.ids, np.concatenate([np.asarray(x, np.uint32) for x in coded])])
                k = np.concatenate([self.key, distinct[fresh]])
                order = np.argsort(k, kind="stable")
                self.key = k[order]
                self.at = np.concatenate([self.at, begin])[order]
                self.size = np.concatenate([self.size, size])[order]
                place = np.searchsorted(self.key, distinct)
            count = self.size[place][inverse]
            ends = np.cumsum(count)
            src = np.repeat(self.at[place][inverse] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)
            flat = self.ids[src]
            edge = np.concatenate([[0], ends])[at]
            for r in range(hi - lo):
                yield lo + r, special.get(r, flat[edge[r] : edge[r + 1]])
