"""Fixtures and brute-force forms for the training-data operators."""

import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, salt: str) -> str:
    return " ".join(f"w{salt}x{i}" for i in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, tiny and very long texts, copies, near copies and repeated rows."""
    base = words(60, "a")
    near = base.replace("wax30", "other")
    long = words(30_000, "long")
    rows = [
        (1, base, "en", "s0"), (2, base.upper().replace(" ", "\n\t "), "en", "s0"), (3, near, "en", "s1"), (4, words(60, "b"), "de", None),
        (5, None, None, None), (6, "", "en", "s0"), (7, " \t\n", None, "s0"), (8, "one two", "en", "s0"), (9, "ONE  two", "en", "s0"),
        (10, "two one", "en", "s0"), (11, long, "en", "s0"), (12, long + " tail", "en", "s0"), (13, "short text", "fr", "s1"), (13, "short text", "fr", "s1"),
        (None, base, "en", "s0"), (14, "é à ü ñ 😀 ‘x’", None, "s0"), (15, "1234 !!! 5678", "en", "s0"),
    ]
    return [(a, t, g, s, None if t is None else len(t)) for a, t, g, s in rows]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(docs: list[tuple]) -> dict:
    """(n_shingles, component) by doc_id, from all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
