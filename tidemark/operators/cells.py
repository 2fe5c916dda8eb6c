"""The best partner of each row inside a cell (a date, a nation), with no pair leaving its task.

Both sides are brought down to distinct rows and meet by cell; a crowded cell is cut into parts of both sides, and the parts' best are compared. Inside
a task each pair has an upper bound of its score: names share no more characters in a Ratcliff-Obershelp matching than their longest common
subsequence has, found bit by bit for one name against all others at once (numpy). Pairs are scored in falling order of their bounds, until a score
is no lower than every bound left, so the search is exact and few pairs are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: rows of a part of a cell, by side
LEFT, RIGHT = 1000, 4000
CACHED = 500_000
_known: dict[tuple[str, str], float] = {}


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio, kept for the next cells of the same worker."""
    found = _known.get((a, b))
    if found is None:
        if len(_known) >= CACHED:
            _known.clear()
        found = _known[a, b] = SequenceMatcher(None, a, b).ratio()
    return found


class Names:
    """Names side by side: bounds() of another name's ratio to all of them."""

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names], dtype="int64")
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(names))), 1)}
        self.codes = np.zeros((max(self.lengths, default=0), len(names)), dtype="int64")
        for i, n in enumerate(names):
            self.codes[: len(n), i] = [self.alphabet[c] for c in n]

    def bounds(self, name: str) -> np.ndarray:
        n = len(name)
        if n > 63:
            shared = np.minimum(self.lengths, n)
        else:
            table = np.zeros(len(self.alphabet) + 1, dtype="uint64")
            for i, c in enumerate(name):
                if c in self.alphabet:
                    table[self.alphabet[c]] |= np.uint64(1 << i)
            rest = np.full(len(self.lengths), 2**64 - 1, dtype="uint64")
            for column in self.codes:
                met = rest & table[column]
                rest = (rest + met) | (rest - met)
            shared = np.bitwise_count(~rest & np.uint64((1 << n) - 1)).astype("int64")
        length = self.lengths + n
        # the same arithmetic as the ratio's, so that a bound that is reached is equal to it
        return np.where(length > 0, 2.0 * shared / np.maximum(length, 1), 1.0)


class Table:
    """Scores of two lists of names: bounds at first, exact ones once they are asked for."""

    def __init__(self, left: pd.Series, right: pd.Series, score: Callable[[str, str], float] = ratio, at_least: Callable[[str, str], float] | None = None):
        self.i, self.left = pd.factorize(left)
        self.j, self.right = pd.factorize(right)
        held = Names(list(self.right))
        self.values = np.array([held.bounds(x) for x in self.left]).reshape(len(self.left), len(self.right))
        if at_least is not None:
            self.values = np.maximum(self.values, np.array([[at_least(x, y) for y in self.right] for x in self.left]).reshape(self.values.shape))
        self.score, self.exact = score, np.zeros(self.values.shape, dtype=bool)

    def row(self, i: int) -> np.ndarray:
        return self.values[self.i[i]][self.j]

    def at(self, i: int, j: int) -> float:
        i, j = self.i[i], self.j[j]
        if not self.exact[i, j]:
            self.values[i, j], self.exact[i, j] = self.score(self.left[i], self.right[j]), True
        return float(self.values[i, j])


def search(bounds: np.ndarray, exact: Callable[[int], float], least: float) -> tuple[int, float] | None:
    """(index, score) of the highest score of at least `least`, the first at ties; bounds are overwritten."""
    seen: set[int] = set()
    while len(bounds):
        j = int(bounds.argmax())
        if not bounds[j] >= least:
            return None
        if j in seen:
            return j, float(bounds[j])
        bounds[j] = exact(j)
        seen.add(j)
    return None


def best_by_cell(left: DataFrame, right: DataFrame, cell: str, rank: str, find: Callable[[pd.DataFrame, pd.DataFrame], list[tuple[int, int, float]]]) -> DataFrame:
    """left's columns, right's (other than cell) and score: of each distinct row of left the best row of its cell, the smaller rank at ties.

    find(left, right) gives (row of left, row of right, score) of parts of a cell; right comes in order of rank.
    """
    ship(left.sparkSession)
    keys, more = left.columns, [c for c in right.columns if c != cell]
    sizes = left.groupBy(cell).agg(F.ceil(F.count("*") / LEFT).cast("int").alias("_pl")).join(right.groupBy(cell).agg(F.ceil(F.count("*") / RIGHT).cast("int").alias("_pr")), cell)

    def dealt(df: DataFrame, own: str, other: str, p: str, q: str) -> DataFrame:
        rows = df.join(sizes, cell).withColumn(p, F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int"))
        return rows.withColumn(q, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*df.columns, "_p", "_q")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in (*keys, *more, "score")})
        y = y.sort_values(rank, kind="stable").reset_index(drop=True)
        found = find(x, y)
        out = x[keys].iloc[[i for i, _, _ in found]].reset_index(drop=True)
        out[more] = y[more].iloc[[j for _, j, _ in found]].reset_index(drop=True)
        out["score"] = np.array([s for _, _, s in found], dtype="float64")
        return out

    kinds = {**dict(left.dtypes), **dict(right.dtypes), "score": "double"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *more, "score"))
    x, y = dealt(left, "_pl", "_pr", "_p", "_q"), dealt(right, "_pr", "_pl", "_q", "_p")
    # cells are small and dear: a number of tasks that isn't brought down to their few bytes
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (d.repartition(n, cell, "_p", "_q") for d in (x, y))
    met = x.groupBy(cell, "_p", "_q").cogroup(y.groupBy(cell, "_p", "_q")).applyInPandas(meet, schema)
    rest = [c for c in more if c != rank]
    top = met.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("_n"), rank, *rest)).alias("_b"))
    return top.select(*keys, *(f"_b.{c}" for c in more), (-F.col("_b._n")).alias("score"))


def names_in(least: float, a: str, b: str):
    """find() for one name on each side."""

    def find(x: pd.DataFrame, y: pd.DataFrame) -> list:
        held, names = Names(list(y[b])), list(y[b])
        out = []
        for i, name in enumerate(x[a]):
            hit = search(held.bounds(name), lambda j: ratio(name, names[j]), least)  # noqa: B023
            if hit:
                out.append((i, *hit))
        return out

    return find


def teams_in(least: float, floor: float):
    """find() for (team_a, team_b) and (home, away): the larger mean of both orientations, of which one must have both sides above floor."""

    def find(x: pd.DataFrame, y: pd.DataFrame) -> list:
        ah, ba, aa, bh = (Table(x[a], y[b]) for a, b in (("team_a", "home"), ("team_b", "away"), ("team_a", "away"), ("team_b", "home")))
        out = []
        for i in range(len(x)):
            first, second, third, fourth = (t.row(i) for t in (ah, ba, aa, bh))
            gate = (np.minimum(first, second) > floor) | (np.minimum(third, fourth) > floor)
            bounds = np.where(gate, np.maximum((first + second) / 2, (third + fourth) / 2), -1.0)

            def exact(j: int) -> float:
                p, q, r, s = (t.at(i, j) for t in (ah, ba, aa, bh))  # noqa: B023
                return max((p + q) / 2, (r + s) / 2) if min(p, q) > floor or min(r, s) > floor else -1.0

            hit = search(bounds, exact, least)
            if hit:
                out.append((i, *hit))
        return out

    return find


def questions_in(least: float):
    """find() for (home, away; one may be null) and question: the mean of both sides' similarity, 0.6 at least where a word of the name is in it, above `least`."""

    def word(name: str, text: str) -> float:
        return 0.6 if any(len(w) > 3 and w in text.lower() for w in name.lower().split(" ")) else 0.0

    def side(name: str, text: str) -> float:
        return max(ratio(name, text), word(name, text))

    def find(x: pd.DataFrame, y: pd.DataFrame) -> list:
        tables = [(x[c].notna().to_numpy(), Table(x[c].fillna(""), y["question"], side, word)) for c in ("home", "away")]
        out = []
        for i in range(len(x)):
            bounds = sum(t.row(i) if known[i] else np.zeros(len(y)) for known, t in tables) / 2
            hit = search(bounds, lambda j: sum(t.at(i, j) if known[i] else 0.0 for known, t in tables) / 2, np.nextafter(least, 2.0))  # noqa: B023
            if hit:
                out.append((i, *hit))
        return out

    return find


def known(*names: str) -> Column:
    """Whether all of the columns are there."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out
