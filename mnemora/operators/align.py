"""Alignment of two editions, section by section, by dynamic programming over sentence vectors.

Of all monotone groupings the cheapest is taken. The cost of a group is one less the cosine of the two sides' mean
vectors, plus a tenth of the logarithm of their lengths' ratio. Means and lengths of all runs of one to three sentences come
from prefix sums, costs from products over strips of the table, which is filled row by row, all cells of a row at once. Memory grows
with the longer side times the root of the other, not with their product: the moves of a block of rows are made again on the way back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many sentences of each side a group may have, of equal costs the earlier; the weight of lengths.
MOVES = ((3, 1), (2, 1), (1, 3), (1, 2), (1, 1))
PENALTY = 0.1
#: Cells of the table that are costed at once.
STRIP_CELLS = 1 << 20


def _runs(vectors: np.ndarray, lengths: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For runs of one to three sentences: the unit mean vector and the logarithm of the length plus one, by the run's first sentence."""
    sums, totals = (np.concatenate([np.zeros((1, *x.shape[1:])), x.cumsum(0)]) for x in (vectors, lengths))
    out = {}
    for n in {m for move in MOVES for m in move}:
        if n <= len(vectors):
            means = (sums[n:] - sums[:-n]) / n
            norms = np.linalg.norm(means, axis=1, keepdims=True)
            out[n] = means / np.where(norms > 0, norms, 1), np.log(totals[n:] - totals[:-n] + 1)
    return out


def groups(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> list[tuple[range, range]]:
    """The cheapest split of both sides into groups; sides that no groups cover are paired one to one, the rest in the last pair."""
    m, n = len(a), len(b)
    if not m or not n:
        return []
    if m > 3 * n or n > 3 * m:
        last = min(m, n) - 1
        return [*((range(k, k + 1), range(k, k + 1)) for k in range(last)), (range(last, m), range(last, n))]
    left, right = _runs(np.asarray(a, float), np.asarray(la, float)), _runs(np.asarray(b, float), np.asarray(lb, float))
    # every move takes a sentence of the left side at least: a row of the table follows from the three before it
    lead = {x: left[x] for x in {p for p, _ in MOVES} if x in left}
    kinds = [(number, p, q) for number, (p, q) in enumerate(MOVES) if p in left and q in right]
    high = max(1, STRIP_CELLS // (n + 1))

    def rows(begin: int, end: int, held: list[np.ndarray], moves: np.ndarray | None = None) -> list[np.ndarray]:
        """The last three rows before ``end``, from the three before row ``begin``; the moves of rows from ``begin`` on are written to ``moves``."""
        for at in range(begin, end, high):
            until = min(end, at + high)
            costs = {}
            for number, p, q in kinds:
                first = max(at - p, 0)
                u, ul, v, vl = lead[p][0][first : until - p], lead[p][1][first : until - p], *right[q]
                costs[number] = first, 1 - u @ v.T + PENALTY * abs(ul[:, None] - vl[None, :]) if len(u) else None
            for i in range(at, until):
                best, chosen = np.full(n + 1, np.inf), np.zeros(n + 1, np.int8)
                for number, p, q in kinds:
                    if i >= p:
                        first, cost = costs[number]
                        reached = held[-p][: n + 1 - q] + cost[i - p - first]
                        better = reached < best[q:]
                        best[q:][better] = reached[better]
                        chosen[q:][better] = number
                if moves is not None:
                    moves[i - begin] = chosen
                held = [*held[-2:], best]
        return held

    # of the table only three rows in ``every`` are kept; a block's moves are made again when the way back comes to it
    nothing = np.full(n + 1, np.inf)
    start = np.full(n + 1, np.inf)
    start[0] = 0
    every = max(high, int((24 * m) ** 0.5) + 1)
    kept = [[nothing, nothing, start]]
    for begin in range(1, m + 1, every):
        kept.append(rows(begin, min(begin + every, m + 1), kept[-1]))
    path = []
    i, j, below, moves = m, n, m + 1, None
    while i:
        if i < below:
            block = (i - 1) // every
            below = block * every + 1
            end = min(below + every, m + 1)
            moves = np.empty((end - below, n + 1), np.int8)
            rows(below, end, kept[block], moves)
        p, q = MOVES[moves[i - below, j]]
        path.append((range(i - p, i), range(j - q, j)))
        i, j = i - p, j - q
    return path[::-1]


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(section, number, left array<int>, right array<int>)`` from sentences ``(section, place, vector, length)`` of both sides.

    A section is a task's group: it is one section of a book. Its time is the product of its two sides, its memory is not (see ``groups``).
    """

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("place"), b.sort_values("place")
        side = lambda d: (np.array(d["vector"].tolist(), float).reshape(len(d), -1 if len(d) else 0), d["length"].to_numpy(float))
        (va, la), (vb, lb) = side(a), side(b)
        rows = [(key[0], k, list(x), list(y)) for k, (x, y) in enumerate(groups(va, vb, la, lb))]
        return pd.DataFrame(rows, columns=["section", "number", "left", "right"])

    kind = left.schema["section"].dataType.simpleString()
    return left.groupBy("section").cogroup(right.groupBy("section")).applyInPandas(one, f"section {kind}, number int, left array<int>, right array<int>")


def normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector unchanged."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))
