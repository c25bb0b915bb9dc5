"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. A text's features are the n-grams (3 to 5 characters, lower case, runs of white space as one space) that occur in it,
   hashed to buckets; the whole text is read, by array operations.
2. Naive Bayes: how many labelled documents of each class have a bucket. Tasks count in arrays and give a row
   for each bucket they met; a Spark aggregate sums them. A bucket's ratio is
   log((n1 + a) / (N1 + 2a)) - log((n0 + a) / (N0 + 2a)). The ``features`` buckets whose counts tell most (by
   likelihood ratio) are kept.
3. Logistic regression with an L2 penalty over present buckets times their ratios. Each step of the quasi-Newton
   descent is one Spark job over the training rows, written once as lists of features; a task returns one
   row of sums, and Spark adds them by blocks of features.
4. A map over whole texts scores every document.

What is learned from: the labelled rows of the training folds, at most ``most_rows`` of them (those of the least hash of
their id), which bounds what is broadcast to meet the texts: 16 bytes a row. The driver holds ``features`` numbers,
at any input size. Counting and descent are distributed over the rows.

Defined cases: a null or empty text has no features and the score of the intercept; labels other than 0 and 1 or null are
ignored; of repeated labels, and of repeated ids, each row counts; where a class has no training rows, all scores are the
smoothed share of label 1; null ids are scored and held out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, texts
from .quality import HELD_OUT, fold

THRESHOLD = 0.5
BITS, SHORTEST, LONGEST = 18, 3, 5
BLOCK = 256


@dataclass
class Shape:
    """Kept buckets, most training rows, smoothing of counts, penalty, steps of the descent."""

    features: int = 4096
    most_rows: int = 200_000
    smoothing: float = 1.0
    penalty: float = 1.0
    steps: int = 25


def buckets(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text, repeated as they occur."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = c <= 32
    c = np.where(space, np.uint64(32), c)[~(space & np.r_[False, space[:-1]])]
    out = []
    h = c[:0]
    for n in range(1, LONGEST + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = c + np.uint64(7) if n == 1 else h[:m] * np.uint64(0x100000001B3 | 1 << 60) + c[n - 1 :]
        if n >= SHORTEST:
            x = h * np.uint64(0x9E3779B97F4A7C15)
            out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass
class Linear:
    """Kept buckets with their ratios and weights; ``place`` gives a bucket's number among them, -1 if it isn't kept."""

    prior: float
    kept: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float | None = None

    def places(self) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int32)
        place[self.kept] = np.arange(len(self.kept))
        return place

    def score(self, text: str, place: np.ndarray) -> float:
        if self.bias is None:
            return self.prior
        at = present(text, place, len(self.kept))
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weight * self.ratio)[at].sum(), -60, 60))))


def present(text: str, place: np.ndarray, n: int) -> np.ndarray:
    """The kept features that a text has, each once, in order."""
    found = place[buckets(text)]
    return np.flatnonzero(np.bincount(found[found >= 0], minlength=n))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> DataFrame:
    """``(label, text)`` of the labelled documents in the training folds, by a broadcast of bounded size."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(fold(F.col("id")) != HELD_OUT)
    if known.count() > most_rows:
        known = known.orderBy(F.xxhash64("id"), "id", "label").limit(most_rows)
    return texts(docs, id_col, text_col).join(F.broadcast(known), "id").select("label", "text")


def counted(train: DataFrame) -> DataFrame:
    """``(bucket, n0, n1)``: documents of each class that have a bucket; bucket -1 counts all documents."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            for label, text in zip(column(batch, "label").to_pylist(), column(batch, "text").to_pylist()):
                seen = np.zeros(1 << BITS, bool)
                seen[buckets(text)] = True
                counts[label] += seen
                total[label] += 1
        some = np.flatnonzero(counts.any(0))
        if total.any():
            values = [np.r_[-1, some], np.r_[total[0], counts[0, some]], np.r_[total[1], counts[1, some]]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["bucket", "n0", "n1"])

    return train.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _evidence(n: tuple[int, int]):
    """Likelihood ratio of a bucket's two counts against independence of the class."""
    share = n[1] / sum(n)
    both = F.col("n0") + F.col("n1")
    term = lambda c, expected: F.when(c > 0, c * F.log(c / expected)).otherwise(0.0)
    inside = term(F.col("n1"), both * share) + term(F.col("n0"), both * (1 - share))
    left = [F.lit(n[k]) - F.col(f"n{k}") for k in (0, 1)]
    out = F.lit(sum(n)) - both
    return inside + term(left[1], out * share) + term(left[0], out * (1 - share))


def _descend(gradient, n: int, steps: int, memory: int = 8) -> np.ndarray:
    """Least point of a smooth convex function by limited-memory quasi-Newton steps; each evaluation is a Spark job."""
    x = np.zeros(n)
    value, g = gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        size, slope = 1.0, -(g @ q)
        while True:
            tried = x - size * q
            new, h = gradient(tried)
            if new <= value + 1e-4 * size * slope or size < 1e-3:
                break
            size /= 4
        if new > value:
            break
        if (h - g) @ (tried - x) > 1e-12:
            pairs = [*pairs, (tried - x, h - g)][-memory:]
        done = value - new < 1e-5 * max(1.0, abs(value))
        x, value, g = tried, new, h
        if done:
            break
    return x


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shape: Shape | None = None) -> Linear:
    """Count, choose and weigh the features of the labelled documents in the training folds."""
    shape = shape or Shape()
    train = labelled(docs, labels, id_col, text_col, label_col, shape.most_rows)
    sums = cut(counted(train))
    whole = sums.where("bucket = -1").first()
    n = (whole["n0"], whole["n1"]) if whole else (0, 0)
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 1:
        return Linear(prior)
    best = sums.where("bucket >= 0").select("bucket", "n0", "n1", _evidence(n).alias("e")).orderBy(F.desc("e"), "bucket").limit(shape.features).collect()
    kept = np.array([r["bucket"] for r in best], np.int64)
    a = shape.smoothing
    one, zero = (np.array([r[c] for r in best], float) for c in ("n1", "n0"))
    ratio = np.log((one + a) / (n[1] + 2 * a)) - np.log((zero + a) / (n[0] + 2 * a))
    model, k = Linear(prior, kept, ratio), len(kept)
    place = model.places()

    def listed(batches):
        for batch in batches:
            rows = [present(t, place, k).astype(np.int32) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(rows, pa.list_(pa.int32()))], ["label", "at"])

    written = cut(train.mapInArrow(listed, "label int, at array<int>"))
    size = k + 2  # weights, bias, loss

    def gradient(x: np.ndarray):
        scaled, bias = x[:k] * ratio, x[k]

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                y = column(batch, "label").to_numpy()
                lists = column(batch, "at")
                at, edges = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                prefix = np.r_[0.0, np.cumsum(scaled[at])]
                z = bias + prefix[edges[1:]] - prefix[edges[:-1]]
                error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
                total[:k] += np.bincount(at, np.repeat(error, np.diff(edges)), k)
                total[k] += error.sum()
                total[k + 1] += np.logaddexp(0, np.where(y == 1, -z, z)).sum()
            starts = range(0, size, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([np.resize(np.r_[total[i : i + BLOCK], np.zeros(BLOCK)], BLOCK) for i in starts], pa.list_(pa.float64()))], ["block", "v"])

        blocks = written.mapInArrow(run, "block int, v array<double>").groupBy("block").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(BLOCK)]).alias("v")).collect()
        total = np.concatenate([np.array(r["v"]) for r in sorted(blocks, key=lambda r: r["block"])])[:size]
        g = np.r_[total[:k] * ratio + shape.penalty * x[:k], total[k]]
        return total[k + 1] + shape.penalty / 2 * (x[:k] @ x[:k]), g

    x = _descend(gradient, k + 1, shape.steps)
    model.weight, model.bias = x[:k], float(x[k])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, shape: Shape | None = None) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``."""
    model = learn(docs, labels, id_col, text_col, label_col, shape)
    rows = texts(docs, id_col, text_col)

    def run(batches):
        place = model.places()
        for batch in batches:
            scores = [model.score(t, place) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").select(
        "id", F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
