"""Quality classifier: regularised quadratic discriminant over document statistics.

One map over whole texts gives each document a vector of transformed statistics (sizes,
shares of kinds of characters, repetition of words and lines). Labelled rows in the training
folds give, by sums and sums of products in one Spark aggregate, the mean and covariance of each
class; a covariance is shrunk towards the pooled one and its diagonal. A score is the
logistic of the difference of the classes' log densities (Mahalanobis distance by the cached
Cholesky factor, log determinant, prior), tempered by the number of statistics.

What reaches the driver is the sums: 2 rows of d + d*d numbers at any input size. All labelled rows
of the training folds take part. The statistics are written once to the shared folder, since
the fit and the scores both read them.

Defined cases: a null or empty text has the statistics of an empty one and a score; labels other
than 0 and 1 or null are ignored, of repeated labels each counts; where a class has no rows, all
scores are the smoothed share of label 1; rows with null ids are scored and held out of the fit;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, column_bytes, cut, texts

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

STATISTICS = ("log_bytes", "upper", "symbols", "pipes", "stops", "digits", "marks", "space", "word_length", "varied", "runs", "copied_lines", "long_words")

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # upper case; in UTF-8 the second byte of À to Þ is 128 to 158 after 195
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = 2
_KIND[ord("|")] = 3
_KIND[[ord(c) for c in ".,;:?"]] = 4
_KIND[48:58] = 5
_KIND[ord("!")] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7


def statistics(text: bytes) -> np.ndarray:
    """The vector of one text; every entry is finite, also for the empty text."""
    n = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) if n else np.zeros(8, np.int64)
    words = text.split()
    w = len(words)
    lines = text.split(b"\n")
    letters = max(1, n - kinds[2:].sum())
    varied = len(set(words)) / w if w else 1.0
    runs = sum(map(bytes.__eq__, words[1:], words)) / w if w else 0.0
    long_words = sum(len(x) > 24 for x in words) / w if w else 0.0
    share = lambda x, of: np.sqrt(x / max(1, of))
    return np.array([
        np.log1p(n), share(kinds[1], letters), share(kinds[2], n), share(kinds[3], n), share(kinds[4], n), share(kinds[5], n), share(kinds[6], n), share(kinds[7], n),
        np.log1p(n / max(1, w)), np.log(varied) / np.log1p(np.log1p(w)) if w > 1 else 0.0, np.sqrt(runs), np.sqrt(1 - len(set(lines)) / len(lines)), np.sqrt(long_words),
    ])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x array<double>)`` for every row."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of classes 0 and 1."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None
    temper: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) / self.temper, -60, 60)))


def fit(train: DataFrame, pooled: float = 0.1, diagonal: float = 0.05, least: float = 1e-4) -> Discriminant:
    """From ``(label, x)``: class moments by one aggregate, then factors of shrunk covariances."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = train.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")
    )
    by = {r["label"]: r for r in sums.collect()}  # a row for each of two classes
    n = [by[k]["n"] if k in by else 0 for k in (0, 1)]
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 1:
        return Discriminant(prior)
    means, covs = [], []
    for k in (0, 1):
        m = np.array(by[k]["s"]) / n[k]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, by[k]["p"]):
            second[i, j] = second[j, i] = v / n[k]
        means.append(m)
        covs.append(second - np.outer(m, m))
    both = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    factors, constants = [], []
    for k in (0, 1):
        own = pooled + (1 - pooled) * d / (d + n[k])  # few rows lean on the pooled one
        c = (1 - own) * covs[k] + own * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + least * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(n[k] / sum(n)) - np.log(np.diag(low)).sum())
    return Discriminant(prior, np.array(means), np.array(factors), np.array(constants), temper=np.sqrt(d))


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    """``(id, score)`` from ``(id, x)``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(model.scores(values))], ["id", "score"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double")


def learn(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit to statistics ``(id, x)`` by the labels of the training folds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label in (0, 1)")
    return fit(x.join(known.where(fold(F.col("id")) != HELD_OUT), "id").select("label", "x"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``."""
    x = cut(features(docs, id_col, text_col))
    return score(x, learn(x, labels, id_col, label_col)).select(
        "id", F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; same columns, nothing shuffled but the fit's statistics."""
    model = learn(cut(features(docs, id_col, text_col)), labels, id_col, label_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = model.scores(np.array([statistics(t) for t in column_bytes(batch, text_col)])) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
