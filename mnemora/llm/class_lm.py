"""LM scoring by Brown class-based bigrams.

P(word | previous) = P(class(word) | class(previous)) * P(word | class(word)). Classes come from
exchange clustering, made distributed: what is exchanged are units, the ``frequent`` most
frequent words each and pools of all other words by their last three bytes (so words never seen
belong to a class too). An iteration reads all training tokens once and sums, for each unit, the
classes before and after it: two matrices of units x classes, summed by Spark and of a size that doesn't grow with
the input. Then half of the units move to the class of the greatest likelihood, the other half next time,
so that two units don't follow one another in a circle.

Emissions use exact counts of every training word, tail included; these are gathered over all
training documents by chunk dictionaries (see ``chunks``): one aggregate over words, with partial sums in the
map tasks, and a join of the counts with the chunks that have the word. The frequent words, which nearly all chunks have, are numbered and
counted in the tasks and take no part in that join. Transitions are smoothed by the classes'
own shares. A word unknown in training is one more type; after each class it has the Good-Turing
mass of words seen once. The class model is mixed with a little of the add-half unigram, so
every probability is positive and they sum to 1 over known words, the end and the unknown type.

Defined cases: a null or empty text is one end token; null ids are held out; repeated ids give
a row each; very long texts are chunks of their own; without any training text every token has
probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import column, cut, discard, small

FOLDS, HELD_OUT = 5, 1


@dataclass
class Shape:
    """Numbers of frequent words, pools and classes, iterations, and the unigram's share."""

    frequent: int = 4096
    pools: int = 1024
    classes: int = 64
    iterations: int = 5
    unigram: float = 0.02

    @property
    def units(self) -> int:
        return 1 + self.frequent + self.pools  # unit 0: the end, and what stands before a text


def split(text: bytes) -> list[bytes]:
    """Words in lower case (A to Z only), at white space."""
    return text.lower().split()


def _numbered(joined: DataFrame, frequent: dict[bytes, int], shape: Shape) -> DataFrame:
    """Chunks with the global count and the unit of each of their words, as binary arrays.

    ``frequent``: counts of the frequent words, the most frequent first; ``got`` has those of the others.
    """
    id_type = joined.schema["ids"].dataType.simpleString()

    def run(batches):
        place = {w: k + 1 for k, w in enumerate(frequent)}
        pooled = 1 + shape.frequent
        for batch in batches:
            got = column(batch, "got")
            for i in range(batch.num_rows):
                words = column(batch, "words")[i].as_py()
                counts = np.zeros(len(words), "<i8")
                if got[i].is_valid and len(got[i].values):
                    counts[got[i].values.field("place").to_numpy()] = got[i].values.field("c").to_numpy()
                units = np.fromiter((place.get(w) or pooled + zlib.crc32(w[-3:]) % shape.pools for w in words), "<u2", len(words))
                often = np.flatnonzero((units > 0) & (units < pooled))
                counts[often] = [frequent[words[j]] for j in often]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(column(one, c) for c in ("ids", "sizes", "train", "codes")), pa.array([counts.tobytes()], pa.binary()), pa.array([units.tobytes()], pa.binary())], ["ids", "sizes", "train", "codes", "counts", "units"])

    return joined.mapInArrow(run, f"ids {id_type}, sizes array<int>, train array<boolean>, codes binary, counts binary, units binary")


def _sequence(batch: pa.RecordBatch, i: int, end_count: int, train_only: bool):
    """Units and counts of a chunk's tokens, each text followed by its end; also the ends' places."""
    sizes = column(batch, "sizes")[i].values.to_numpy()
    codes = chunks.unpack_codes(column(batch, "codes")[i].as_py())
    units = np.frombuffer(column(batch, "units")[i].as_py(), "<u2")[codes]
    counts = np.frombuffer(column(batch, "counts")[i].as_py(), "<i8")[codes]
    if train_only:
        taught = column(batch, "train")[i].values.to_numpy(zero_copy_only=False)
        keep = np.repeat(taught, sizes)
        units, counts, sizes = units[keep], counts[keep], sizes[taught]
    ends = np.cumsum(sizes)
    return np.insert(units, ends, 0), np.insert(counts, ends, end_count), ends + np.arange(len(sizes))


def _matrices(found: DataFrame, classes: np.ndarray, shape: Shape) -> np.ndarray:
    """For each unit the classes before it and after it; the last row: tokens seen once by the class before."""
    k, m = shape.classes, shape.units

    small = classes.astype(np.uint8)

    def run(batches):
        before, after = np.zeros(m * k, np.int64), np.zeros(m * k, np.int64)
        once = np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                units, counts, _ = _sequence(batch, i, 0, True)
                previous = np.r_[np.uint16(0), units[:-1]] if len(units) else units
                c, p = small[units], small[previous]
                before += np.bincount(units.astype(np.int32) * k + p, minlength=m * k)
                after += np.bincount(previous.astype(np.int32) * k + c, minlength=m * k)
                once += np.bincount(p[counts == 1], minlength=k)
        rows = np.concatenate([before.reshape(m, k), after.reshape(m, k)], 1)
        rows = np.concatenate([rows, np.r_[once, np.zeros(k, np.int64)][None, :]])
        some = np.flatnonzero(rows.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(rows[some]), pa.list_(pa.int64()))], ["unit", "n"])

    sums = found.select("sizes", "train", "codes", "units", "counts").mapInArrow(run, "unit int, n array<long>").groupBy("unit").agg(F.array(*[F.sum(F.col("n")[j]) for j in range(2 * k)]).alias("n"))
    out = np.zeros((m + 1, 2 * k))
    for r in sums.collect():  # units x classes at most, whatever the input
        out[r["unit"]] = r["n"]
    return out


def _log_likelihood(move: np.ndarray, size: np.ndarray) -> float:
    """Of classes given the words' counts: sum of n(p, c) log n(p, c) less twice n(c) log n(c)."""
    x = move[move > 0]
    s = size[size > 0]
    return float((x * np.log(x)).sum() - 2 * (s * np.log(s)).sum())


def cluster(found: DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Classes of units by exchange, with the matrices counted for the best of them."""
    k, m = shape.classes, shape.units
    classes = np.arange(m) % (k - 1) + 1
    classes[0] = 0  # the end has a class of its own
    best = None
    for turn in range(shape.iterations + 1):
        counted = _matrices(found, classes, shape)
        before, after = counted[:m, :k], counted[:m, k:]
        move = np.zeros((k, k))
        np.add.at(move.T, classes, before)
        size = move.sum(0)
        likelihood = _log_likelihood(move, size)
        if best is None or likelihood > best[0]:
            best = (likelihood, classes.copy(), counted)
        if turn == shape.iterations:
            break
        follow = np.log((move + 0.5) / (move.sum(1, keepdims=True) + 0.5 * k))
        gain = before @ follow + after @ follow.T - before.sum(1, keepdims=True) * np.log(size + 1)
        gain[:, 0] = -np.inf
        moving = (np.arange(m) % 2 == turn % 2) & (before.sum(1) > 0)
        moving[0] = False
        classes = np.where(moving, gain.argmax(1), classes)
    return best[1], best[2]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row."""
    shape = shape or Shape()
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("train", ~held_out)
    written = chunks.chunks(rows, split)
    each = chunks.words_of(written)
    counted = cut(each.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    sums = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts_taught = written.select(F.sum(F.size(F.filter("train", lambda t: t))).alias("n")).first()["n"] or 0
    total, distinct = (sums["n"] or 0) + texts_taught, sums["v"] + (texts_taught > 0)
    frequent = {bytes(r["word"]): r["c"] for r in counted.orderBy(F.desc("c"), "word").limit(shape.frequent).collect()}
    known = small(docs.sparkSession.createDataFrame([(bytearray(w),) for w in frequent], "word binary"), 1, sum(map(len, frequent)))
    counts = cut(each.join(known, "word", "left_anti").join(counted, "word").select("chunk", "place", "c"))
    found = cut(_numbered(chunks.returned(written, counts, "c"), frequent, shape))
    discard(written, counted, counts)
    classes, matrices = cluster(found, shape)

    k, m = shape.classes, shape.units
    move = np.zeros((k, k))
    np.add.at(move.T, classes, matrices[:m, :k])
    size, from_class, once = move.sum(0), move.sum(1), matrices[m, :k]
    unseen = (once.sum() + 1) / (total + 2) if total else 1.0
    unknown = (once + 20 * unseen) / (from_class + 20) if total else np.ones(k)
    share = size / max(1, size.sum())
    follow = (move + 50 * share) / (from_class + 50)[:, None]
    emit = follow * (1 - unknown)[:, None] / np.maximum(size, 1)[None, :]  # times the word's count
    id_type = docs.schema[id_col].dataType.simpleString()
    scale = total + 0.5 * (distinct + 1)
    mixing, class_of = shape.unigram, classes.astype(np.uint8)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                units, counts, ends = _sequence(batch, i, texts_taught, False)
                c, p = class_of[units], class_of[np.r_[np.uint16(0), units[:-1]] if len(units) else units]
                base = (counts + 0.5) / scale
                own = np.where(counts > 0, emit[p, c] * counts, unknown[p])
                starts = np.r_[0, ends[:-1] + 1]
                sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (np.log10(base), np.log10((1 - mixing) * own + mixing * base), (counts > 0).astype(np.int64))]
                kind = column(batch, "ids").type.value_type
                schema = pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
                taught = column(batch, "train")[i].values.to_numpy(zero_copy_only=False)
                lengths = column(batch, "sizes")[i].values.to_numpy().astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "ids")[i].values, pa.array(~taught), pa.array(lengths), pa.array(sums[2]), pa.array(np.full(len(lengths), total, np.int64)), pa.array(sums[0]), pa.array(sums[1])], schema=schema
                )

    return found.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
