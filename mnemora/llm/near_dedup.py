"""MinHash near-dedup by fast similarity sketching.

Sketch of a set of shingles with ``t`` coordinates (Dahlgaard, Knudsen and Thorup): in rounds
0 to t-1 every element is hashed to a bin and a value; in rounds t to 2t-1 all elements go to one bin
each in turn. A bin keeps the least (round, value), so every coordinate is filled, and the bins
are negatively associated, which gives the concentration of independent MinHash at the cost of
few rounds for sets larger than t ln t.

1. A map over whole texts gives each row its set's size, a 128-bit hash of the whole set, its bands and its text
   compressed; this is written once with a number for each row, and rows, not ids, are what is linked.
2. Rows with equal sets form a class and are linked; only one of them goes on, so thousands
   of copies cost a row each.
3. Bands of class representatives: an aggregate finds buckets of two or more.
4. Every member is tested against a pivot of its bucket, never all with all: texts join the distinct pairs
   compressed, and the full sets decide: 100 * |A & B| >= 80 * |A | B|.
5. Components of the links; buckets whose members still lie in several components go on until
   each of their pairs is settled, by a test or by being connected (see ``linking``).

With 40 bands of 6 a pair of similarity 0.8 misses all bands with probability 5e-6. The last round's pairs must
also look alike by a sketch of 2048 bits, within 5 deviations of 0.8: probability 3e-7 to miss.

Defined cases: null texts and texts without words have empty sets and link with nothing; texts under
four words (``shingle`` words) are one shingle; null ids come last in the order and a component of them alone has a null id;
rows that share an id are rows of their own: each is linked by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column, column_bytes, cut, discard, keyed, known, losing, mix, small, windows_hash, without
from .linking import settle

SHINGLE, BANDS, ROWS = 5, 40, 6
#: Coordinates of the estimate that the last round of pairs must pass, a bit of each.
FINE = 2048
LOW48 = np.uint64((1 << 48) - 1)
FULL = np.uint64(2**64 - 1)


@lru_cache(maxsize=8)
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a non-empty set of 64-bit elements."""
    out, n = np.full(t, FULL), len(elements)
    seeds = _seeds(2 * t)
    first, size = 0, min(t, max(1, math.ceil(t * (math.log(t) + 1.5) / n)))
    while first < t and (out == FULL).any():
        rounds = np.arange(first, min(t, first + size))
        h = mix(elements[None, :] ^ seeds[rounds][:, None])
        bins = ((h >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)
        values = (rounds.astype(np.uint64) << np.uint64(48))[:, None] | (mix(h) & LOW48)
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        first += len(rounds)
        size = 1
    empty = np.flatnonzero(out == FULL)
    if len(empty):
        h = mix(mix(elements[None, :] ^ seeds[t + empty][:, None])) & LOW48
        out[empty] = ((t + empty).astype(np.uint64) << np.uint64(48)) | h.min(1)
    return out


def shingles(words: list[bytes], hashes: WordHashes, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    if len(h) < shingle:
        return windows_hash(h + np.uint64(len(h)), len(h))
    return np.unique(windows_hash(h, shingle))


def sketches(rows: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``(k, tag, n, hi, lo, bands array<long>, z)`` from ``(k, tag, text)``; no bands and no text ``z`` for empty sets."""

    def run(batches):
        import xxhash
        import zstandard

        hashes, number, pack = WordHashes(), np.arange(1, bands + 1, dtype=np.uint64), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in column_bytes(batch, "text"):
                found = shingles(text.lower().split(), hashes, shingle)
                both = xxhash.xxh3_128_digest(found.tobytes())
                out[0].append(len(found))
                out[1].append(int.from_bytes(both[:8], "little", signed=True))
                out[2].append(int.from_bytes(both[8:], "little", signed=True))
                if len(found):
                    parts = sketch(found, bands * band_rows).reshape(bands, band_rows)
                    key = number * np.uint64(0x9E3779B97F4A7C15)
                    for i in range(band_rows):
                        key = mix(key * np.uint64(0x100000001B3) + parts[:, i])
                    out[3].append(key.view(np.int64))
                else:
                    out[3].append(np.empty(0, np.int64))
                out[4].append(pack.compress(text) if len(found) else None)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "k"), column(batch, "tag"), pa.array(out[0], long), pa.array(out[1], long), pa.array(out[2], long), pa.array(out[3], pa.list_(long)), pa.array(out[4], pa.binary())], ["k", "tag", "n", "hi", "lo", "bands", "z"]
            )

    return rows.mapInArrow(run, "k long, tag long, n long, hi long, lo long, bands array<long>, z binary")


def verify(pairs: DataFrame, stored: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """Of ``(a, b)`` those whose full sets have ``percent`` or more of their union in common."""
    a, b = stored.select(F.col("k").alias("a"), F.col("z").alias("za")), stored.select(F.col("k").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "za", "zb")

    def run(batches):
        import zstandard

        unpack, hashes = zstandard.ZstdDecompressor(), WordHashes()
        held: dict[bytes, np.ndarray] = {}

        def of(z: bytes) -> np.ndarray:
            if z not in held:
                if len(held) > 256:
                    held.clear()
                held[z] = shingles(unpack.decompress(z).lower().split(), hashes, shingle)
            return held[z]

        for batch in batches:
            linked = []
            for za, zb in zip(column(batch, "za").to_pylist(), column(batch, "zb").to_pylist()):
                x, y = of(za), of(zb)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(y, x)
                    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(linked))

    return both.mapInArrow(run, "a long, b long")


def finer(stored: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(k, marks)`` from ``(k, z)``: sketches of ``FINE`` coordinates, the last bit of each, as longs."""

    def run(batches):
        import zstandard

        unpack, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            marks = [np.packbits(mix(sketch(shingles(unpack.decompress(z).lower().split(), hashes, shingle), FINE)).astype(np.uint8) & 1).view(np.int64) for z in column(batch, "z").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array(marks, pa.list_(pa.int64()))], ["k", "marks"])

    return stored.select("k", "z").mapInArrow(run, "k long, marks array<long>")


def clearly_alike(a: Column, b: Column, percent: int) -> Column:
    """Whether equal bits are within 5 deviations of what ``percent`` gives, or more."""
    share = (1 + percent / 100) / 2
    least = math.floor(FINE * share - 5 * math.sqrt(FINE * share * (1 - share)))
    return FINE - sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(FINE // 64)), F.lit(0)) >= least


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """``(k, tag, n, component, c)``: for every row its set's size, its component and the smallest ``k`` of that; null for empty sets."""
    rows = docs.select(*keyed(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = cut(sketches(rows, shingle, bands, band_rows).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(sets.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("rep"), F.min("k").alias("first")))
    chosen = sets.select(F.col("row").alias("k"), "n", "bands").join(classes.select(F.col("rep").alias("k")), "k", "left_semi")
    banded = cut(chosen.select(F.explode("bands").alias("band"), "k", F.col("n").alias("mark")))
    members = cut(banded.join(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band"), "band", "left_semi"))
    discard(banded)
    stored = cut(sets.select(F.col("row").alias("k"), "z").join(members.select("k").distinct(), "k", "left_semi"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    labels = settle(members, lambda pairs: verify(pairs, stored, percent, shingle), fits, lambda vertices: finer(stored.join(vertices, "k"), shingle), lambda x, y: clearly_alike(x, y, percent))
    named = classes.join(labels.withColumnRenamed("k", "rep"), "rep", "left").select("hi", "lo", "first", F.coalesce("component", "rep").alias("component"))
    least = cut(named.groupBy("component").agg(F.min("first").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("component", "c"))
    # written first, so that the join back to all rows is of two plain inputs, which AQE can split at a class of many copies
    of_class = cut(named.join(small(least, least.count()), "component", "left").select("hi", "lo", "component", F.coalesce("c", "first").alias("c")))
    return sets.select("k", "tag", "n", "hi", "lo").join(of_class, ["hi", "lo"], "left").select("k", "tag", "n", "component", "c")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row; ids are whole numbers."""
    placed = _linked(docs, id_col, text_col, percent, shingle, bands, band_rows).withColumn("c", F.coalesce("c", "k"))
    return placed.select(known("k").alias("id"), F.col("n").alias("n_shingles"), known("c").alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; same columns. Texts without words all stay."""
    placed = _linked(docs, id_col, text_col, percent, shingle, bands, band_rows)
    return without(docs, losing(placed.where("n > 0"), ["component"]), id_col, text_col)
