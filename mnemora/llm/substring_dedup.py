"""Substring dedup by De Bruijn compaction of repeated word windows.

A window of 20 words is an edge between its first and last 19 words; a word is removed when
some window over it occurs earlier too (smaller id, or the same document and an earlier start).
Windows are never shuffled one by one:

1. *Compaction in the document.* Each window has an anchor, the 6-word k-mer of least hash in
   it. Consecutive windows with the anchor at one place make a segment, a path of up to 15 edges,
   known by (anchor hash, hash of all its words): 128 bits. Equal windows have equal anchors at equal
   places, so they lie in segments with one anchor hash.
2. *Graph.* One aggregate over anchors (partial sums first, so a passage that a third of all rows
   share gives a row for each map task) tells anchors that occur once, which are dropped, from those
   where every occurrence is the same segment (nonbranching paths) and from branching ones.
3. *Compaction by join.* Segments join their anchors. On a nonbranching path all occurrences but
   that of the smallest id go, as whole segments.
4. *Branching points.* Only there are windows compared, by (hash, hash) of 128 bits: an aggregate gives
   each window's smallest id, and a join tells the other occurrences.
5. *Source coordinates.* What a document loses is a list of (start, number of windows) in its own words;
   each is checked against the document's words again before it is applied.

Repeats inside one document are settled where the document is read. Lists are bounded by
their document's length. Texts travel compressed and once, those with branching points twice.

Defined cases: a null or empty text has no words; null ids come last, in the order of a hash of their texts, so that rows
without ids neither meet at one key nor count as one document; rows that share an id (or have none, and one text) count as the same
document, so none of them removes words of another, but each keeps its own text; documents of under 20 words lose nothing;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, column_bytes, cut, keyed, mix, texts, to_batches
from .words import RUN_BYTES, Words, slices

WINDOW = 20
ANCHOR = 6

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _C1 + mix(y * _C2))


class Segments:
    """The segments of a run of texts: arrays ``anchor``, ``path``, ``start``, ``count``, ``text`` and ``again``.

    ``start`` numbers the run's words; ``text``: the number of the segment's text; ``again``: the same
    segment occurs earlier in its text. ``window``: the hash of the window at every word.
    """

    def __init__(self, words: Words):
        h, first = words.hash, words.first
        n = len(h) - WINDOW + 1
        self.anchor = self.path = self.window = np.empty(0, np.uint64)
        self.start = self.count = self.text = np.empty(0, np.int64)
        self.again = np.empty(0, bool)
        if n <= 0:
            return
        at = {1: h}  # hashes of spans of words at every start, by doubling
        for k in (2, 4, 8, 16):
            half = at[k // 2]
            at[k] = _pair(half[: -(k // 2)], half[k // 2 :])
        six = _pair(at[4][: len(h) - 5], at[2][4:])
        self.window = _pair(at[16][: len(h) - 19], at[4][16:])
        bits = np.uint64((1 << int(len(h)).bit_length()) - 1)
        least = six & ~bits | np.arange(len(six), dtype=np.uint64)  # of equal hashes the leftmost
        for k in (1, 2, 4):
            least = np.minimum(least[:-k], least[k:])
        least = np.minimum(least[:n], least[WINDOW - ANCHOR + 1 - 8 :][:n]) & bits
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = text[:n] == text[WINDOW - 1 :]
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | ~whole[:-1]
        self.start = np.flatnonzero(new)
        if not len(self.start):
            return
        self.text = text[self.start]
        self.count = np.add.reduceat(whole.astype(np.int64), self.start)
        self.anchor = six[least[self.start].astype(np.int64)]
        self.path = _pair(self.window[self.start] + self.count.astype(np.uint64), self.window[self.start + self.count - 1])
        _, one = np.unique(mix(self.anchor + self.path * _C1) + self.text.astype(np.uint64) * _C2, return_index=True)
        self.again = np.ones(len(self.start), bool)
        self.again[one] = False


def _tag(text: bytes) -> int:
    """16 bits of a text, kept beside a start: rows that share an id keep their lists apart."""
    return zlib.crc32(text) & 0xFFFF


def _schema(before: str, rows: DataFrame, after: str) -> StructType:
    """Fields before and after the id, whose type is the input's (a struct where more columns come along)."""
    return StructType([*StructType.fromDDL(before or "x int").fields[: 99 * bool(before)], rows.schema["id"], *StructType.fromDDL(after).fields])


def segments(rows: DataFrame) -> DataFrame:
    """``(anchor, path, k, at, n)`` from ``(k, text)``; ``at`` = start * 65536 + tag."""

    def run(batches):
        for batch in batches:
            texts, k = column_bytes(batch, "text"), column(batch, "k").to_numpy()
            for part in slices([len(t) for t in texts], RUN_BYTES):
                words = Words(texts[part])
                found = Segments(words)
                new = ~found.again
                if new.any():
                    text = found.text[new]
                    tags = np.array([_tag(t) for t in texts[part]], np.int64)
                    at = (found.start[new] - words.first[text] << 16) + tags[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.anchor[new].view(np.int64)), pa.array(found.path[new].view(np.int64)), pa.array(k[part][text]), pa.array(at), pa.array(found.count[new].astype(np.int32))], ["anchor", "path", "k", "at", "n"]
                    )

    return rows.mapInArrow(run, "anchor long, path long, k long, at long, n int")


def _mark(delta: np.ndarray, start: np.ndarray, count: np.ndarray | int) -> None:
    """Marks the words of ``count`` windows from each start."""
    np.add.at(delta, start, 1)
    np.add.at(delta, start + count + WINDOW - 1, -1)


def _listed(batch: pa.RecordBatch, name: str, part: slice, tags: np.ndarray, words: Words, found: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The segments that a column lists for texts of a run and that are there: starts in the run, and counts."""
    lists = column(batch, name).slice(part.start, part.stop - part.start)
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    flat = lists.flatten()
    at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = (at >> 16) + words.first[text]
    own = (at & 0xFFFF) == tags[text]
    place = np.minimum(np.searchsorted(found.start, start), max(0, len(found.start) - 1))
    if len(found.start):
        own &= (found.start[place] == start) & (found.count[place] == n) & (found.text[place] == text)
    else:
        own[:] = False
    return start[own], n[own]


def _first_pass(joined: DataFrame) -> DataFrame:
    """Apply what segments tell; list the windows at branching points that are still open.

    From ``(k, id, z, paths, points)``, lists of ``at`` and ``n``. Gives ``(k, tag, id, z, n_words, n_removed, kept, marks,
    open)``: ``kept`` where nothing is open, else ``z``, the marks so far and the open windows.
    """
    item = pa.struct([("a", pa.int64()), ("w", pa.int64()), ("start", pa.int32())])

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = column(batch, "z").to_pylist()
            texts = [unpack.decompress(z) for z in packed]
            for part in slices([len(t) for t in texts], RUN_BYTES):
                own, words = texts[part], Words(texts[part])
                found, tags = Segments(words), np.array([_tag(t) for t in own], np.int64)
                delta = np.zeros(len(words.hash) + 1, np.int64)
                _mark(delta, found.start[found.again], found.count[found.again])
                _mark(delta, *_listed(batch, "paths", part, tags, words, found))
                start, count = _listed(batch, "points", part, tags, words, found)
                windows = np.unique(np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()))  # rows of one id and text list each twice
                segment = np.searchsorted(found.start, windows, "right") - 1
                text, anchor, w = found.text[segment], found.anchor[segment], found.window[windows]
                _, one = np.unique(mix(w + anchor * _C1) + text.astype(np.uint64) * _C2, return_index=True)
                later = np.ones(len(windows), bool)
                later[one] = False
                _mark(delta, windows[later], 1)
                gone = np.cumsum(delta[:-1]) > 0
                text, anchor, w, windows = text[~later], anchor[~later], w[~later], windows[~later]
                sizes = np.bincount(text, minlength=len(own))
                n_words, n_gone = np.diff(words.first), np.diff(np.r_[0, np.cumsum(gone)][words.first])
                kept = [None if sizes[i] else words.kept(i, gone, t).decode("utf-8", "replace") for i, t in enumerate(own)]
                marks = [np.packbits(gone[words.first[i] : words.first[i + 1]]).tobytes() if sizes[i] else None for i in range(len(own))]
                opened = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(w.view(np.int64)), pa.array((windows - words.first[text]).astype(np.int32))], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "k").slice(part.start, len(own)), pa.array(tags.astype(np.int32)), column(batch, "id").slice(part.start, len(own)),
                        pa.array([z if sizes[i] else None for i, z in enumerate(packed[part])], pa.binary()), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)),
                        pa.array(kept, pa.string()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), opened),
                    ],
                    ["k", "tag", "id", "z", "n_words", "n_removed", "kept", "marks", "open"],
                )

    return joined.mapInArrow(run, _schema("k long, tag int", joined, "z binary, n_words long, n_removed long, kept string, marks binary, open array<struct<a:long,w:long,start:int>>"))


def _second_pass(joined: DataFrame) -> DataFrame:
    """Apply the windows found elsewhere too, from ``(id, z, marks, starts)``."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

            def out():
                for key, z, bits, starts in zip(ids.to_pylist(), column(batch, "z").to_pylist(), column(batch, "marks").to_pylist(), column(batch, "starts")):
                    text = unpack.decompress(z)
                    words = Words([text])
                    gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words.hash)).astype(bool)
                    if starts.is_valid:
                        delta = np.zeros(len(gone) + 1, np.int64)
                        _mark(delta, starts.values.to_numpy().astype(np.int64), 1)
                        gone |= np.cumsum(delta[:-1]) > 0
                    yield key, len(gone), int(gone.sum()), words.kept(0, gone, text).decode("utf-8", "replace")

            yield from to_batches(out(), schema, size=1024)

    return joined.mapInArrow(run, _schema("", joined, "n_words long, n_removed long, kept string"))


def compressed(rows: DataFrame) -> DataFrame:
    """``(k, tag, id, z)``: texts as zstd frames, a third of their size in a shuffle."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = column_bytes(batch, "text")
            z, tags = [pack.compress(t) for t in texts], [_tag(t) for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array(tags, pa.int32()), column(batch, "id"), pa.array(z, pa.binary())], ["k", "tag", "id", "z"])

    return rows.mapInArrow(run, _schema("k long, tag int", rows, "z binary"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept string)`` for every row; ids are whole numbers."""
    return _resolved(texts(docs, id_col, text_col).select(keyed("id", "text")[0], "id", "text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text in place; its other columns come along. ``n_chars``, where there is one, follows the text."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    rows = docs.select(keyed(id_col, text_col)[0], rest.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    now = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return _resolved(rows).select(*[now.get(c, F.col("id")[c]).alias(c) for c in docs.columns])


def _resolved(rows: DataFrame) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` from ``(k, id, text)``, where only ``k`` orders."""
    found = segments(rows.select("k", "text"))
    anchors = (
        found.groupBy("anchor")
        .agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.min("k").alias("first"), F.max("k").alias("last"))
        .where("lo <> hi or first <> last")
        .select("anchor", (F.col("lo") != F.col("hi")).alias("branching"), "first")
    )
    hits = found.select("anchor", "k", "at", "n").join(anchors, "anchor").where(F.col("branching") | (F.col("k") > F.col("first")))
    pair = F.struct("at", "n")
    lists = hits.groupBy("k", F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("tag")).agg(F.collect_list(F.when(~F.col("branching"), pair)).alias("paths"), F.collect_list(F.when(F.col("branching"), pair)).alias("points"))
    read = cut(_first_pass(compressed(rows).join(lists, ["k", "tag"], "left").select("k", "id", "z", "paths", "points")))
    windows = read.select("k", "tag", F.explode("open").alias("o")).select("o.a", "o.w", "k", "tag", "o.start")
    firsts = windows.groupBy("a", "w").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").select("a", "w", "first")
    later = windows.join(firsts, ["a", "w"]).where("k > first").groupBy("k", "tag").agg(F.collect_list("start").alias("starts"))
    left = read.where(F.col("kept").isNull()).select("k", "tag", "id", "z", "marks")
    settled = _second_pass(left.join(later, ["k", "tag"], "left").select("id", "z", "marks", "starts"))
    return read.where(F.col("kept").isNotNull()).select("id", "n_words", "n_removed", "kept").unionByName(settled)
