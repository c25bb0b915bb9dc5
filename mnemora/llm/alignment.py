"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which of their tokens meet.

A is byte-level BPE, B a piece model with byte fallback; both encode a space and the text. A bounded run of an Arrow
batch's documents is one array of bytes with document offsets:

1. The ends of all A and all B tokens are counted by byte, once for each side. Bytes where both end cut groups;
   bytes where either ends cut the elementary spans, and each span is one link: the A token and the B token over it.
   Prefix sums over the spans give the links' tokens, and taken at document edges each document's numbers.
2. Chunks: a task's documents, up to ``most_links`` links or so, have a list of their distinct id pairs with the number
   of the chunk's documents that hold each; a document is the places of its pairs in that list with how often each occurs.
   This is written once.
3. Counts of pairs over the corpus: (chunk, place, pair) rows are summed by pair, and the highest count of each A id follows.
   A pair has one row at most for each chunk, so the most frequent one weighs no more than there are chunks.
4. Counts return to the chunks' places by a join, and documents add up theirs.

The highest counts are a row for each A id, so that join is broadcast: it is bounded by the vocabulary.

Defined cases: null and empty texts, and texts that either tokenizer's bytes don't give back (B normalises, or a text
holds U+2581), have no tokens: zeros and an empty digest; special tokens' strings in a text are text; null and repeated
ids give a row each; a very long text is a run and a chunk of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack_codes, returned, unpack_codes
from .common import column, cut, small, task_number, texts
from .words import slices

LINKS = 1_000_000
MOST_SEEN = 250_000

#: Where a space follows what is no white space; and a piece of B that holds such a place.
_PIECE, _CROSSING = re.compile(r"(?<=\S)(?= )"), re.compile("[^▁]▁")


class Sides:
    """Both tokenizers with their tokens' bytes, and the digest's text for each id and what follows it."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry)
        n = self.b.vocab_size()
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))]
        if any(_CROSSING.search(p) for p in (self.b.id_to_piece(i) for i in range(n))):
            raise ValueError("a piece of B crosses the beginning of a word")
        self.space = self.b.piece_to_id("▁")
        self.seen: dict[str, tuple[bytes, bytes] | None] = {}
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.printed = [b"%d%s" % (i, s) for i in range(len(self.a_bytes)) for s in (b",", b"|")] + [b"%d%s" % (i, s) for i in range(n) for s in (b",", b";")]

    def _learn(self, pieces: list[str]) -> None:
        """Keep both sides' ids of pieces, which all begin with a space; none where a piece's bytes aren't given back.

        Pieces that end in no white space are encoded as one text, which both sides cut where a piece begins.
        """
        joined = [p for p in pieces if not p[-1].isspace()]
        if joined:
            text = "".join(joined)
            want, ends = text.encode(), np.cumsum([len(p.encode()) for p in joined])
            sides = (self.a.encode(text, add_special_tokens=False).ids, self.a_bytes, self.a_sizes), (self.b.encode(text[1:]), self.b_bytes, self.b_sizes)
            if all(b"".join(map(of.__getitem__, ids)) == want for ids, of, _ in sides):
                cuts = []
                for ids, _, sizes in sides:
                    ids = np.array(ids, np.int32)
                    at = np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")
                    packed, edges = ids.tobytes(), (4 * np.r_[0, at]).tolist()
                    cuts.append([packed[x:y] for x, y in zip(edges, edges[1:])])
                self.seen.update(zip(joined, zip(*cuts)))
                pieces = [p for p in pieces if p[-1].isspace()]
        for piece in pieces:
            ids, other = self.a.encode(piece, add_special_tokens=False).ids, self.b.encode(piece[1:]) if len(piece) > 1 else [self.space]
            want = piece.encode()
            whole = b"".join(map(self.a_bytes.__getitem__, ids)) == want == b"".join(map(self.b_bytes.__getitem__, other))
            self.seen[piece] = (np.array(ids, np.int32).tobytes(), np.array(other, np.int32).tobytes()) if whole else None

    def encode(self, run: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides as 32-bit numbers, empty where a text's bytes aren't given back.

        Neither side has a token over a space that follows what is no white space, so a space and a text are cut there and the
        pieces' ids are kept for pieces seen before; the store is bounded.
        """
        cut_up = [_PIECE.split(f" {t}") if t else [] for t in run]
        if len(self.seen) > MOST_SEEN:
            self.seen.clear()
        if fresh := list({p for pieces in cut_up for p in pieces if p not in self.seen}):
            self._learn(fresh)
        a, b = [], []
        for pieces in cut_up:
            found = [self.seen[p] for p in pieces]
            whole = None not in found
            a.append(b"".join([x[0] for x in found]) if whole else b"")
            b.append(b"".join([x[1] for x in found]) if whole else b"")
        return a, b


@lru_cache(maxsize=1)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


class Aligned:
    """The alignment of a run of documents: per document ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``pairs`` of all links in order."""

    def __init__(self, both: Sides, a: list[bytes], b: list[bytes]):
        self.both = both
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (a, b))
        flat = [np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in (a, b)]
        ends = [np.cumsum(sizes[ids]) - 1 for sizes, ids in ((both.a_sizes, flat[0]), (both.b_sizes, flat[1]))]
        total = int(ends[0][-1]) + 1 if len(ends[0]) else 0
        hits = np.bincount(ends[0], minlength=total).astype(np.int8) + 2 * np.bincount(ends[1], minlength=total).astype(np.int8)
        spans = np.flatnonzero(hits)
        kind = hits[spans]
        in_a, in_b, cuts = kind & 1, kind >> 1, kind == 3
        self.a_links, self.b_links = flat[0][np.cumsum(in_a, dtype=np.int64) - in_a], flat[1][np.cumsum(in_b, dtype=np.int64) - in_b]
        # a document's last byte is an end of both sides; documents without tokens have no bytes
        last = np.r_[0, np.cumsum(self.n_a)]
        edge = np.r_[-1, ends[0]][last]  # the last byte of what is before each edge
        at = np.searchsorted(spans, edge, side="right")
        groups = np.r_[0, np.cumsum(cuts, dtype=np.int64)]
        self.n_links, self.n_groups = np.diff(at), np.diff(groups[at])
        # order of the digest: a group's A ids, then its B ids
        a_cut, b_cut = (hits[e] == 3 for e in ends)
        a_group, b_group = (np.cumsum(c, dtype=np.int64) - c for c in (a_cut, b_cut))
        a_until, b_until = (np.flatnonzero(c) + 1 for c in (a_cut, b_cut))
        self.codes = np.empty(len(flat[0]) + len(flat[1]), np.int64)
        self.codes[np.arange(len(flat[0])) + np.r_[0, b_until][a_group]] = flat[0] * 2 + a_cut
        self.codes[np.arange(len(flat[1])) + a_until[b_group] if len(a_until) else np.arange(0)] = 2 * len(both.a_bytes) + flat[1] * 2 + b_cut
        self.edges = np.r_[0, np.cumsum(self.n_a + self.n_b)]

    @property
    def pairs(self) -> np.ndarray:
        return self.a_links * len(self.both.b_bytes) + self.b_links

    def digest(self, i: int) -> str:
        """Lower-case hex of the groups of document ``i``; empty without tokens."""
        codes = self.codes[self.edges[i] : self.edges[i + 1]]
        return hashlib.sha256(b"".join(map(self.both.printed.__getitem__, codes.tolist()))[:-1]).hexdigest() if len(codes) else ""


def aligned_chunks(rows: DataFrame, a_path: str, b_path: str, most_links: int = LINKS) -> DataFrame:
    """From ``(id, text)``: a row for each chunk with its documents' own numbers, places and pairs."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        both = sides(a_path, b_path)
        number = task_number() << 24
        kind, held, links = pa.int64(), [], 0

        def row():
            ids, n_a, n_b, n_groups, shas, links_of = (sum((h[k] for h in held), []) for k in range(6))
            codes = np.concatenate([h[6] for h in held])
            place, pairs = pd.factorize(codes)
            own = np.repeat(np.arange(len(ids), dtype=np.int64), links_of) * max(1, len(pairs)) + place
            number_of, distinct = pd.factorize(own)  # in order of first occurrence, so documents stay in theirs
            times = np.bincount(number_of, minlength=len(distinct))
            sizes = np.bincount(distinct // max(1, len(pairs)), minlength=len(ids))
            places = distinct % max(1, len(pairs))
            docs = np.bincount(places, minlength=len(pairs))
            fields = [
                ("chunk", pa.int64(), number), ("ids", pa.list_(kind), ids), ("n_a", pa.list_(pa.int64()), n_a), ("n_b", pa.list_(pa.int64()), n_b),
                ("n_groups", pa.list_(pa.int64()), n_groups), ("n_links", pa.list_(pa.int64()), links_of), ("digests", pa.list_(pa.string()), shas), ("sizes", pa.list_(pa.int64()), sizes),
                ("places", pa.binary(), pack_codes(places)), ("times", pa.binary(), pack_codes(times)),
                ("pairs", pa.list_(pa.int64()), pairs), ("docs", pa.list_(pa.int64()), docs),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for _, t, v in fields], [n for n, _, _ in fields])

        for batch in batches:
            kind = column(batch, "id").type
            values, ids = column(batch, "text").to_pylist(), column(batch, "id").to_pylist()
            for part in slices([4 * len(t) for t in values]):
                found = Aligned(both, *both.encode(values[part]))
                held.append((ids[part], found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), [found.digest(i) for i in range(len(found.n_a))], found.n_links.tolist(), found.pairs))
                links += len(found.pairs)
                if links >= most_links:
                    yield row()
                    number, held, links = number + 1, [], 0
        if held:
            yield row()

    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return cut(rows.mapInArrow(run, f"chunk long, ids array<{id_type}>, {longs}, digests array<string>, sizes array<long>, places binary, times binary, pairs array<long>, docs array<long>"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_links: int = LINKS) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row."""
    rows = texts(docs, id_col, text_col)
    both = sides(a_path, b_path)
    n_a, n_b = len(both.a_bytes), len(both.b_bytes)
    written = aligned_chunks(rows, a_path, b_path, most_links)
    seen = written.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    totals = cut(seen.groupBy("pair").agg(F.sum("n").alias("c")).withColumn("a", F.expr(f"pair div {n_b}").cast("int")))
    most = totals.groupBy("a").agg(F.max("c").alias("most"))
    flagged = totals.join(small(most, n_a, 16), "a").select("pair", (F.col("c") * 2 + (F.col("c") == F.col("most")).cast("long")).alias("v"))
    got = returned(written.select("chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "places", "times"), seen.select("chunk", "place", "pair").join(flagged, "pair"), "v")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: column(batch, c)[i].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
                sizes = column(batch, "sizes")[i].values.to_numpy()
                places, times = unpack_codes(column(batch, "places")[i].as_py()).astype(np.int64), unpack_codes(column(batch, "times")[i].as_py()).astype(np.int64)
                value = np.zeros(len(places) + 1, np.int64)
                listed = column(batch, "got")[i]
                if listed.is_valid and len(listed.values):
                    value = np.zeros(int(pa.compute.max(listed.values.field("place")).as_py()) + 1, np.int64)
                    value[listed.values.field("place").to_numpy()] = listed.values.field("v").to_numpy()
                edges = np.r_[0, np.cumsum(sizes)]
                sums = [np.diff(np.r_[0, np.cumsum(times * x)][edges]) for x in (value[places] & 1, value[places] >> 1)]
                yield pa.RecordBatch.from_arrays(
                    [own["ids"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], pa.array(sums[0]), pa.array(sums[1]), own["digests"]],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return got.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
