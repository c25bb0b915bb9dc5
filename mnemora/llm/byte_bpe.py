"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins byte pieces.

A text is split by the pattern; each distinct word is folded once and kept: starting from its single bytes,
the neighbouring pair of least rank, the leftmost of equals, is merged until no pair has a rank. A text's ids are its
words' ids in turn, and the ids' pieces joined are its bytes again.

``encode_words`` is the fold with Spark's higher-order functions and the ranks as a literal array of small maps by
hash, for a table of distinct words. To encode whole corpora by it, words must meet across tasks and their ids
come back to the texts, which takes more disk and CPU time than the limits allow (figures in the README); so
``encode`` folds in the tasks that read the texts, with the same rule, and shuffles nothing.

Defined cases: a null or empty text has no ids; every byte has an id, so any text can be encoded; words of any length
take n log n steps; null and repeated ids give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, texts, to_batches

LONG = 200
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_literal(spark: SparkSession, ranks: dict[bytes, int], buckets: int = 8192) -> Column:
    """The ranks as a literal array of maps; a string's map is at its hash modulo ``buckets``."""
    known = spark.createDataFrame([(k.decode("latin-1"), v) for k, v in ranks.items()], "piece string, rank int")
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for r in known.select("piece", "rank", F.pmod(F.hash("piece"), F.lit(buckets)).alias("b")).collect():  # a vocabulary's size
        maps[r["b"]][r["piece"]] = r["rank"]
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def encode_word(word: Column, ranks: Column, buckets: int = 8192) -> Column:
    """Ids of a word given as a string of byte characters."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.element_at(ranks, F.pmod(F.hash(piece), F.lit(buckets)) + 1), piece)

    def merge(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.coalesce(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.lit(NONE)))

        def at(found: Column) -> Column:
            least = F.array_min(found)
            joined = _let(
                F.array_position(found, least).cast("int"),
                lambda p: F.concat(F.slice(parts, F.lit(1), p - 1), F.array(F.concat(F.element_at(parts, p), F.element_at(parts, p + 1))), F.slice(parts, p + 2, F.size(parts))),
            )
            return F.struct(F.when(least == NONE, parts).otherwise(joined).alias("parts"), (least == NONE).alias("done"))

        return _let(pairs, at)

    bytes_of = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.length(word)),
        F.struct(bytes_of.alias("parts"), F.lit(False).alias("done")),
        lambda state, _: F.when(state["done"] | (F.size(state["parts"]) < 2), state).otherwise(merge(state["parts"])),
        lambda state: F.transform(state["parts"], rank),
    )
    return _let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and links to neighbours."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (rank, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """``(word, ids array<int>)`` of distinct words, binary or strings, by higher-order functions alone."""
    table = rank_literal(words.sparkSession, ranks)
    word = F.col(word_col).cast("binary")
    return words.select(F.col(word_col).alias("word"), F.when(F.length(word) > 0, encode_word(F.decode(word, "ISO-8859-1"), table)).otherwise(F.array().cast("array<int>")).alias("ids"))


class WordIds(dict):
    """Ids of words as decimal text, and in ``pieces`` what they decode to; for words seen before, in bounded number."""

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000):
        super().__init__()
        self.ranks, self.of_rank, self.most = ranks, {v: k for k, v in ranks.items()}, most
        self.pieces: dict[str, bytes] = {}

    def fold(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > LONG:
            return merge_long(word, ranks)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < NONE:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
        return [ranks[p] for p in parts]

    def __missing__(self, word: str) -> str:
        ids = self.fold(word.encode())
        self.pieces[word] = b"".join([self.of_rank[i] for i in ids])
        self[word] = text = ",".join(map(str, ids))
        return text

    def of(self, words: list[str]) -> tuple[str, bytes]:
        """A text's ids as decimals joined by commas, and the bytes they decode to."""
        if len(self) > self.most:
            self.clear()
            self.pieces.clear()
        ids = ",".join(map(self.__getitem__, words))
        return ids, b"".join(map(self.pieces.__getitem__, words))


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, fields: list[tuple[str, pa.DataType, str]], made) -> DataFrame:
    rows = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary's size

    def run(batches):
        import regex

        split, words = regex.compile(pattern).findall, WordIds(shared.value)
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), *[(n, t) for n, t, _ in fields]])
            yield from to_batches(((key, *made(*words.of(split(text)))) for key, text in zip(ids.to_pylist(), column(batch, "text").to_pylist())), schema)

    return rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{n} {t}" for n, _, t in fields]]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded binary)`` for every row."""
    return _coded(docs, ranks, pattern, id_col, text_col, [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.binary(), "binary")], lambda ids, decoded: ([int(x) for x in ids.split(",")] if ids else [], decoded))


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the same outputs, taken where they are made."""

    def made(ids: str, decoded: bytes) -> tuple:
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _coded(docs, ranks, pattern, id_col, text_col, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], made)
