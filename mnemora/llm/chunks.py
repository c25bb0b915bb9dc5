"""Chunk dictionaries: texts as numbers of words, so that words meet once for each chunk.

A chunk is a run of documents of one task with ``most_tokens`` tokens or so. It has the
list of its distinct words and the documents as numbers into that list, compressed. What
a global statistic of words needs is shuffled as (chunk, place, word), some twentieth of the
tokens; what it gives returns as a list for each chunk. A frequent word has as many rows
as there are chunks. Chunks are written once, since their numbers must not change.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, column_bytes, cut, task_number

TOKENS = 1_000_000


def pack_codes(codes: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_codes(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def chunks(rows: DataFrame, split: Callable[[bytes], list[bytes]], most_tokens: int = TOKENS) -> DataFrame:
    """From ``(id, text, train)``: ``(chunk, ids, sizes, train, codes, words, counts)``.

    ``counts``: how often the chunk's training documents have a word.
    """

    def run(batches):
        number = task_number() << 24
        local: dict[bytes, int] = {}
        ids: list = []
        train: list[bool] = []
        parts: list[np.ndarray] = []
        total = 0
        kind = pa.int64()

        def row():
            sizes = [len(p) for p in parts]
            codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            taught = np.repeat(np.array(train, bool), sizes)
            counts = np.bincount(codes[taught], minlength=len(local))
            fields = [("chunk", pa.int64(), number), ("ids", pa.list_(kind), ids), ("sizes", pa.list_(pa.int32()), sizes), ("train", pa.list_(pa.bool_()), train), ("codes", pa.binary(), pack_codes(codes)), ("words", pa.list_(pa.binary()), list(local)), ("counts", pa.list_(pa.int64()), counts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for _, t, v in fields], [n for n, _, _ in fields])

        for batch in batches:
            kind = column(batch, "id").type
            for key, text, taught in zip(column(batch, "id").to_pylist(), column_bytes(batch, "text"), column(batch, "train").to_pylist()):
                words = split(text)
                for w in words:
                    if w not in local:
                        local[w] = len(local)
                parts.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                ids.append(key)
                train.append(bool(taught))
                total += len(words)
                if total >= most_tokens:
                    yield row()
                    number += 1
                    local, ids, train, parts, total = {}, [], [], [], 0
        if ids:
            yield row()

    id_type = rows.schema["id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"chunk long, ids array<{id_type}>, sizes array<int>, train array<boolean>, codes binary, words array<binary>, counts array<long>"))


def words_of(found: DataFrame) -> DataFrame:
    """``(chunk, place, word, n)``, a row for each distinct word of each chunk."""
    return found.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def returned(found: DataFrame, values: DataFrame, *payload: Column | str) -> DataFrame:
    """Chunks with ``got``: the list of ``(place, payload)`` that ``values`` has for each."""
    lists = values.groupBy("chunk").agg(F.collect_list(F.struct("place", *payload)).alias("got"))
    return found.join(lists, "chunk", "left")
