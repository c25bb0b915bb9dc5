"""What the text operators share: reading, durable cuts of the lineage, words, chunks.

Every operator takes a DataFrame and the names of its id and text columns, selects
those alone (so further columns, whatever their names, never clash) and treats a
null text as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.durable import cut, discard, shared_dir  # noqa: F401

#: White space of every contract here: space and the control characters 9 to 13.
#: ``bytes.split()`` without arguments splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"

#: The last key, and how many keys up to it stand for null ids.
LAST, NULLS = 2**63 - 1, 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: What may be broadcast, in bytes of rows whose width is known.
SMALL_BYTES = 16 << 20


def small(df: DataFrame, rows: int, width: int = 24) -> DataFrame:
    """``df`` for a join: broadcast where its counted rows of ``width`` bytes are few, else left to the shuffle."""
    return F.broadcast(df) if rows * width <= SMALL_BYTES else df


def keyed(id_col: str, text_col: str) -> list[Column]:
    """``k`` and ``tag``: a row's id as a long, and a hash of its text, which tells rows of one id apart.

    Null ids come last, in the order of that hash, so that rows without ids don't all meet at one key.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return [F.coalesce(F.col(id_col).cast("long"), LAST - F.pmod(tag, F.lit(NULLS))).alias("k"), tag.alias("tag")]


def known(k: str) -> Column:
    """The id of a key, null where it stands for none."""
    return F.when(F.col(k) <= LAST - NULLS, F.col(k))


def losing(rows: DataFrame, group: list[str]) -> DataFrame:
    """``(k, tag, left)`` of identities that lose rows where one row of each group of ``rows (group, k, tag)`` stays.

    The one of the smallest id stays; of one id's texts that of the smallest hash; ``left``: how many of an identity's rows stay.
    """
    counted = rows.groupBy(*group, "k", "tag").agg(F.count(F.lit(1)).alias("m"))
    first = counted.groupBy(*group).agg(F.min(F.struct("k", "tag")).alias("own"))
    left = (F.struct("k", "tag") == F.col("own")).cast("int").alias("left")
    return counted.join(first, group).select("k", "tag", "m", left).where("left < m").select("k", "tag", "left")


def without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows that ``lost (k, tag, left)`` takes; same columns. Only what is lost is joined.

    Rows of one id and one text are told apart by nothing; where one of them stays, it is any of them.
    """
    lost = cut(lost.select(F.col("k").alias("__k"), F.col("tag").alias("__tag"), F.col("left").alias("__left")))
    rows, partly = lost.agg(F.count(F.lit(1)), F.count(F.when(F.col("__left") > 0, 1))).first()
    k, tag = keyed(id_col, text_col)
    marked = docs.select("*", k.alias("__key"), tag.alias("__text")).join(small(lost, rows), (F.col("__key") == F.col("__k")) & (F.col("__text") == F.col("__tag")), "left")
    kept = marked.where("__left is null").select(*docs.columns)
    return kept.unionByName(marked.where("__left > 0").dropDuplicates(["__key", "__text"]).select(*docs.columns)) if partly else kept


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` alone, null texts as empty ones."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's values as UTF-8 bytes, nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def task_number() -> int:
    """The number of the running task's partition."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and bytes from an iterator of tuples."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if len(held) >= size or weight >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over an array of unsigned longs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, kept for words seen before; the store is bounded."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.hash, self.most, self.seen = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.hash(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each ``k`` consecutive word hashes; order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3 | 1 << 60) + mix(h[i : i + n] + np.uint64(i + 1))
    return mix(out)
