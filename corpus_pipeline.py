"""From raw documents to packed training windows: five stages, each one of the operators.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but
the last return the columns of ``documents``.

Defined cases: a null text counts as an empty one, is scored like it and is a copy of other empty texts; rows without an id are
rows of their own until an equal text with an id takes their place; of repeated rows one stays; texts without words have no near copies; a
very long text is read whole and cut over several windows; labels of rows that aren't there, or that are neither 0 nor 1, teach nothing; without
labels of both classes all rows score the share of good labels; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from mnemora.llm.common import cut, table


#: Bytes of rows that a Python worker gets at once (by rows alone, 35 MB of ``documents``) and words whose ids a packing task
#: keeps: executors live through all stages, and what their JVM holds by then leaves little for the workers.
BATCH_BYTES, KEPT_WORDS = 4 << 20, 200_000


def bounded(spark: SparkSession) -> None:
    """From now on batches for Python workers are bounded in this session; a stage is planned when it is written, so this stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, doesn't reject."""
    bounded(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those equal but for white space."""
    bounded(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded(spark)
    return near_dedup.drop_near_copies(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that occur earlier."""
    bounded(spark)
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    import public_tokenizers

    bounded(spark)
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), most_words=KEPT_WORDS))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

#: Scores and packing can't be stated in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; between them the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
