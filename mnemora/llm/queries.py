"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, class_lm, divergence, exact_dedup, html_extract, line_dedup, media, near_dedup, packing, quality, substring_dedup, toxicity
from .common import SPACE, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens; a row for each piece."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and unigram log probabilities of every document."""
    return class_lm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages of 20 words that occur earlier."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace("kept", SPACE, " "))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the component of its near copies."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one that stays of its equals."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples, sniffed and read back."""
    return media.digest(media.read_media(media.store_texts(table(spark, sf_dir, "documents"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat earlier ones, nearly or exactly."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source what sets it apart from its language's others, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers aligned by their bytes."""
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_html_extraction, op3_quality_classifier, op4_class_lm, op5_substring_dedup, op6_near_dedup, op7_exact_dedup, op8_byte_bpe, op9_media_columns, op10_line_dedup, op11_source_divergence, op12_tokenizer_alignment, op13_toxicity, pipeline)}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op11_source_divergence": divergence.SQL,
}
