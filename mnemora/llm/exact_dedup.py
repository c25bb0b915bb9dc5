"""Exact dedup, DataFrame functions only: one row stays of texts that are equal but for white space.

Rows are grouped by the 128-bit MD5 of the normalised text *and the text itself*, so the
grouping compares bytes and texts with colliding hashes stay apart. The partial aggregate
leaves one row of a text for each map task, so a text that a third of all rows share
costs no task more than its number of map tasks. What joins back to the documents is
a row for each text with its hashes; AQE can split that join where it is skewed.

Defined cases: a null text counts as empty and empty texts are equal; a null id is never
kept while its text has another id (a group of null ids alone keeps null); repeated ids
with equal texts count as that many rows and are kept alike; an empty table gives no rows;
further columns are ignored. ``drop_copies`` returns the input's own columns and one row of each text: of rows
that share id and text one stays, and of one id with two texts each text is judged on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, losing, texts, without


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces, by far the most common run, are no match and cost nothing."""
    return F.regexp_replace(text, r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*", " ")


def _h128(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    norm = texts(docs, id_col, text_col).select("id", normalised(F.col("text")).alias("text"))
    groups = (
        norm.select("id", "text", _h128("text").alias("h128"))
        .groupBy("h128", "text")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = norm.select("id", _h128("text").alias("h128"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(groups, ["h128", "text_sha256"]).select(
        "id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that of the smallest id (of one id's, of the smallest hash of the text as it is); same columns."""
    norm = docs.select(*keyed(id_col, text_col), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    own = ["h128", "sha"]
    several = (
        norm.select("text", _h128("text").alias("h128"))
        .groupBy("h128", "text")
        .agg(F.count(F.lit(1)).alias("m"))
        .where("m > 1")
        .select("h128", F.sha2("text", 256).alias("sha"))
    )
    copies = norm.select("k", "tag", _h128("text").alias("h128"), F.sha2("text", 256).alias("sha")).join(several, own)
    return without(docs, losing(copies, own), id_col, text_col)
