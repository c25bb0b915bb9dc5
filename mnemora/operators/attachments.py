"""Attachments whose file names an export has cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """What is before and after the last point; a name that begins with its only point has no extension."""
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(stem != "", stem).otherwise(name), F.when(stem != "", F.lower(F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))).otherwise("")


def resolved(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references (folder, name)`` with ``how`` (exact, truncated, missing) and ``found``, the file's name.

    A file is a reference's own if its name is equal, else if its stem is the longest that the reference's stem begins with, at
    the same extension in any case; two files of that length leave it missing. References that aren't exact become a row for each length
    of their stem (names are of bounded length) and meet the files by equality of (folder, extension, stem).
    """
    wanted = references.select("folder", "name").distinct()
    there = files.select("folder", F.col("name").alias("file")).distinct()
    exact = wanted.join(there.withColumn("name", F.col("file")), ["folder", "name"], "left")
    stem, extension = stem_and_extension(F.col("name"))
    open_ = exact.where("file is null").select("folder", "name", extension.alias("extension"), stem.alias("stem"))
    parts = open_.select("folder", "name", "extension", F.explode(F.sequence(F.lit(1), F.length("stem"))).alias("length"), "stem").select("folder", "name", "extension", "length", F.substring(F.col("stem"), F.lit(1), F.col("length")).alias("stem"))
    own_stem, own_extension = stem_and_extension(F.col("file"))
    candidates = parts.join(there.select("folder", "file", own_extension.alias("extension"), own_stem.alias("stem")), ["folder", "extension", "stem"])
    best = candidates.groupBy("folder", "name", "length").agg(F.min("file").alias("short"), F.count(F.lit(1)).alias("n")).groupBy("folder", "name").agg(F.max_by(F.struct("short", "n"), "length").alias("b"))
    single = best.where("b.n = 1").select("folder", "name", F.col("b.short").alias("short"))
    how = F.when(F.col("file").isNotNull(), "exact").when(F.col("short").isNotNull(), "truncated").otherwise("missing")
    found = exact.join(single, ["folder", "name"], "left").select("folder", "name", how.alias("how"), F.coalesce("file", "short").alias("found"))
    return references.join(found, ["folder", "name"], "left")
