"""Forests in the order of reading: a block, then all below it, then its next sibling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.durable import cut, discard

#: Characters of a sibling's place in a path, and the digits it is written in; places are padded so that paths sort as texts.
WIDTH = 12


def numbered(blocks: DataFrame, kind: str = "kind", listed: str = "numbered", key: str = "id", parent: str = "parent", place: str = "place") -> DataFrame:
    """``blocks`` with ``number``: 1, 2, ... along each unbroken run of ``listed`` siblings, null for others."""
    siblings = Window.partitionBy(parent).orderBy(place, key)
    own = F.col(kind) == listed
    run = F.row_number().over(siblings) - F.sum(own.cast("int")).over(siblings)  # how many siblings before are no list items
    marked = blocks.withColumn("__run", F.when(own, run))
    return marked.withColumn("number", F.when(own, F.row_number().over(Window.partitionBy(parent, F.col(kind) == listed, "__run").orderBy(place, key)))).drop("__run")


def linearised(blocks: DataFrame, key: str = "id", parent: str = "parent", place: str = "place") -> DataFrame:
    """``(id, root, depth, path)``: sorting by root and path is depth-first order.

    ``place`` is a block's non-negative number among its siblings, ties by key. A block whose parent is null or isn't there is a root.
    Pointers double each round and paths grow by the path of the block pointed to, so a chain of n levels takes log2 n joins. A
    block on a cycle, or below one, reaches no root and is left out, as a reader starting at the roots never meets it.
    """
    ids = blocks.select(F.col(key).alias("parent")).distinct()
    own = F.concat(F.lpad(F.col(place).cast("string"), WIDTH, "0"), F.lit("."), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/"))
    rows = blocks.select(F.col(key).alias("id"), F.col(parent).alias("parent"), own.alias("path"))
    there = rows.join(ids.withColumn("known", F.lit(True)), "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up"), "path")
    step = cut(there.select("id", F.when(F.col("up").isNull(), F.col("id")).alias("root"), "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), "path"))
    open_rows = step.where("root is null").count()
    while open_rows:
        above = step.select(F.col("id").alias("up"), F.col("root").alias("__root"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("path").alias("__path"))
        moving = F.col("root").isNull()
        longer = cut(
            step.join(above, "up", "left").select(
                "id", F.coalesce("root", "__root").alias("root"), F.when(moving, F.col("__up")).alias("up"),
                F.when(moving, F.col("depth") + F.col("__depth")).otherwise(F.col("depth")).alias("depth"), F.when(moving, F.concat("__path", "path")).otherwise(F.col("path")).alias("path"),
            )
        )
        discard(step)
        step, left = longer, longer.where("root is null").count()
        if left == open_rows:
            break  # what is left goes round in circles
        open_rows = left
    return step.where("root is not null").select("id", "root", "depth", "path")


def read_order(blocks: DataFrame, key: str = "id", parent: str = "parent", place: str = "place") -> DataFrame:
    """``linearised`` with ``position`` from 0 in each root's tree; a tree is one page, which is what a window sorts."""
    return linearised(blocks, key, parent, place).withColumn("position", F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1)
