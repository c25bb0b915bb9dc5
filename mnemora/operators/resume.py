"""Fetching a series anew from where it ended: windows that overlap, what they give twice, and when to give up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start(watermark: Column, begin: Column, overlap: int, widened: Column | None = None, narrowed: Column | None = None) -> Column:
    """``(cursor, note)``: the watermark less an overlap, not before ``begin``; ``begin`` itself where there is no watermark or the range was widened.

    The note says ``backfill`` where a widened range is fetched again, ``skips ahead`` where a narrowed one begins beyond the watermark.
    """
    widened, narrowed = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (widened, narrowed))
    clamped = F.greatest(watermark - overlap, begin)
    note = F.when(widened, "backfill").when(watermark.isNotNull() & narrowed & (clamped > watermark), "skips ahead").otherwise("normal")
    return F.struct(F.when(widened | watermark.isNull(), begin).otherwise(clamped).alias("cursor"), note.alias("note"))


def windows(cursors: DataFrame, size: int, stride: int, now: int) -> DataFrame:
    """``(device, n, start, end)`` for ``cursors (device, cursor)``: windows of ``size`` every ``stride``, the last ones cut at ``now``."""
    some = cursors.where(F.col("cursor") < now)
    each = some.select("device", F.posexplode(F.sequence(F.col("cursor").cast("long"), F.lit(now - 1).cast("long"), F.lit(stride).cast("long"))).alias("n", "start"))
    return each.select("device", F.col("n").cast("long").alias("n"), "start", F.least(F.col("start") + size, F.lit(now)).alias("end"))


def given_up(windows: DataFrame, failed: DataFrame, budget: int) -> DataFrame:
    """``windows`` with ``state``: fetched, failed, or not tried, once ``budget`` windows of a device have failed in a row before it.

    Both sides are dealt by device once; a run has reached the budget at a window where as many failed among it and the numbers before it.
    """
    both = windows.select("device", "n", "start", "end", F.lit(False).alias("lost")).unionByName(failed.select("device", "n", F.lit(True).alias("lost")), allowMissingColumns=True)
    each = both.repartition("device").groupBy("device", "n").agg(F.max("start").alias("start"), F.max("end").alias("end"), F.max("lost").alias("lost")).where("start is not null")
    run = F.sum(F.col("lost").cast("int")).over(Window.partitionBy("device").orderBy("n").rangeBetween(1 - budget, 0))
    marked = each.withColumn("run", run).withColumn("last", F.min(F.when(F.col("lost") & (F.col("run") == budget), F.col("n"))).over(Window.partitionBy("device")))
    state = F.when(F.col("n") > F.col("last"), "not tried").when(F.col("lost"), "failed").otherwise("fetched")
    return marked.select("device", "n", "start", "end", state.alias("state"))


def fetched(readings: DataFrame, windows: DataFrame, size: int, stride: int, cursors: DataFrame) -> DataFrame:
    """``(device, ts_ms, n)``: each reading once for each of ``windows`` that gives it.

    A reading's windows follow from its distance to the cursor, so the join is by equality of (device, window).
    """
    away = F.col("ts_ms") - F.col("cursor")
    numbers = F.sequence(F.greatest(F.floor((away - size) / stride) + 1, F.lit(0)), F.floor(away / stride))
    placed = readings.join(cursors, "device").where(away >= 0).withColumn("n", F.explode(numbers)).drop("cursor")
    return placed.join(windows.select("device", "n", "start", "end"), ["device", "n"]).where("ts_ms >= start and ts_ms < end").drop("start", "end")


def stored(given: DataFrame, keys: list[str]) -> DataFrame:
    """What overlapping windows gave, once for each key."""
    return given.drop("n").dropDuplicates(keys)
