"""Sensor series: unit conversion and summaries by (device, metric)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metric, quantity, SI unit, factor and offset to it.
UNITS = (
    ("temperature_c", "temperature", "°C", 1.0, 0.0),
    ("temperature_f", "temperature", "°C", 5.0 / 9.0, -160.0 / 9.0),
    ("humidity_pct", "humidity", "%RH", 1.0, 0.0),
    ("water_consumption_gal", "volume", "L", 3.785411784, 0.0),
    ("water_consumption_l", "volume", "L", 1.0, 0.0),
    ("water_meter_gal", "volume", "L", 3.785411784, 0.0),
    ("water_meter_l", "volume", "L", 1.0, 0.0),
)


def to_si(readings: DataFrame) -> DataFrame:
    """Readings ``(device, metric, ts_ms, value)`` with ``quantity``, ``unit`` and SI ``value``; an unknown metric is an error."""
    units = readings.sparkSession.createDataFrame(UNITS, "metric string, quantity string, unit string, factor double, shift double")
    joined = readings.join(F.broadcast(units), "metric", "left")  # a fixed table of a few rows
    known = F.when(F.col("factor").isNull(), F.raise_error(F.concat(F.lit("no unit for metric "), F.col("metric"))).cast("double")).otherwise(F.col("value") * F.col("factor") + F.col("shift"))
    return joined.withColumn("value", known).drop("factor", "shift")


def upper_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``(keys, name)``: element n/2, from 0, of a group's n sorted values that aren't null.

    Equal values are counted before they meet, so what a group sorts is its distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*keys)
    placed = counted.select("*", F.sum("__n").over(own.orderBy("__v")).alias("__upto"), F.sum("__n").over(own).alias("__all"))
    return placed.where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min("__v").alias(name))


def summary(readings: DataFrame, keys: list[str], at: str = "ts_ms", value: str = "value") -> DataFrame:
    """Count, minimum, maximum, mean, last value, first and last time and median gap of each series."""
    own = Window.partitionBy(*keys).orderBy(at)
    gaps = readings.withColumn("__gap", F.col(at) - F.lag(at).over(own))
    summed = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.max_by(value, at).alias("last"),
        F.min(at).alias("first_ts"), F.max(at).alias("last_ts"),
    )
    return summed.join(upper_medians(gaps, keys, "__gap", "median_gap"), keys, "left")


def series(readings: DataFrame, keys: list[str], at: str = "ts_ms", value: str = "value") -> DataFrame:
    """Each series as two arrays in time order."""
    listed = readings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v")))).alias("s"))
    return listed.select(*keys, F.transform("s", lambda x: x["t"]).alias("ts"), F.transform("s", lambda x: x["v"]).alias("values"))


def overlapping_start(watermark: Column, overlap_ms: int, start: Column) -> Column:
    """Where the next read starts: the watermark less an overlap, but not before ``start``."""
    return F.greatest(watermark - overlap_ms, start)
