"""Structured Streaming over event files: windows, sessions, deduplication, upserts by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.durable import shared_dir
from mnemora.streaming import buckets


def read(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` file or folder as a stream of ``(event_id, ts, user_id, event_type, value, props)``."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path + "*").withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    """Counts for each window and type; rows later than ``late`` are dropped once windows are emitted."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    counted = events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def run_once(result: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is now, as a table in the shared folder; ``complete`` for aggregates that shall show all windows.

    Each batch is written whole under its number, so that a batch that runs again replaces itself; nothing is kept on the driver.
    """
    spark = result.sparkSession
    path = f"{shared_dir(spark)}/mnemora-stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{path}/batch={last[-1]}" if mode == "complete" else path).select(*result.columns)


def latest(spark: SparkSession, events: DataFrame, keys: list[str], folder: str | None = None, parts: int = 64) -> DataFrame:
    """The last event of each key, kept up to date batch by batch in ``folder`` (see ``buckets``).

    Keys are spread over ``parts`` buckets by their hash, and a batch makes only those anew that it touches. The same folder goes on where a
    driver stopped.
    """
    at = folder or f"{shared_dir(spark)}/mnemora-stream-{uuid.uuid4().hex}"
    rows = events.drop("at")
    buckets.keep(rows, at, F.pmod(F.xxhash64(*keys), F.lit(parts)), keys, [F.desc("ts"), F.desc("event_id")]).awaitTermination()
    return buckets.current(spark, at, rows.schema).select(*rows.columns)
