"""Rows kept up to date by bucket of time: a late row makes its own bucket anew and no other one.

The state is a folder of tables, ``state/version=<batch>/bucket=<bucket>``; a bucket's rows are those of its newest version. A batch
reads the buckets it touches, merges, and writes their next version under its own number. A batch that runs
again after a crash reads the versions below its number and replaces its own, so each is applied once; a driver that starts anew
finds everything in the folder, beside the stream's checkpoint. Nothing is kept on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora.durable import cut, discard
from mnemora.operators.versioned import last_per_key


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _versions(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    fields = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "bucket") + ", bucket string, version long")
    return spark.read.schema(fields).parquet(f"{folder}/state") if _exists(spark, f"{folder}/state") else spark.createDataFrame([], fields)


def current(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of each bucket's newest version, of those below ``before`` where it is given."""
    rows = _versions(spark, folder, schema)
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"])


def changed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """``(version, bucket, n)``: the buckets that each batch made anew and their rows then."""
    return _versions(spark, folder, schema).groupBy("version", "bucket").agg(F.count(F.lit(1)).alias("n"))


def keep(events: DataFrame, folder: str, bucket: Column, keys: list[str], newest_first: list[Column]):
    """Start the stream over all there is now: the newest row of each key in each bucket; call it again to go on where it ended."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = cut(batch.withColumn("bucket", bucket.cast("string")))
        schema = fresh.schema
        stored = current(spark, folder, schema, before=number).join(fresh.select("bucket").distinct(), "bucket", "left_semi").select(*schema.names)
        merged = last_per_key(stored.unionByName(fresh), ["bucket", *keys], newest_first)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/version={number}")
        discard(fresh)

    return events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
