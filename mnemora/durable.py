"""Cuts of the lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else the context's checkpoint folder.

    Only where neither is set and the master is local (tests) a temporary one is made, used and removed at exit; on a
    cluster a folder of one machine would split tables over the executors' disks, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-mnemora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        chosen = spark.sparkContext.getCheckpointDir()
    return chosen.rstrip("/")


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read instead of a recomputation, and results of
    Python stages that later steps refer to by position can't change in between.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemora-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` gave and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Executions that begin here remove their shuffle files when they end: what they gave is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
