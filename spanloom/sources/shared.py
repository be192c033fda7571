"""The folder that driver and executors share: where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the session ends.

    Where that setting is missing, a local master gets a folder of its own (one machine, as in tests). On a
    cluster that is an error: executors would write to their own disks and nobody else would see the rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table of the shared folder: lineage ends there, and a lost executor costs nothing before it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
