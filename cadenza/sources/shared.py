"""Where queries put files that other executors must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Where none is set, a local master gets a new
    folder; a cluster gets an error, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, *kept: DataFrame) -> DataFrame:
    """df, computed now and read back from the shared folder; what was kept (persisted) for it is released."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    for x in kept:
        x.unpersist()
    return df.sparkSession.read.schema(df.schema).parquet(path)
