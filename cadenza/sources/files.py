"""Scans and sinks of trial trees, signals and logs. Listings never read file contents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.ranking import method_order, upsert_estimates


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, name, length, modified of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def trial_manifest(files: DataFrame, video: str, depth: int = 2) -> DataFrame:
    """trial_key, subject, trial (null at depth 1), path: trial folders that hold a file whose name matches video."""
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, -1 - i)
    subject, trial = (at(2), at(1)) if depth == 2 else (at(1), F.lit(None).cast("string"))
    found = files.where(F.col("name").rlike(video)).select(subject.alias("subject"), trial.alias("trial"), "path")
    m = found.groupBy("subject", "trial").agg(F.min("path").alias("path"))
    return m.select(F.concat_ws("_", "subject", "trial").alias("trial_key"), "subject", "trial", "path")


def text_signal(spark: SparkSession, root: str) -> DataFrame:
    """path, n, y: white-space separated numbers of each file, in order. What is no number is null."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    rows = t.select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("n", "v"))
    return rows.where("v <> ''").select("path", "n", F.expr("try_cast(v AS double)").alias("y"))


def rate_table(spark: SparkSession, path: str) -> DataFrame:
    """subject, trial, fps from lines of fps and path (tab between)."""
    t = spark.read.csv(path, sep="\t", schema="fps double, path string")
    return t.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("subject"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("trial"), "fps")


def write_summary(df: DataFrame, path: str) -> None:
    """The table as JSON lines and as CSV with a header, below path."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def _present(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def upsert(new: DataFrame, path: str, keys: list[str], partitions: list[str], order: DataFrame | None = None, name: str = "method") -> DataFrame:
    """Merges new into the Parquet table at path, which is laid out by partitions, and returns the table.

    Rows of new replace those of the same keys (the partitions' columns are among them; a key comes once in new); all
    others stay. Only partitions that new has rows of are read and written. The merged rows are staged beside the table
    first, as a table can not be read and overwritten in one go, and then replace their partitions in one commit, so a
    write that fails leaves the table as it was, and doing one again changes nothing. order: method_order's table
    (method, pos): rows are stored by their place in it, unknown names last.
    """
    spark = new.sparkSession
    rows = new.select(*[c for c in new.columns if c not in partitions], *partitions)
    if _present(spark, path):
        old = spark.read.schema(rows.schema).parquet(path)
        # The partitions that are touched are a list of names: pruned, not scanned.
        touched = F.broadcast(rows.select(*partitions).distinct()) if partitions else None
        old = old.join(touched, partitions, "left_semi") if partitions else old
        rows = upsert_estimates(old.select(*rows.columns), rows, keys)
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staged)
        out = spark.read.schema(rows.schema).parquet(staged)
        if order is not None:
            out = method_order(out, order, name)
        by = [c for c in ("pos",) if order is not None] + [k for k in keys if k not in partitions]
        out = (out.repartition(*partitions) if partitions else out.repartition(1)).sortWithinPartitions(*partitions, *by).select(*rows.columns)
        w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(*partitions) if partitions else w).parquet(path)
    finally:
        _removed(spark, staged)
    return spark.read.schema(rows.schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_inventory(files: DataFrame) -> DataFrame:
    """Per run (the folder above): first time seen, a map of artefact name to path, the number of plots and bytes."""
    run = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(run.alias("run")).agg(
        F.min("modified").alias("created"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("artefacts"),
        F.count_if(F.col("name").endswith(".html")).alias("plots"), F.sum("length").alias("bytes"),
    )
