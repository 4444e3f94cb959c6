"""Exact dedup by content sort.

Texts without ASCII white space are put into one total order of their content: by head (the first HEAD characters),
then by a fingerprint that spreads texts with one head, then by the whole text. Sampled splitters over (head,
fingerprint) range-partition that order, each partition is sorted externally, and the window over the sorted run
compares neighbours in full: only texts that are equal to the last byte share a run. What the driver gets as splitters
is bounded by row. A run of equals that exceeds a partition is split over several, evenly; its parts, one row each with
the whole text, are compared in full again and give the run one head. The fingerprint only places and sizes: it never
decides that texts are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE, cut, drop, id_and_text, partitions

HEAD = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and text_hash, xxhash64 of the text).

    Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the most code points
    in its original text, then the smallest id (null last) stays. Of rows that repeat an id and text exactly one is
    kept. An empty table gives no rows; other columns are ignored.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", "")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), norm.alias("norm"), *([F.xxhash64("text").alias("text_hash")] if text_hash else []))
    rows = cut(rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("print", F.xxhash64("norm")))
    # Runs that would overfill a partition: fewer than there are partitions.
    fill = max(1000, rows.count() // partitions(docs.sparkSession))
    large = rows.groupBy("head", "print").agg(F.ceil(F.count("*") / fill).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "points"), F.col("parts")), F.lit(0))
    rows_in_parts = rows.join(F.broadcast(large), ["head", "print"], "left").withColumn("part", part)
    run = Window.partitionBy("head", "print", "norm", "part").orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    narrow = cut(
        rows_in_parts.repartitionByRange("head", "print", "part")
        .withColumn("run", F.monotonically_increasing_id())
        .withColumn("rank", F.row_number().over(run))
        .withColumn("run", F.first("run").over(run))
        .withColumn("keep_id", F.first("doc_id").over(run))
        .withColumn("group_size", F.count("*").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(
            "doc_id", "points", "rank", "keep_id", "group_size",
            F.when(F.col("parts").isNotNull(), F.col("run")).alias("run"),
            F.when(F.col("parts").isNotNull() & (F.col("rank") == 1), F.col("norm")).alias("norm"),
            F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
            *(["text_hash"] if text_hash else []),
        )
    )
    drop(rows)
    # The first rows of split runs' parts: at most two for each partition.
    whole = Window.partitionBy("norm")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "run")).over(whole)
    parts = narrow.where("norm IS NOT NULL").select("run", best.alias("best"), F.sum("group_size").over(whole).alias("all"))
    return narrow.join(F.broadcast(parts), "run", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("all", "group_size").alias("group_size"),
        ((F.col("rank") == 1) & F.coalesce(F.col("best.run") == F.col("run"), F.lit(True))).alias("kept"),
        "text_sha256",
        *(["text_hash"] if text_hash else []),
    )
