"""Signals, frames and logs over the given tables, each as a DataFrame and as SQL for the side-by-side check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.conditioning import regular_grid

EMB_FS, EMB_N = 64.0, 64
EVT_FS, EVT_N = 24.0, 720
ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("label").alias("method"), F.posexplode("embedding").alias("n", "v")).select("key", "method", "n", F.col("v").cast("double").alias("y"))


def sig_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", "value")
    return regular_grid(e, ["key"], "ts", "value", ORIGIN, 3600, EVT_N)


def frames_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = sig_emb(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("trial"))
    e = e.withColumn("frame", F.row_number().over(Window.partitionBy("trial").orderBy("key")) - 1)
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("y") + 0.5) * 255))).cast("int")
    return s.join(e, "key").select("trial", "frame", F.floor(F.col("n") / 8).cast("int").alias("row"), (F.col("n") % 8).alias("col"), gray.alias("gray"))


def es_gt_evt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as estimates and views as truth: key, t (microseconds), v."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("idx"), F.col("value").alias("v"), "event_type")
    return e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


def es_gt_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, method, n, es, gt: a sample and its label's mean at n."""
    from pyspark.sql import Window

    s = sig_emb(spark, sf_dir)
    gt = s.groupBy("method", "n").agg(F.avg("y").alias("gt"))
    return s.join(gt, ["method", "n"]).select("key", "method", "n", F.col("y").alias("es"), "gt")


SIG_EMB = "SELECT vec_id AS key, label AS method, CAST(unnest(range(len(embedding))) AS INT) AS n, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings"
SIG_EVT = f"""SELECT g.key, g.n, coalesce(v.y, 0.0) AS y FROM
  (SELECT k.key, CAST(r.n AS INT) AS n FROM (SELECT DISTINCT event_type AS key FROM events) k, range({EVT_N}) r(n)) g
  LEFT JOIN (SELECT event_type AS key, (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) // 3600000000 AS n, sum(value) AS y FROM events GROUP BY ALL) v USING (key, n)"""
FRAMES_EMB = """SELECT label AS trial, frame, i // 8 AS row, i % 8 AS col, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT) AS gray
  FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(unnest(range(64)) AS INT) AS i, unnest(embedding) AS v FROM embeddings)"""
ES = "SELECT user_id AS key, epoch_us(ts) AS t, event_id AS idx, value AS v FROM events WHERE event_type = 'click'"
GT = "SELECT user_id AS key, epoch_us(ts) AS t, event_id AS idx, value AS v FROM events WHERE event_type = 'view'"
ES_GT = f"SELECT s.key, s.method, s.n, s.y AS es, avg(s.y) OVER (PARTITION BY s.method, s.n) AS gt FROM ({SIG_EMB}) s"


def welch_sql(sig: str, total: int, fs: float, nperseg: int, noverlap: int, nfft: int, k_lo: int, k_hi: int, name: str = "psd") -> str:
    """CTEs that end in `name` (key, freq, power): Hann-windowed, mean-removed segments of a signal of `total` samples."""
    step = nperseg - noverlap
    return f"""{name}_seg AS (SELECT key, s.seg, n - s.seg * {step} AS i, y FROM {sig}, range({(total - noverlap) // step}) s(seg)
      WHERE n >= s.seg * {step} AND n < s.seg * {step} + {nperseg}),
    {name}_cen AS (SELECT key, seg, i, (y - avg(y) OVER (PARTITION BY key, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / {nperseg})) AS v FROM {name}_seg),
    {name}_dft AS (SELECT key, seg, k, sum(v * cos(2 * pi() * k * i / {nfft})) AS re, sum(v * sin(2 * pi() * k * i / {nfft})) AS im
      FROM {name}_cen, range({k_lo}, {k_hi + 1}) t(k) GROUP BY ALL),
    {name} AS (SELECT key, k * {fs} / {nfft} AS freq, avg((re * re + im * im) / ({fs} * {0.375 * nperseg}) * CASE WHEN k = 0 OR 2 * k = {nfft} THEN 1 ELSE 2 END) AS power
      FROM {name}_dft GROUP BY key, k)"""
