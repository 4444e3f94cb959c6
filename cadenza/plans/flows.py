"""Queries of the file sources and sinks and of the streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadenza.functions.scalars import digits
from cadenza.plans.registry import query
from cadenza.plans.tracking import KF, QX, RHO, RV
from cadenza.plans.views import EMB_FS, ES_GT, SIG_EMB, SIG_EVT, sig_emb, sig_evt, table
from cadenza.sources import files as S
from cadenza.sources.shared import shared_path
from cadenza.streaming import streams as T


def _trial_files(spark, d) -> str:
    """A tree subject/trial/file of the parts: subjects are brands, trials sizes; odd trials have no video."""
    out = shared_path(spark, "trials")
    p = table(spark, d, "part").select(F.col("p_brand").alias("s"), F.floor(F.col("p_size") / 10).alias("t")).distinct()
    p = p.withColumn("value", F.concat_ws(" ", "s", "t"))
    p.withColumn("subject", F.replace("s", F.lit("#"), F.lit(""))).withColumn("trial", F.col("t")).select("value", "subject", "trial").repartition("subject", "trial").write.partitionBy("subject", "trial").text(out)
    return out


@query("trial_manifest", "SELECT DISTINCT 'subject=' || replace(p_brand, '#', '') || '_trial=' || p_size // 10 AS trial_key, 'subject=' || replace(p_brand, '#', '') AS subject, 'trial=' || p_size // 10 AS trial FROM part")
def trial_manifest(spark, d):
    return S.trial_manifest(S.listing(spark, _trial_files(spark, d)), r"\.txt$").drop("path")


@query("run_inventory", "SELECT 'trial=' || p_size AS run, count(DISTINCT p_brand) AS files, 0 AS plots, sum(DISTINCT_BYTES) AS bytes FROM (SELECT DISTINCT p_size // 10 AS p_size, p_brand, length(p_brand || ' ' || p_size // 10) + 1 AS DISTINCT_BYTES FROM part) GROUP BY p_size")
def run_inventory(spark, d):
    f = S.listing(spark, _trial_files(spark, d))
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -3))  # one artefact per subject here
    r = S.run_inventory(f)
    return r.select("run", F.size("artefacts").cast("bigint").alias("files"), F.col("plots").cast("int").alias("plots"), "bytes")


@query("text_signal", f"WITH j AS ({ES_GT}) SELECT DISTINCT method AS label, n, round(gt, 6) + 0.0 AS y FROM j")
def text_signal(spark, d):
    out = shared_path(spark, "text")
    m = sig_emb(spark, d).groupBy("method", "n").agg(F.avg("y").alias("y")).groupBy("method").agg(F.array_sort(F.collect_list(F.struct("n", "y"))).alias("s"))
    m.select(F.array_join(F.transform("s", lambda x: x["y"].cast("string")), " ").alias("value"), "method").repartition("method").write.partitionBy("method").text(out)
    t = S.text_signal(spark, out)
    return t.select(F.regexp_extract("path", r"method=(\d+)", 1).cast("int").alias("label"), "n", digits(F.col("y")).alias("y"))


@query("rate_table", "SELECT 's' || p_size AS subject, 't' || p_partkey AS trial, 20.0 + p_size % 3 AS fps FROM part")
def rate_table(spark, d):
    out = shared_path(spark, "rates")
    p = table(spark, d, "part")
    p.select((F.lit(20.0) + F.col("p_size") % 3).alias("fps"), F.concat(F.lit("data/s"), "p_size", F.lit("/t"), "p_partkey", F.lit("/data.avi")).alias("path")).write.csv(out, sep="\t")
    t = S.rate_table(spark, out)
    return t.select("subject", F.regexp_extract("trial", r"(.*)", 1).alias("trial"), "fps")


@query("write_summary", "SELECT p_brand AS method, count(*) AS n, sum(p_size) AS total, true AS same FROM part GROUP BY p_brand")
def write_summary(spark, d):
    out = shared_path(spark, "summary")
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("method")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    S.write_summary(s, out)
    kinds = "method string, n long, total long"
    c = spark.read.schema(kinds).option("header", True).csv(f"{out}/csv").select("method", F.col("n").alias("n2"), F.col("total").alias("t2"))
    j = spark.read.schema(kinds).json(f"{out}/json").join(c, "method")
    return j.select("method", "n", "total", ((F.col("n") == F.col("n2")) & (F.col("total") == F.col("t2"))).alias("same"))


@query("append_log", "SELECT p_brand AS method, p_partkey AS trial, round(p_retailprice, 4) AS objective FROM part")
def append_log(spark, d):
    out = shared_path(spark, "log")
    p = table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_partkey").alias("trial"), digits(F.col("p_retailprice"), 4).alias("objective"))
    S.append_log(p.where("trial % 2 = 0"), out)
    S.append_log(p.where("trial % 2 = 1"), out)
    return spark.read.parquet(out)


WIN = """WITH w AS (SELECT event_type AS key, value AS y, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * k AS start FROM events, range(0, 2) t(k))"""


@query("stream_windows", f"{WIN} SELECT key, epoch_us(start) AS start, count(*) AS n, round(avg(y), 6) + 0.0 AS mean, round(stddev_pop(y), 6) AS std, round(max(y) - min(y), 6) AS ptp, round(sum(y * y), 4) AS energy FROM w GROUP BY ALL")
def stream_windows(spark, d):
    w = T.stream_windows(T.read_stream(spark, f"{d}/events.parquet"), "event_type", "ts", "value", "6 hours", "3 hours", "40 days")
    g = T.drain(w, "update", ["key", "start"])
    return g.select("key", F.unix_micros("start").alias("start"), "n", *[digits(F.col(c)).alias(c) for c in ("mean", "std", "ptp")], digits(F.col("energy"), 4).alias("energy"))


@query("stream_autotune", "SELECT event_type AS dataset, CAST(user_id % 5 AS VARCHAR) AS method, count(*) AS count, round(sum(value), 4) AS sum_mad, sum(user_id) AS sum_snr, sum(event_id) AS sum_freq, round(max(value), 4) AS max_sigma FROM events GROUP BY ALL")
def stream_autotune(spark, d):
    e = T.read_stream(spark, f"{d}/events.parquet").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).cast("string").alias("method"), F.col("value").alias("mad"), F.col("user_id").alias("snr"), F.col("event_id").alias("freq"))
    g = T.drain(T.stream_autotune(e), "update", ["dataset", "method"])
    return g.withColumn("sum_mad", digits(F.col("sum_mad"), 4)).withColumn("max_sigma", digits(F.col("max_sigma"), 4))


def _as_files(spark, s, name: str) -> str:
    """The signal as files with whole keys, as a stream needs them that drops what comes late."""
    out = shared_path(spark, name)
    s.repartition(4, "key").write.parquet(out)
    return out


@query("stream_filter", f"WITH RECURSIVE sig AS ({SIG_EMB}), {KF}, em AS (SELECT key, n, y FROM sig WHERE n = 0 UNION ALL SELECT s.key, s.n, 0.88 * em.y + 0.12 * s.y FROM em JOIN sig s ON s.key = em.key AND s.n = em.n + 1) SELECT key, n, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2, round(em.y, 6) + 0.0 AS smooth FROM kf JOIN em USING (key, n)")
def stream_filter(spark, d):
    s = sig_emb(spark, d).select("key", "n", "y", (F.lit(2 * math.pi / EMB_FS) * (4 + F.col("key") % 9)).alias("w"))
    g = T.drain(T.stream_filter(T.read_stream(spark, _as_files(spark, s, "sig"), 2), "long", RHO, QX, RV, 0.88), "append")
    return g.select("key", "n", *[digits(F.col(c)).alias(c) for c in ("x1", "x2", "smooth")])


@query("stream_impulse", f"WITH sig AS ({SIG_EVT}), r AS (SELECT key, n, y, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s, count(*) OVER w AS c FROM sig WINDOW w AS (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT key, n // 24 AS day, sum(CASE WHEN abs((y - m) / (s + 1e-8)) > 3 THEN 1 ELSE 0 END) AS impulses, count(*) AS samples FROM r WHERE c > 1 GROUP BY ALL")
def stream_impulse(spark, d):
    g = T.drain(T.stream_impulse(T.read_stream(spark, _as_files(spark, sig_evt(spark, d), "evt"), 2), "string"), "append")
    return g.groupBy("key", F.floor(F.col("n") / 24).alias("day")).agg(F.sum(F.col("impulse").cast("long")).alias("impulses"), F.count("*").alias("samples"))
