"""Queries of the framewise operators, on the 8 x 8 frames made of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.scalars import digits
from cadenza.operators import frames as V
from cadenza.plans.registry import query
from cadenza.plans.views import FRAMES_EMB, frames_emb, table

FR = f"WITH fr AS ({FRAMES_EMB})"


@query("gray", "SELECT p_partkey AS key, CAST(round(0.299 * (p_partkey % 256) + 0.587 * (p_size * 5 % 256) + 0.114 * (CAST(floor(p_retailprice) AS BIGINT) % 256)) AS INT) AS gray FROM part")
def gray(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("key"), V.gray(F.col("p_partkey") % 256, (F.col("p_size") * 5) % 256, F.floor("p_retailprice") % 256).alias("gray"))


def _marks(fr):
    return fr.select("trial").distinct().select("trial", F.lit(8).alias("img_w"), F.lit(8).alias("img_h"), (F.lit(6.0) + F.col("trial") % 3).alias("x_left"), F.lit(4.0).alias("y_left"), (F.lit(1.0) - F.col("trial") % 2).alias("x_right"), F.lit(4.5).alias("y_right"))


@query("roi_crop", f"{FR}, b AS (SELECT DISTINCT trial, greatest(1.0 - trial % 2, 0) AS l, least(6.0 + trial % 3, 8) AS r, greatest(4 - 0.1 * (5.0 + trial % 3 + trial % 2), 0) AS t, least(4 + 0.1 * (5.0 + trial % 3 + trial % 2), 8) AS m FROM fr) SELECT trial, frame, count(*) AS pixels, sum(gray) AS total FROM fr JOIN b USING (trial) WHERE col >= CAST(round(l) AS INT) AND col < CAST(round(r) AS INT) AND row >= CAST(round(t) AS INT) AND row < CAST(round(m) AS INT) GROUP BY ALL")
def roi_crop(spark, d):
    fr = frames_emb(spark, d)
    return V.roi_crop(fr, V.shoulder_box(_marks(fr))).groupBy("trial", "frame").agg(F.count("*").alias("pixels"), F.sum("gray").alias("total"))


@query("frame_difference", f"{FR}, d AS (SELECT trial, frame, gray - lag(gray) OVER (PARTITION BY trial, row, col ORDER BY frame) AS d FROM fr) SELECT trial, frame, sum(CASE WHEN ((d % 256) + 256) % 256 > 100 THEN 1 ELSE 0 END) AS y, sum(CASE WHEN d > 100 THEN 1 ELSE 0 END) AS signed FROM d WHERE d IS NOT NULL GROUP BY ALL")
def frame_difference(spark, d):
    fr = frames_emb(spark, d)
    return V.frame_difference(fr).join(V.frame_difference(fr, wrap=False).withColumnRenamed("y", "signed"), ["trial", "frame"])


@query("flow_median", f"{FR} SELECT trial, frame, round(median(gray - 128.0 + row), 6) AS y FROM fr GROUP BY ALL")
def flow_median(spark, d):
    return V.flow_median(frames_emb(spark, d).withColumn("vy", F.col("gray") - 128.0 + F.col("row")))


PROFILE = "v AS (SELECT trial, frame, row, 0.5 * (avg(gray) + stddev_pop(gray)) AS v FROM fr GROUP BY ALL), pr AS (SELECT * FROM (SELECT trial, frame, row, v - lag(v) OVER (PARTITION BY trial, frame ORDER BY row) AS p FROM v) WHERE p IS NOT NULL)"


@query("row_profile", f"{FR}, {PROFILE} SELECT trial, frame, CAST(row AS INT) AS row, round(p, 6) + 0.0 AS p FROM pr")
def row_profile(spark, d):
    return V.row_profile(frames_emb(spark, d)).select("trial", "frame", "row", digits(F.col("p")).alias("p"))


XC = "xc AS (SELECT a.trial, a.frame, a.row - b.row + 6 AS lag, sum(a.p * b.p) AS c FROM pr a JOIN pr b ON a.trial = b.trial AND a.frame = b.frame + 1 GROUP BY ALL), nb AS (SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS z FROM xc WINDOW w AS (PARTITION BY trial, frame ORDER BY lag)), pk AS (SELECT trial, frame, unnest(arg_max({'lag': lag, 'a': a, 'c': c, 'z': z}, {'c': c, 'l': -lag})) FROM nb GROUP BY trial, frame)"


@query("profile_shift", f"{FR}, {PROFILE}, {XC}, g AS (SELECT *, floor(lag * (1299 / 12.0) + 1e-9) AS low FROM pk) SELECT trial, frame, round(20 * CASE WHEN a IS NULL OR z IS NULL OR c - (c - a) * (lag - low / (1299 / 12.0)) >= c - (c - z) * ((low + 1) / (1299 / 12.0) - lag) THEN low ELSE low + 1 END, 4) AS y FROM g")
def profile_shift(spark, d):
    return V.profile_shift(V.row_profile(frames_emb(spark, d)), 20.0).select("trial", "frame", digits(F.col("y"), 4).alias("y"))


@query("profile_shift_quadratic", f"{FR}, {PROFILE}, {XC} SELECT trial, frame, round((lag + coalesce(0.5 * (a - z) / (a - 2 * c + z), 0)) * (1299 / 12.0) * 20, 3) + 0.0 AS y FROM pk")
def profile_shift_quadratic(spark, d):
    return V.profile_shift(V.row_profile(frames_emb(spark, d)), 20.0, "quadratic").select("trial", "frame", digits(F.col("y"), 3).alias("y"))


@query("profile_shift_cubic")
def profile_shift_cubic(spark, d):
    return V.profile_shift(V.row_profile(frames_emb(spark, d)), 20.0, "cubic")


@query("roi_intensity", f"{FR}, f AS (SELECT trial, frame, avg(gray) AS m, stddev_pop(gray) AS s FROM fr GROUP BY ALL) SELECT trial, round(avg(m), 6) AS mean, round(avg(s), 6) AS std, round(20 * log10(avg(m) / greatest(avg(s), 1e-6)), 6) AS snr_db FROM f GROUP BY trial")
def roi_intensity(spark, d):
    return V.roi_intensity(frames_emb(spark, d)).select("trial", *[digits(F.col(c)).alias(c) for c in ("mean", "std", "snr_db")])


@query("centre_patch", f"{FR}, m AS (SELECT trial, frame, avg(gray) AS y FROM fr WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 GROUP BY ALL), s AS (SELECT trial, avg(y) AS mu, stddev_pop(y) AS sd, kurtosis_pop(y) AS k FROM m GROUP BY trial) SELECT trial, frame, round((y - mu) / (sd + 1e-9), 6) + 0.0 AS z, round(k, 5) + 0.0 AS kurtosis FROM m JOIN s USING (trial)")
def centre_patch(spark, d):
    return V.centre_patch(frames_emb(spark, d), half=2).select("trial", "frame", digits(F.col("z")).alias("z"), digits(F.col("kurtosis"), 5).alias("kurtosis"))


@query("rate_stats", f"{FR} SELECT trial, count(DISTINCT frame) AS frames, 20.0 + trial AS fps, round(count(DISTINCT frame) / (20.0 + trial), 6) AS seconds FROM fr GROUP BY trial")
def rate_stats(spark, d):
    fr = frames_emb(spark, d)
    rates = fr.select("trial").distinct().withColumn("fps", F.lit(20.0) + F.col("trial"))
    return V.rate_stats(fr, rates).withColumn("seconds", digits(F.col("seconds")))


@query("square_box", """WITH b AS (SELECT p_partkey AS trial, 640 AS img_w, 480 AS img_h, (p_partkey % 50) / 97.0 + p_size / 101.0 / 2 AS cx, 0.3 + p_size / 127.0 / 2 AS cy FROM part),
 c AS (SELECT *, cx * 640 AS px, cy * 480 AS py, least(greatest(640 - cx * 640, cx * 640), greatest(480 - cy * 480, cy * 480)) AS s FROM b)
 SELECT trial, greatest(CAST(trunc(px - s) AS INT), 0) AS "left", least(CAST(trunc(px + s) AS INT), 640) AS "right", greatest(CAST(trunc(py - s) AS INT), 0) AS top, least(CAST(trunc(py + s) AS INT), 480) AS bottom FROM c""")
def square_box(spark, d):
    p = table(spark, d, "part")
    b = p.select(F.col("p_partkey").alias("trial"), F.lit(640).alias("img_w"), F.lit(480).alias("img_h"), ((F.col("p_partkey") % 50) / 97.0).alias("x"), F.lit(0.3).alias("y"), (F.col("p_size") / 101.0).alias("w"), (F.col("p_size") / 127.0).alias("h"))
    return V.square_box(b)


@query("channel_select", f"{FR} SELECT trial, frame, sum(255 - gray) AS y FROM fr GROUP BY ALL")
def channel_select(spark, d):
    fr = frames_emb(spark, d).withColumn("rgb", F.array(F.col("gray"), 255 - F.col("gray"), F.lit(0)))
    return V.channel_select(fr, 1).groupBy("trial", "frame").agg(F.sum("y").alias("y"))


@query("drop_empty_frames", f"{FR} SELECT DISTINCT label + 5 AS trial, 'dof' AS method FROM embeddings WHERE label + 5 NOT IN (SELECT trial FROM fr WHERE gray > 0)")
def drop_empty_frames(spark, d):
    fr = frames_emb(spark, d)
    expected = table(spark, d, "embeddings").select((F.col("label") + 5).alias("trial"), F.lit("dof").alias("method")).distinct()
    return V.drop_empty_frames(fr.withColumn("gray", F.when(F.col("gray") > 0, F.col("gray"))), expected)[1]
