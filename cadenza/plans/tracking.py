"""Queries of the recursive filters, their parameters and what is learned for them, and the whole estimator."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import digits
from cadenza.operators import conditioning as C
from cadenza.operators import filters as K
from cadenza.operators import spectral as S
from cadenza.plans.registry import query
from cadenza.plans.signals import EMB, LO, HI, ROBUST, candidates
from cadenza.plans.views import EMB_FS, EMB_N, EVT_FS, EVT_N, SIG_EMB, SIG_EVT, sig_emb, sig_evt, welch_sql
from cadenza.sources.shared import stored

KEY = ["key"]
RHO, QX, RV = 0.98, 0.01, 0.05
#: The vectors' 64 samples are scanned in two chunks, so that these queries carry states over.
SIZE = 32


def _d(df, by, cols, places=6):
    return df.select(*by, *[digits(F.col(c), places).alias(c) for c in cols])


def _model(s: DataFrame) -> DataFrame:
    consts = {"fs": EMB_FS, "rho": RHO, "qx": QX, "rv": RV, "qf": 5e-4}
    return s.withColumn("f0", F.lit(4.0) + F.col("key") % 9).withColumns({c: F.lit(v) for c, v in consts.items()})


KF = f"""co AS (SELECT vec_id AS key, {RHO} * cos(2 * pi() * (4 + vec_id % 9) / 64) AS a, {RHO} * sin(2 * pi() * (4 + vec_id % 9) / 64) AS b FROM embeddings),
 kf AS (SELECT key, -1 AS n, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, {QX}::DOUBLE AS p11, 0.0::DOUBLE AS p12, {QX}::DOUBLE AS p22 FROM co
  UNION ALL SELECT key, n, m1 + g1 * (y - m1), m2 + g2 * (y - m1), greatest(a11 - g1 * a11, 1e-10), 0.5 * ((a12 - g1 * a12) + (a12 - g2 * a11)), greatest(a22 - g2 * a12, 1e-10)
  FROM (SELECT *, a11 / greatest(a11 + {RV}, 1e-12) AS g1, a12 / greatest(a11 + {RV}, 1e-12) AS g2 FROM
   (SELECT s.key, s.n, s.y, a * x1 - b * x2 AS m1, b * x1 + a * x2 AS m2, a * a * p11 - 2 * a * b * p12 + b * b * p22 + {QX} AS a11,
      a * b * p11 + (a * a - b * b) * p12 - a * b * p22 AS a12, b * b * p11 + 2 * a * b * p12 + a * a * p22 + {QX} AS a22
    FROM kf JOIN sig s ON s.key = kf.key AND s.n = kf.n + 1 JOIN co ON co.key = kf.key)))"""
REC = f"WITH RECURSIVE sig AS ({SIG_EMB}), {KF}"


@query("kf_filter", f"{REC} SELECT key, n, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2 FROM kf WHERE n >= 0")
def kf_filter(spark, d):
    return _d(K.kf_states(_model(sig_emb(spark, d)), KEY, size=SIZE), ["key", "n"], ["x1", "x2"])


# The backward pass: pf is the filtered covariance times the transposed rotation, its product with the inverse of the
# predicted covariance is the gain.
RTS = f"""fm AS MATERIALIZED (SELECT kf.key, n, x1, x2, a * x1 - b * x2 AS m1, b * x1 + a * x2 AS m2, a * p11 - b * p12 AS pf11, b * p11 + a * p12 AS pf12, a * p12 - b * p22 AS pf21, b * p12 + a * p22 AS pf22,
   a * a * p11 - 2 * a * b * p12 + b * b * p22 + {QX} AS q11, a * b * p11 + (a * a - b * b) * p12 - a * b * p22 AS q12, b * b * p11 + 2 * a * b * p12 + a * a * p22 + {QX} AS q22
  FROM kf JOIN co ON co.key = kf.key WHERE n >= 0),
 ga AS MATERIALIZED (SELECT key, n, x1, x2, m1, m2, (pf11 * q22 - pf12 * q12) / de AS g11, (pf12 * q11 - pf11 * q12) / de AS g12, (pf21 * q22 - pf22 * q12) / de AS g21, (pf22 * q11 - pf21 * q12) / de AS g22
  FROM (SELECT *, q11 * q22 - q12 * q12 AS de FROM fm)),
 sm AS (SELECT key, n, x1 AS s1, x2 AS s2 FROM ga WHERE n = {EMB_N - 1}
  UNION ALL SELECT ga.key, ga.n, x1 + g11 * (s1 - m1) + g12 * (s2 - m2), x2 + g21 * (s1 - m1) + g22 * (s2 - m2) FROM sm JOIN ga ON ga.key = sm.key AND ga.n = sm.n - 1)"""


@query("kf_smoother", f"{REC}, {RTS} SELECT key, n, round(s1, 6) + 0.0 AS x1, round(s2, 6) + 0.0 AS x2 FROM sm")
def kf_smoother(spark, d):
    return _d(K.kf_states(_model(sig_emb(spark, d)), KEY, smooth=True, size=SIZE), ["key", "n"], ["x1", "x2"])


def _tracks(spark, d):
    s = K.kf_states(_model(sig_emb(spark, d)), KEY)
    return K.phase_frequency(s, KEY, EMB_FS, F.lit(4.0) + F.col("key") % 9, LO, HI)


TRACK = f"""th AS (SELECT key, n, atan2(x2, x1) AS th FROM kf WHERE n >= 0), dd AS (SELECT key, n, th - lag(th) OVER (PARTITION BY key ORDER BY n) AS dt FROM th),
 ff AS (SELECT key, n, ((dt + pi()) - 2 * pi() * floor((dt + pi()) / (2 * pi())) - pi()) * 64 / (2 * pi()) AS f FROM dd),
 tr AS (SELECT key, n, greatest(4.0, least(16.0, coalesce(f, lead(f) OVER (PARTITION BY key ORDER BY n), 4 + key % 9))) AS track_hz FROM ff)"""


@query("phase_frequency", f"{REC}, {TRACK} SELECT key, n, round(track_hz, 5) AS track_hz FROM tr")
def phase_frequency(spark, d):
    return _d(_tracks(spark, d), ["key", "n"], ["track_hz"], 5)


SUM = "su AS (SELECT key, quantile_cont(track_hz, 0.5) AS rr_hz, avg(CASE WHEN track_hz <= 4 + 1e-6 OR track_hz >= 16 - 1e-6 THEN 1.0 ELSE 0 END) AS saturated, quantile_cont(track_hz, 0.95) - quantile_cont(track_hz, 0.05) AS dyn_range FROM tr GROUP BY key)"


@query("track_summary", f"{REC}, {TRACK}, {SUM} SELECT key, round(rr_hz, 5) AS rr_hz, round(rr_hz * 60, 4) AS rr_bpm, round(saturated, 5) AS saturated, round(dyn_range, 5) AS dyn_range FROM su")
def track_summary(spark, d):
    r = K.track_summary(_tracks(spark, d), KEY, LO, HI)
    return r.select("key", digits(F.col("rr_hz"), 5).alias("rr_hz"), digits(F.col("rr_bpm"), 4).alias("rr_bpm"), digits(F.col("saturated"), 5).alias("saturated"), digits(F.col("dyn_range"), 5).alias("dyn_range"))


@query("drift_sigma", f"{REC}, {TRACK}, {SUM} SELECT key, round(60 * rr_hz * sqrt(0.0005 * 64 * 30), 4) AS sigma_bpm FROM su")
def drift_sigma(spark, d):
    return _d(K.drift_sigma(K.track_summary(_tracks(spark, d), KEY, LO, HI), EMB_FS, F.lit(5e-4)), KEY, ["sigma_bpm"], 4)


@query("ukf_frequency")
def ukf_frequency(spark, d):
    return K.ukf_tracks(_model(sig_emb(spark, d)), KEY, LO, HI).drop("weight")


@query("robust_ukf")
def robust_ukf(spark, d):
    return K.ukf_tracks(_model(sig_emb(spark, d)), KEY, LO, HI, nu=4.0)


@query("bandpass_gust")
def bandpass_gust(spark, d):
    return K.bandpass(sig_emb(spark, d), KEY, EMB_FS, LO, HI, edges="gust")


def _zero_phase_sql(pad: int = 15) -> str:
    """Both passes sample by sample over the series with its ends mirrored; x of a pass is its input in its order."""
    b, a = K.butterworth(2, EMB_FS, LO, HI)
    zi, order, last = K.steady_state(b, a), len(a) - 1, EMB_N + 2 * pad - 1
    out = f"({float(b[0])!r} * s.x + l.z1)"
    new = ", ".join(f"{f'l.z{i + 1}' if i < order else '0.0'} + {float(b[i])!r} * s.x - {float(a[i])!r} * {out} AS z{i}" for i in range(1, order + 1))
    first = ", ".join(f"{float(zi[i - 1])!r} * x AS z{i}" for i in range(1, order + 1))
    run = lambda name, src: f"{name} AS (SELECT key, -1 AS j, 0.0::DOUBLE AS y, {first} FROM {src} WHERE j = 0 UNION ALL SELECT s.key, s.j, {out}, {new} FROM {name} l JOIN {src} s ON s.key = l.key AND s.j = l.j + 1)"
    return f"""WITH RECURSIVE sig AS ({SIG_EMB}), ends AS (SELECT key, max(CASE WHEN n = 0 THEN y END) AS y0, max(CASE WHEN n = {EMB_N - 1} THEN y END) AS y1 FROM sig GROUP BY key),
 e AS (SELECT key, n + {pad} AS j, y AS x FROM sig UNION ALL SELECT key, {pad} - n, 2 * y0 - y FROM sig JOIN ends USING (key) WHERE n BETWEEN 1 AND {pad}
  UNION ALL SELECT key, {pad + 2 * (EMB_N - 1)} - n, 2 * y1 - y FROM sig JOIN ends USING (key) WHERE n BETWEEN {EMB_N - 1 - pad} AND {EMB_N - 2}),
 {run("f", "e")}, r AS (SELECT key, {last} - j AS j, y AS x FROM f WHERE j >= 0), {run("g", "r")}
 SELECT key, CAST({last - pad} - j AS INT) AS n, round(y, 6) + 0.0 AS y FROM g WHERE j BETWEEN {last - pad - EMB_N + 1} AND {last - pad}"""


@query("bandpass_pad", _zero_phase_sql())
def bandpass_pad(spark, d):
    return _d(K.bandpass(sig_emb(spark, d), KEY, EMB_FS, LO, HI, size=SIZE), ["key", "n"], ["y"])


def _lowpass_sql() -> str:
    b, a = K.butterworth(6, EMB_FS, None, 12.0)
    z = [f"z{i}" for i in range(1, 7)] + ["0.0"]
    out = f"({b[0]!r} * s.y + l.z1)"
    new = ", ".join(f"{('l.' + z[i]) if i < 6 else '0.0'} + {float(b[i])!r} * s.y - {float(a[i])!r} * {out} AS z{i}" for i in range(1, 7))
    first = ", ".join(f"0.0::DOUBLE AS z{i}" for i in range(1, 7))
    return f"WITH RECURSIVE sig AS ({SIG_EMB}), l AS (SELECT vec_id AS key, -1 AS n, 0.0::DOUBLE AS y, {first} FROM embeddings UNION ALL SELECT s.key, s.n, {out}, {new} FROM l JOIN sig s ON s.key = l.key AND s.n = l.n + 1) SELECT key, n, round(y, 6) + 0.0 AS y FROM l WHERE n >= 0".replace("np.float64", "")


@query("lowpass", _lowpass_sql())
def lowpass(spark, d):
    return _d(K.lowpass(sig_emb(spark, d), KEY, EMB_FS, 12.0, size=SIZE), ["key", "n"], ["y"])


# The imaginary part of the analytic signal of an even number of samples, as one sum: cotangents at odd distances.
ANALYTIC = f"""im AS (SELECT a.key, a.n, any_value(a.y) AS re, sum(CASE WHEN (a.n - b.n) % 2 <> 0 THEN b.y * 2.0 / {EMB_N} * cot(pi() * (a.n - b.n) / {EMB_N}) ELSE 0 END) AS im FROM sig a JOIN sig b ON a.key = b.key GROUP BY a.key, a.n),
 ph AS (SELECT key, n, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY key ORDER BY n) AS dt FROM im),
 hf AS (SELECT key, ((dt + pi()) - 2 * pi() * floor((dt + pi()) / (2 * pi())) - pi()) * {EMB_FS} / (2 * pi()) AS f FROM ph)"""


@query("hilbert_candidate", f"{EMB}, {ANALYTIC} SELECT key, round(quantile_cont(f, 0.5), 5) AS hz, round(1 / (1 + stddev_pop(f)), 5) AS confidence, round(stddev_pop(f), 5) AS spread FROM hf WHERE f BETWEEN {LO} AND {HI} GROUP BY key")
def hilbert_candidate(spark, d):
    return _d(K.hilbert_candidate(sig_emb(spark, d), KEY, EMB_FS, LO, HI), KEY, ["hz", "confidence", "spread"], 5)


META = f"{EMB}, {ROBUST}, me AS (SELECT key, sigma, stddev_pop(y) AS s, avg(abs(y)) AS m FROM sig JOIN st USING (key) GROUP BY key, sigma)"
EFF = """mo AS (SELECT *, greatest(0.3, least(4.0, CASE WHEN key % 4 = 0 THEN (s / m + (key % 5 + 1) / 4.0) / 2 ELSE s / m END)) AS motion, CASE WHEN key % 3 = 0 THEN key % 25 END AS roi, CASE WHEN key % 2 = 0 THEN key % 9 / 2.0 END AS pk FROM me),
 sc AS (SELECT *, greatest(0.7, least(2.5, 1 + 0.35 * (motion - 1))) AS sc, least(greatest((1.2 * least(sigma, 10)) ** 2, 0.03), 1.5) AS rv0 FROM mo),
 ep AS (SELECT key, motion, greatest(1e-7, least(0.1, 1e-4 * sc * CASE WHEN roi < 5 THEN 1.2 ELSE 1 END * CASE WHEN pk < 1.5 THEN 1.15 WHEN pk > 3 THEN 0.85 ELSE 1 END)) AS qx,
  greatest(1e-7, least(5e-3, 5e-5 * sc * CASE WHEN roi < 5 THEN 1.2 ELSE 1 END * CASE WHEN pk < 1.5 THEN 1.15 WHEN pk > 3 THEN 0.85 ELSE 1 END)) AS qf,
  greatest(0.03, least(1.5, rv0 * (0.8 + 0.4 * sc) * CASE WHEN roi < 5 THEN 1.5 WHEN roi > 15 THEN 0.85 ELSE 1 END * CASE WHEN pk < 1.5 THEN 1.1 WHEN pk > 3 THEN 0.9 ELSE 1 END)) AS rv,
  CASE WHEN motion > 1.2 THEN least(0.98, 0.9 + 0.03 * (motion - 1)) WHEN motion < 0.9 THEN 0.85 ELSE 0 END AS alpha FROM sc)"""


def _effective(spark, d):
    s = sig_emb(spark, d)
    st = C.signal_stats(s, KEY).select("key", F.col("std").alias("signal_std"), F.col("abs_mean").alias("signal_abs_mean"))
    m = C.robust_stats(s, KEY).select("key", "sigma").join(st, "key")
    k = F.col("key")
    m = m.withColumns({"roi_std": F.when(k % 4 == 0, k % 5 + 1), "roi_mean": F.lit(4.0), "roi_snr_db": F.when(k % 3 == 0, k % 25), "peak_ratio": F.when(k % 2 == 0, k % 9 / 2.0)})
    return K.effective_params(m, EMB_FS)


@query("effective_params", f"{META}, {EFF} SELECT key, round(motion, 6) AS motion, round(exp(-1 / (64 * 30.0)), 8) AS rho, round(qx * 1e4, 6) AS qx, round(qf * 1e4, 6) AS qf, round(rv, 6) AS rv, round(alpha, 6) AS alpha FROM ep")
def effective_params(spark, d):
    e = _effective(spark, d)
    return e.select("key", digits(F.col("motion")).alias("motion"), digits(F.col("rho"), 8).alias("rho"), digits(F.col("qx") * 1e4).alias("qx"), digits(F.col("qf") * 1e4).alias("qf"), digits(F.col("rv")).alias("rv"), digits(F.col("alpha")).alias("alpha"))


@query("spectral_guidance", f"""{META}, {EFF}, gd AS (SELECT *, 0.6 * least(key % 6 / 5.0, 1) + 0.4 * tanh((key % 4) / 3.5) - 0.1 AS c FROM ep), gt AS (SELECT *, 1 / (1 + 0.8 * greatest(c, 0)) AS t, 1 + 0.8 * greatest(-c, 0) AS l FROM gd)
 SELECT key, round(1e4 * CASE WHEN c >= 0 THEN greatest(qx * (0.7 * t + 0.3), 1e-9) ELSE least(qx * (0.5 * l + 0.5), 1) END, 6) AS qx, round(1e4 * CASE WHEN c >= 0 THEN greatest(qf * t, 5e-6) ELSE least(qf * l, 1e-3) END, 6) AS qf,
 round(CASE WHEN c >= 0 THEN greatest(rv * (0.6 * t + 0.4), 0.03) ELSE greatest(least(rv * (0.5 * l + 0.5), 10), 0.03) END, 6) AS rv FROM gt""")
def spectral_guidance(spark, d):
    e = _effective(spark, d).withColumn("confidence", (F.col("key") % 6).cast("double")).withColumn("snr", (F.col("key") % 4).cast("double"))
    g = K.spectral_guidance(e)
    return g.select("key", digits(F.col("qx") * 1e4).alias("qx"), digits(F.col("qf") * 1e4).alias("qf"), digits(F.col("rv")).alias("rv"))


@query("ensemble_blend", f"""WITH sig AS ({SIG_EMB}), h AS (SELECT key, n, 'a' AS head, y AS s, 8 + y AS f FROM sig UNION ALL SELECT key, n, 'b', -y, 6 + 2 * y FROM sig UNION ALL SELECT key, n, 'c', 2 * y, 9 - y FROM sig),
 w AS (SELECT vec_id AS key, unnest(['a', 'b', 'c']) AS head, unnest([1.0, 2.0 * 0.5, CASE WHEN vec_id % 3 = 0 THEN 0.1 ELSE vec_id % 5 * 0.4 + 0.2 END]) AS w FROM embeddings),
 g AS (SELECT key, head, w / sum(w) OVER (PARTITION BY key) AS sh, row_number() OVER (PARTITION BY key ORDER BY w DESC, head) = 1 AS best FROM w)
 SELECT h.key, h.n, round(sum(sh * f), 6) AS track_hz, round(max(CASE WHEN best THEN s END), 6) + 0.0 AS signal_hat FROM h JOIN g USING (key, head) GROUP BY ALL""")
def ensemble_blend(spark, d):
    s = sig_emb(spark, d)
    y = F.col("y")
    heads = F.array(*[F.struct(F.lit(h).alias("head"), sig.alias("signal_hat"), f.alias("track_hz")) for h, sig, f in (("a", y, 8 + y), ("b", -y, 6 + 2 * y), ("c", 2 * y, 9 - y))])
    k = F.col("key")
    rows = F.array(
        F.struct(F.lit("a").alias("head"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("reliability")),
        F.struct(F.lit("b").alias("head"), F.lit(2.0).alias("weight"), F.lit(None).cast("double").alias("reliability")),
        F.struct(F.lit("c").alias("head"), F.when(k % 3 == 0, -1.0).otherwise(k % 5 * 0.4 + 0.2).alias("weight"), F.lit(1.0).alias("reliability")),
    )
    w = s.select("key").distinct().select("key", F.inline(rows))
    return _d(K.ensemble_blend(s.select("key", "n", F.inline(heads)), w, KEY), ["key", "n"], ["track_hz", "signal_hat"])


def _packed(spark, d):
    return K.pack(C.robust_zscore(sig_emb(spark, d), KEY, limit=5.0).select("key", "n", "y"), KEY)


@query("em_local_level")
def em_local_level(spark, d):
    q, r, ll, rounds = K.em_local_level(_packed(spark, d), KEY)
    return spark.createDataFrame([(q, r, ll, rounds)], "q double, r double, ll double, iterations int")


@query("oscillator_em")
def oscillator_em(spark, d):
    e = K.oscillator_em(_packed(spark, d), KEY, w=2 * math.pi * 8 / 64)
    return spark.createDataFrame([tuple(e.values())], ", ".join(f"{k} double" for k in e))


@query("param_sweep", f"WITH RECURSIVE sig AS ({SIG_EMB}), g AS (SELECT unnest([0, 1, 2, 3]) AS param_id, unnest([0.01, 0.01, 0.1, 0.1]) AS qx, unnest([0.05, 0.5, 0.05, 0.5]) AS rv), co AS (SELECT vec_id AS key, {RHO} * cos(2 * pi() * (4 + vec_id % 9) / 64) AS a, {RHO} * sin(2 * pi() * (4 + vec_id % 9) / 64) AS b FROM embeddings), kf AS (SELECT key, param_id, qx, rv, -1 AS n, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, qx::DOUBLE AS p11, 0.0::DOUBLE AS p12, qx::DOUBLE AS p22 FROM co, g UNION ALL SELECT key, param_id, qx, rv, n, m1 + g1 * (y - m1), m2 + g2 * (y - m1), greatest(a11 - g1 * a11, 1e-10), 0.5 * ((a12 - g1 * a12) + (a12 - g2 * a11)), greatest(a22 - g2 * a12, 1e-10) FROM (SELECT *, a11 / greatest(a11 + rv, 1e-12) AS g1, a12 / greatest(a11 + rv, 1e-12) AS g2 FROM (SELECT s.key, param_id, qx, rv, s.n, s.y, a * x1 - b * x2 AS m1, b * x1 + a * x2 AS m2, a * a * p11 - 2 * a * b * p12 + b * b * p22 + qx AS a11, a * b * p11 + (a * a - b * b) * p12 - a * b * p22 AS a12, b * b * p11 + 2 * a * b * p12 + a * a * p22 + qx AS a22 FROM kf JOIN sig s ON s.key = kf.key AND s.n = kf.n + 1 JOIN co ON co.key = kf.key))) SELECT key, param_id, round(avg(abs(x1)), 6) AS level FROM kf WHERE n >= 0 GROUP BY ALL")
def param_sweep(spark, d):
    defaults = {"fs": EMB_FS, "rho": RHO, "qx": QX, "rv": RV, "qf": 5e-4}
    grid = K.param_grid(spark, [{"qx": [0.01, 0.1], "rv": [0.05, 0.5]}], defaults)
    s = K.param_sweep(sig_emb(spark, d).withColumn("f0", F.lit(4.0) + F.col("key") % 9), KEY, grid)
    r = K.kf_states(s, ["key", "param_id"])
    return r.groupBy("key", "param_id").agg(digits(F.avg(F.abs("x1"))).alias("level"))


@query("phase_amplitude_coupling", f"""{EMB}, r AS (SELECT key, 2 * pi() * n / 16 AS ph, 1 + 0.3 * y AS a FROM sig), t AS (SELECT key, count(*) AS n, sum(cos(ph)) AS c, sum(sin(ph)) AS s, sum(cos(ph) ** 2) AS cc, sum(cos(ph) * sin(ph)) AS cs, sum(sin(ph) ** 2) AS ss, sum(a) AS a, sum(a * cos(ph)) AS ac, sum(a * sin(ph)) AS az FROM r GROUP BY key),
 b AS (SELECT key, a / n AS b0, ac / cc AS b1, az / ss AS b2 FROM t) SELECT key, round(b0, 5) AS a0, round(least(1, sqrt(b1 * b1 + b2 * b2) / b0), 5) AS k, round(atan2(b2, b1), 4) + 0.0 AS phi_mod FROM b""")
def phase_amplitude_coupling(spark, d):
    s = sig_emb(spark, d).withColumn("ph", F.lit(2 * math.pi / 16) * F.col("n")).withColumn("a", 1 + 0.3 * F.col("y"))
    r = K.phase_amplitude_coupling(s, KEY, "ph", "a")
    return r.select("key", digits(F.col("a0"), 5).alias("a0"), digits(F.col("k"), 5).alias("k"), digits(F.col("phi_mod"), 4).alias("phi_mod"))


#: Four models of two oscillators each (cycles of 64 samples, damping, noise), dealt to the keys in turn.
BLOCKS = [(m, c, a, 2 * math.pi * cycles / 64, q) for m in range(4) for c, (a, cycles, q) in enumerate([(0.98, 5 + m, 0.01), (0.95, 13 + m, 0.02)])]


def _block_sql() -> str:
    """Four means and ten covariances, sample by sample; co has each model's rotations."""
    ij = [(i, j) for i in range(4) for j in range(i, 4)]
    p = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    q = lambda i: f"q{i // 2}"
    f = lambda i: {2 * (i // 2): (f"c{i // 2}" if i % 2 == 0 else f"s{i // 2}"), 2 * (i // 2) + 1: (f"-s{i // 2}" if i % 2 == 0 else f"c{i // 2}")}
    co = ", ".join(f"({m}, " + ", ".join(f"{v!r}::DOUBLE" for _, c, a, w, noise in BLOCKS if _ == m for v in (a * math.cos(w), a * math.sin(w), noise)) + ")" for m in range(4))
    start = ", ".join(["0.0::DOUBLE AS x%d" % i for i in range(4)] + [f"{'(' + q(i) + ')' if i == j else '0.0::DOUBLE'} AS {p(i, j)}" for i, j in ij])
    m = ", ".join("(" + " + ".join(f"{v} * x{k}" for k, v in f(i).items()) + f") AS m{i}" for i in range(4))
    a = ", ".join("(" + " + ".join(f"{v} * {u} * {p(k, n)}" for k, v in f(i).items() for n, u in f(j).items()) + (f" + {q(i)}" if i == j else "") + f") AS a{i}{j}" for i, j in ij)
    g = lambda i: f"(a{min(i, 0)}{max(i, 0)} + a{min(i, 2)}{max(i, 2)})"
    new = ", ".join([f"m{i} + g{i} / v * (y - m0 - m2) AS x{i}" for i in range(4)] + [f"a{i}{j} - g{i} * g{j} / v AS {p(i, j)}" for i, j in ij])
    return f"""WITH RECURSIVE sig AS ({SIG_EMB}), co(model, c0, s0, q0, c1, s1, q1) AS (VALUES {co}),
 kf AS (SELECT vec_id AS key, -1 AS n, {start} FROM embeddings JOIN co ON model = vec_id % 4
  UNION ALL SELECT key, n, {new} FROM (SELECT *, g0 + g2 + 0.05 AS v FROM (SELECT *, {", ".join(f"{g(i)} AS g{i}" for i in range(4))} FROM
   (SELECT s.key, s.n, s.y, {m}, {a} FROM kf JOIN sig s ON s.key = kf.key AND s.n = kf.n + 1 JOIN co ON model = s.key % 4))))
 SELECT key, n, component, round(CASE component WHEN 0 THEN x0 ELSE x2 END, 6) + 0.0 AS x FROM kf, (VALUES (0), (1)) t(component) WHERE n >= 0"""


@query("block_append", _block_sql())
def block_append(spark, d):
    models = K.block_models(spark.createDataFrame(BLOCKS, "model int, comp int, a double, w double, q double"), ["model"])
    packed = K.pack(sig_emb(spark, d).withColumn("model", (F.col("key") % 4).cast("int")), KEY, ["model"])
    return _d(K.block_append(packed, KEY, models, 0.05), ["key", "n", "component"], ["x"])


@query("trial_record_pack", f"{EMB} SELECT key, count(*) AS n, round(sum(y * n), 5) + 0.0 AS moment FROM sig GROUP BY key")
def trial_record_pack(spark, d):
    s = K.unpack(K.pack(sig_emb(spark, d), KEY), KEY, ["y"])
    return s.groupBy("key").agg(F.count("*").alias("n"), digits(F.sum(F.col("y") * F.col("n")), 5).alias("moment"))


# ---- the estimator ---------------------------------------------------------------------------------------------


def estimate_rates(signal: DataFrame, keys: list[str], fs: float, total: int, lo: float, hi: float, head: str = "kfstd", edges: str = "gust", smoothing: float = 0.88) -> DataFrame:
    """keys, hz0 (coarse), rr_hz, rr_bpm, saturated, dyn_range: the whole chain from raw series to one rate per key.

    Detrending, band-pass, robust scale, coarse frequency by vote, adapted noise levels, filter, smoothed track.
    """
    # Each of these is read several times below; what is kept may spill to disk and is made again if it is lost.
    raw = C.clean(signal.select(*keys, "n", "y")).persist()
    x = K.bandpass(C.detrend_linear(raw, keys), keys, fs, lo, hi, edges).persist()
    z = C.robust_zscore(x, keys).persist()
    cand = candidates(z, total, fs, lo, hi).unionByName(K.hilbert_candidate(z, keys, fs, lo, hi).select(*keys, "hz", "confidence", F.lit("hilbert").alias("label")))
    vote = S.coarse_frequency(cand, keys, lo, hi).persist()
    meta = z.groupBy(*keys).agg(F.first("sigma").alias("sigma"), F.first("snr").alias("snr")).join(vote.select(*keys, F.col("hz").alias("f0"), F.col("confidence_max").alias("confidence")), keys)
    model = K.spectral_guidance(K.effective_params(meta, fs, smoothing)).withColumn("fs", F.lit(fs))
    s = z.select(*keys, "n", "y").join(model.select(*keys, *K.MODEL), keys)
    if head == "kfstd":
        st = K.kf_states(s, keys, smooth=True).join(vote.select(*keys, "hz"), keys)
        tracks = K.phase_frequency(st, keys, fs, F.col("hz"), lo, hi).select(*keys, "n", "track_hz")
    else:
        tracks = K.ukf_tracks(s, keys, lo, hi, nu=4.0 if head == "robust_attention" else None).select(*keys, "n", "track_hz")
    smooth = C.ema(tracks.withColumnRenamed("track_hz", "y"), keys, smoothing).withColumnRenamed("y", "track_hz")
    return stored(K.track_summary(smooth, keys, lo, hi).join(vote.select(*keys, F.col("hz").alias("hz0")), keys), raw, x, z, vote)


@query("rate_estimator")
def rate_estimator(spark, d):
    return estimate_rates(sig_evt(spark, d), KEY, EVT_FS, EVT_N, 0.5, 6.0)


EVT_CAND = welch_sql("sg", EVT_N, EVT_FS, 480, 240, 480, 10, 120)


@query("event_rates", f"""WITH raw AS ({SIG_EVT}), tl AS (SELECT key, regr_slope(y, n) AS b, regr_intercept(y, n) AS a FROM raw GROUP BY key), sig AS (SELECT key, n, y - a - b * n AS y FROM raw JOIN tl USING (key)), {ROBUST},
 sg AS (SELECT key, n, greatest(-3.5, least(3.5, (y - med) / greatest(sigma, 1e-6))) AS y FROM sig JOIN st USING (key)), {EVT_CAND}
 SELECT key, round(arg_max(freq, {{'p': power, 'f': -freq}}), 6) AS hz, round(max(power) / (median(power) + 1e-9), 5) AS ratio, round(least(5, max(power) / (median(power) + 1e-9) / 4), 5) AS confidence FROM psd GROUP BY key""")
def event_rates(spark, d):
    raw = sig_evt(spark, d).persist()
    flat = C.detrend_linear(raw, KEY).persist()
    z = C.robust_zscore(flat, KEY)
    r = S.welch_candidate(z, KEY, EVT_FS, EVT_N, 0.5, 6.0)
    return stored(r.select("key", digits(F.col("hz")).alias("hz"), digits(F.col("ratio"), 5).alias("ratio"), digits(F.col("confidence"), 5).alias("confidence")), raw, flat)
