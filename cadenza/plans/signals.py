"""Queries of the conditioning and spectral operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.scalars import digits
from cadenza.operators import conditioning as C
from cadenza.operators import spectral as S
from cadenza.plans.registry import query
from cadenza.plans.views import EMB_FS, EMB_N, ES_GT, EVT_FS, EVT_N, SIG_EMB, SIG_EVT, es_gt_emb, sig_emb, sig_evt, table, welch_sql

K = ["key"]
LO, HI = 4.0, 16.0
EMB = f"WITH sig AS ({SIG_EMB})"
EVT = f"WITH sig AS ({SIG_EVT})"


def _y(df, *cols, places=6):
    return df.select(*cols, digits(F.col("y"), places).alias("y"))


@query("regular_grid", f"{EVT} SELECT key, n, round(y, 6) AS y FROM sig")
def regular_grid(spark, d):
    return _y(sig_evt(spark, d), "key", "n")


@query("detrend_linear", f"{EMB}, s AS (SELECT key, regr_slope(y, n) AS b, regr_intercept(y, n) AS a FROM sig GROUP BY key) SELECT key, n, round(y - a - b * n, 6) + 0.0 AS y FROM sig JOIN s USING (key)")
def detrend_linear(spark, d):
    return _y(C.detrend_linear(sig_emb(spark, d), K), "key", "n")


@query("clean_values", f"{EMB} SELECT key, n, round(CASE WHEN n % 7 = 0 THEN 0 ELSE y END, 6) + 0.0 AS y FROM sig")
def clean_values(spark, d):
    s = sig_emb(spark, d).withColumn("y", F.when(F.col("n") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    return _y(C.clean(s), "key", "n")


@query("zscore", f"{EMB}, s AS (SELECT key, avg(y) AS m, stddev_pop(y) AS d FROM sig GROUP BY key) SELECT key, n, round(CASE WHEN d > 1e-8 THEN (y - m) / (d + 1e-8) ELSE y - m END, 6) + 0.0 AS y FROM sig JOIN s USING (key)")
def zscore(spark, d):
    return _y(C.zscore(sig_emb(spark, d), K), "key", "n")


ROBUST = """med AS (SELECT key, median(y) AS med, stddev_pop(y) AS std FROM sig GROUP BY key),
 st AS (SELECT key, any_value(med) AS med, any_value(std) AS std, 1.4826 * median(abs(y - med)) AS sigma FROM sig JOIN med USING (key) GROUP BY key)"""


@query("robust_zscore", f"{EMB}, {ROBUST} SELECT key, n, round(greatest(-2.5, least(2.5, (y - med) / greatest(sigma, 1e-6))), 6) + 0.0 AS y, abs((y - med) / greatest(sigma, 1e-6)) >= 2.5 AS clipped, round(sigma, 6) AS sigma, round(CASE WHEN sigma > 0 THEN std / greatest(sigma, 1e-6) ELSE 0 END, 6) AS snr FROM sig JOIN st USING (key)")
def robust_zscore(spark, d):
    r = C.robust_zscore(sig_emb(spark, d), K, limit=2.5)
    return r.select("key", "n", digits(F.col("y")).alias("y"), "clipped", digits(F.col("sigma")).alias("sigma"), digits(F.col("snr")).alias("snr"))


WELCH64 = welch_sql("sig", EMB_N, EMB_FS, EMB_N, EMB_N // 2, EMB_N, 4, 16)
PEAK = "pk AS (SELECT key, arg_max(freq, {'p': power, 'f': -freq}) AS hz, max(power) AS power, median(power) AS m FROM psd GROUP BY key)"


@query("sign_align", f"{EMB}, {WELCH64}, {PEAK}, dt AS (SELECT key, sum(y * cos(2 * pi() * hz * n / 64)) AS dot FROM sig JOIN pk USING (key) WHERE n < 32 GROUP BY key) SELECT key, n, round(CASE WHEN dot < 0 THEN -y ELSE y END, 6) + 0.0 AS y FROM sig JOIN dt USING (key)")
def sign_align(spark, d):
    s = sig_emb(spark, d)
    f0 = S.peak(S.welch_psd(s, K, EMB_FS, EMB_N, lo=LO, hi=HI), K).select("key", "hz")
    return _y(C.sign_align(s, K, EMB_FS, f0, seconds=0.5), "key", "n")


@query("first_difference", f"{EMB}, x AS (SELECT key, n, y - lag(y) OVER (PARTITION BY key ORDER BY n) AS v FROM sig), s AS (SELECT key, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY key) SELECT key, n, round((v - m) / (d + 1e-9), 6) + 0.0 AS y FROM x JOIN s USING (key) WHERE v IS NOT NULL")
def first_difference(spark, d):
    return _y(C.innovations(sig_emb(spark, d), K), "key", "n")


EXT = "ext AS (SELECT key, n, y FROM sig UNION ALL SELECT key, -n, y FROM sig WHERE n BETWEEN 1 AND {k} UNION ALL SELECT key, 2 * 63 - n, y FROM sig WHERE n < 63 AND n >= 63 - {k})"


@query("even_extend", f"{EMB}, {EXT.format(k=5)} SELECT key, n, round(y, 6) + 0.0 AS y FROM ext")
def even_extend(spark, d):
    return _y(C.even_extend(sig_emb(spark, d), K, 5), "key", "n")


@query("moving_average", f"{EMB}, {EXT.format(k=5)}, m AS (SELECT key, n, sum(y) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 11 AS y FROM ext) SELECT key, n, round(y, 6) + 0.0 AS y FROM m WHERE n BETWEEN 0 AND 64")
def moving_average(spark, d):
    return _y(C.moving_average(sig_emb(spark, d), K, 5), "key", "n")


@query("ema", f"WITH RECURSIVE sig AS ({SIG_EMB}), e AS (SELECT key, n, y FROM sig WHERE n = 0 UNION ALL SELECT s.key, s.n, 0.88 * e.y + 0.12 * s.y FROM e JOIN sig s ON s.key = e.key AND s.n = e.n + 1) SELECT key, n, round(y, 6) + 0.0 AS y FROM e")
def ema(spark, d):
    return _y(C.ema(sig_emb(spark, d), K, 0.88), "key", "n")


@query("decimate", f"{EMB} SELECT key, CAST(n // 6 AS INT) AS n, round(y, 6) + 0.0 AS y, round(64 / 6.0, 6) AS fs FROM sig WHERE n % 6 = 0")
def decimate(spark, d):
    r = C.decimate(sig_emb(spark, d), 64.0, 10.0)
    return r.select("key", "n", digits(F.col("y")).alias("y"), digits(F.col("fs")).alias("fs"))


@query("sliding_windows", f"{EVT} SELECT key, w.win AS win, round(avg(y), 6) AS mean, count(*) AS c, round((48 / 2.0 + w.win * 12) / 24, 6) AS t_center FROM sig, range({(EVT_N - 48) // 12 + 1}) w(win) WHERE n >= w.win * 12 AND n < w.win * 12 + 48 GROUP BY ALL")
def sliding_windows(spark, d):
    w = C.sliding_windows(sig_evt(spark, d), K, 48, 12, EVT_FS)
    return w.groupBy("key", "win", "t_center").agg(digits(F.avg("y")).alias("mean"), F.count("*").alias("c")).select("key", "win", "mean", "c", digits(F.col("t_center")).alias("t_center"))


@query("pad_windows", f"WITH sig AS ({SIG_EMB}), ch AS (SELECT key // 3 AS roi, key % 3 AS channel, n, y FROM sig) SELECT roi, channel, n, round(y, 6) + 0.0 AS y FROM (SELECT * FROM ch UNION ALL SELECT roi, channel, -n, y FROM ch WHERE n BETWEEN 1 AND 16 UNION ALL SELECT roi, channel, 126 - n, y FROM ch WHERE n < 63 AND n >= 47)")
def pad_windows(spark, d):
    s = sig_emb(spark, d).select(F.floor(F.col("key") / 3).alias("roi"), (F.col("key") % 3).alias("channel"), "n", "y")
    return _y(C.even_extend(s, ["roi", "channel"], 32 // 2), "roi", "channel", "n")


@query("minmax_display", f"WITH j AS ({ES_GT}), s AS (SELECT key, avg(es) AS m1, stddev_pop(es) AS d1, avg(gt) AS m2, stddev_pop(gt) AS d2 FROM j GROUP BY key) SELECT key, n, round((es - m1) / (d1 + 1e-6), 6) + 0.0 AS es, round((gt - m2) / (d2 + 1e-6), 6) + 0.0 AS gt FROM j JOIN s USING (key)")
def minmax_display(spark, d):
    j = es_gt_emb(spark, d)
    r = C.minmax_display(j.select("key", "n", F.col("es").alias("y")), j.select("key", "n", F.col("gt").alias("y")), K)
    return r.select("key", "n", digits(F.col("es")).alias("es"), digits(F.col("gt")).alias("gt"))


STATS = ["mean", "std", "ptp", "energy", "abs_mean", "abs_std", "positive"]


@query("signal_stats", f"{EMB} SELECT key, round(avg(y), 6) + 0.0 AS mean, round(stddev_pop(y), 6) AS std, round(max(y) - min(y), 6) AS ptp, round(sum(y * y), 6) AS energy, round(avg(abs(y)), 6) AS abs_mean, round(stddev_pop(abs(y)), 6) AS abs_std, round(avg(CASE WHEN y >= 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM sig GROUP BY key")
def signal_stats(spark, d):
    return C.signal_stats(sig_emb(spark, d), K).select("key", *[digits(F.col(c)).alias(c) for c in STATS])


@query("dft_band", f"{EMB} SELECT key, CAST(k AS INT) AS k, round(sum(y * cos(2 * pi() * k * n / 64)), 6) + 0.0 AS re, round(sum(y * sin(2 * pi() * k * n / 64)), 6) + 0.0 AS im FROM sig, range(4, 17) t(k) GROUP BY ALL")
def dft_band(spark, d):
    r = S.dft(sig_emb(spark, d), K, 4, 16, EMB_N)
    return r.select("key", "k", digits(F.col("re")).alias("re"), digits(F.col("im")).alias("im"))


EVT_WELCH = welch_sql("sig", EVT_N, EVT_FS, 240, 120, 240, 5, 60)


@query("welch_psd", f"{EVT}, {EVT_WELCH} SELECT key, round(freq, 6) AS freq, round(power, 4) AS power FROM psd")
def welch_psd(spark, d):
    p = S.welch_psd(sig_evt(spark, d), K, EVT_FS, 240, lo=0.5, hi=6.0)
    return p.select("key", digits(F.col("freq")).alias("freq"), digits(F.col("power"), 4).alias("power"))


RPM_LO, RPM_HI = S.band_bins(0.5, 6.0, EVT_FS, 2048, closed=False)
RPM = welch_sql("sig", EVT_N, EVT_FS, 240, 216, 2048, RPM_LO, RPM_HI).replace("avg((re * re", "seg, ((re * re").replace("SELECT key, k * 24.0 / 2048 AS freq, seg, (", "SELECT key, seg, k * 24.0 / 2048 AS freq, (").replace("FROM psd_dft GROUP BY key, k)", "FROM psd_dft)")


def _rpm(spark, d):
    return S.welch_psd(sig_evt(spark, d), K, EVT_FS, 240, 216, 2048, 0.5, 6.0, closed=False, per_window=True)


@query("welch_rpm", f"{EVT}, {RPM} SELECT key, seg AS win, round(freq * 60, 4) AS rpm, round(power, 3) AS power FROM psd")
def welch_rpm(spark, d):
    return _rpm(spark, d).select("key", "win", digits(F.col("freq") * 60, 4).alias("rpm"), digits(F.col("power"), 3).alias("power"))


@query("peak_rpm", f"{EVT}, {RPM} SELECT key, seg AS win, round(arg_max(freq, {{'p': power, 'f': -freq}}) * 60, 4) AS rpm FROM psd GROUP BY key, seg")
def peak_rpm(spark, d):
    return S.peak(_rpm(spark, d), ["key", "win"]).select("key", "win", digits(F.col("hz") * 60, 4).alias("rpm"))


@query("select_component", f"{EVT}, {RPM}, p AS (SELECT seg AS win, key, max(power) AS top FROM psd GROUP BY ALL) SELECT win, key AS component, round(top, 3) AS top FROM p QUALIFY row_number() OVER (PARTITION BY win ORDER BY top DESC, key) = 1")
def select_component(spark, d):
    from pyspark.sql import Window

    p = S.peak(_rpm(spark, d), ["key", "win"])
    w = Window.partitionBy("win").orderBy(F.desc("power"), "key")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("win", F.col("key").alias("component"), digits(F.col("power"), 3).alias("top"))


CAND_W = f"{WELCH64}, {PEAK}, cw AS (SELECT key, hz, power / (m + 1e-9) AS ratio, greatest(0.0, least(5.0, power / (m + 1e-9) / 4)) AS confidence FROM pk)"
CAND_A = """ac AS (SELECT a.key, l.lag, sum(a.y * b.y) AS r FROM sig a, range(4, 16) l(lag), sig b WHERE b.key = a.key AND b.n = a.n + l.lag GROUP BY ALL),
 ca AS (SELECT key, arg_max(lag, {'r': r, 'l': -lag}) AS lag, max(r) / any_value(greatest(r0, 1e-9)) AS confidence FROM ac JOIN (SELECT key, sum(y * y) AS r0 FROM sig GROUP BY key) USING (key) GROUP BY key)"""


@query("welch_candidate", f"{EMB}, {CAND_W} SELECT key, round(hz, 6) AS hz, round(confidence, 6) AS confidence, round(ratio, 6) AS ratio FROM cw")
def welch_candidate(spark, d):
    r = S.welch_candidate(sig_emb(spark, d), K, EMB_FS, EMB_N, LO, HI)
    return r.select("key", *[digits(F.col(c)).alias(c) for c in ("hz", "confidence", "ratio")])


@query("autocorr_candidate", f"{EMB}, {CAND_A} SELECT key, CAST(lag AS INT) AS lag, round(64.0 / lag, 6) AS hz, round(confidence, 6) + 0.0 AS confidence FROM ca")
def autocorr_candidate(spark, d):
    r = S.autocorr_candidate(sig_emb(spark, d), K, EMB_FS, EMB_N, LO, HI)
    return r.select("key", "lag", digits(F.col("hz")).alias("hz"), digits(F.col("confidence")).alias("confidence"))


def candidates(s, total=EMB_N, fs=EMB_FS, lo=LO, hi=HI):
    w = S.welch_candidate(s, K, fs, total, lo, hi).select("key", "hz", "confidence", F.lit("welch").alias("label"))
    a = S.autocorr_candidate(s, K, fs, total, lo, hi).select("key", "hz", "confidence", F.lit("autocorr").alias("label"))
    return w.unionByName(a)


VOTE = f"""{CAND_W}, {CAND_A}, cand AS (SELECT key, hz, confidence, 'welch' AS label FROM cw UNION ALL SELECT key, 64.0 / lag, confidence, 'autocorr' FROM ca),
 vote AS (SELECT key, greatest(4.01, least(15.99, sum(hz * greatest(confidence, 1e-6)) / sum(greatest(confidence, 1e-6)))) AS hz, arg_max(hz, confidence) AS raw_hz,
   sum(greatest(confidence, 1e-6) * confidence) / sum(greatest(confidence, 1e-6)) AS confidence_weighted, max(confidence) AS confidence_max, count(*) AS votes FROM cand WHERE confidence > 0 AND hz > 0 GROUP BY key)"""


@query("coarse_frequency", f"{EMB}, {VOTE} SELECT key, round(hz, 6) AS hz, round(raw_hz, 6) AS raw_hz, round(confidence_weighted, 6) AS confidence_weighted, round(confidence_max, 6) AS confidence_max, CAST(votes AS INT) AS votes FROM vote")
def coarse_frequency(spark, d):
    r = S.coarse_frequency(candidates(sig_emb(spark, d)), K, LO, HI)
    return r.select("key", *[digits(F.col(c)).alias(c) for c in ("hz", "raw_hz", "confidence_weighted", "confidence_max")], F.size("candidates").alias("votes"))


@query("parabolic_peak", f"{EMB}, s AS (SELECT key, n, y AS b, lag(y) OVER w AS a, lead(y) OVER w AS c FROM sig WINDOW w AS (PARTITION BY key ORDER BY n)), p AS (SELECT key, unnest(arg_max({{'n': n, 'a': a, 'b': b, 'c': c}}, {{'b': b, 'n': -n}})) FROM s GROUP BY key), v AS (SELECT key, n, a, b, c, 0.5 * (a - c) / (a - 2 * b + c) + n AS x FROM p) SELECT key, round(x, 5) AS x, round(b - 0.25 * (a - c) * (x - n), 6) AS y FROM v")
def parabolic_peak(spark, d):
    r = S.parabolic_peak(sig_emb(spark, d), K, "n", "y")
    return r.select("key", digits(F.col("x"), 5).alias("x"), digits(F.col("y")).alias("y"))


@query("freq_autocorr", f"{EMB}, r AS (SELECT a.key, l.lag, sum(a.y * b.y) AS r FROM sig a, range(0, 64) l(lag), sig b WHERE b.key = a.key AND b.n = a.n + l.lag GROUP BY ALL), d AS (SELECT *, lead(r) OVER w AS c, lag(r) OVER w AS a FROM r WINDOW w AS (PARTITION BY key ORDER BY lag)), st AS (SELECT key, min(lag) AS start FROM d WHERE c > r GROUP BY key), p AS (SELECT d.key, unnest(arg_max({{'lag': lag, 'a': a, 'r': r, 'c': c}}, {{'r': r, 'l': -lag}})) FROM d JOIN st USING (key) WHERE lag >= start GROUP BY d.key) SELECT key, round(64 / (0.5 * (a - c) / (a - 2 * r + c) + lag), 5) AS hz FROM p")
def freq_autocorr(spark, d):
    return S.freq_autocorr(sig_emb(spark, d), K, EMB_FS, EMB_N).select("key", digits(F.col("hz"), 5).alias("hz"))


@query("freq_crossings", f"{EMB}, z AS (SELECT key, n, y, lead(y) OVER (PARTITION BY key ORDER BY n) AS e FROM sig), c AS (SELECT key, n - y / (e - y) AS pos FROM z WHERE y < 0 AND e >= 0) SELECT key, round(64.0 * (count(*) - 1) / (max(pos) - min(pos)), 5) AS hz FROM c GROUP BY key HAVING count(*) > 1")
def freq_crossings(spark, d):
    return S.freq_crossings(sig_emb(spark, d), K, EMB_FS).select("key", digits(F.col("hz"), 5).alias("hz"))


@query("freq_fft", f"{EMB}, w AS (SELECT key, n, y * (0.35875 - 0.48829 * cos(2 * pi() * n / 63) + 0.14128 * cos(4 * pi() * n / 63) - 0.01168 * cos(6 * pi() * n / 63)) AS v FROM sig), f AS (SELECT key, k, sum(v * cos(2 * pi() * k * n / 64)) AS re, sum(v * sin(2 * pi() * k * n / 64)) AS im FROM w, range(0, 33) t(k) GROUP BY ALL), m AS (SELECT key, k, sqrt(re * re + im * im) AS b FROM f), s AS (SELECT *, lag(b) OVER q AS a, lead(b) OVER q AS c FROM m WINDOW q AS (PARTITION BY key ORDER BY k)), p AS (SELECT key, unnest(arg_max({{'k': k, 'a': a, 'b': b, 'c': c}}, {{'b': b, 'k': -k}})) FROM s GROUP BY key) SELECT key, round((0.5 * (a - c) / (a - 2 * b + c) + k) * 64 / 64, 5) AS hz FROM p")
def freq_fft(spark, d):
    return S.freq_fft(sig_emb(spark, d), K, EMB_FS, EMB_N).select("key", digits(F.col("hz"), 5).alias("hz"))


FULL = welch_sql("sig", EMB_N, EMB_FS, 32, 16, 32, 0, 16)


def _full(spark, d):
    return S.welch_psd(sig_emb(spark, d), K, EMB_FS, 32)


@query("band_power_ratio", f"{EMB}, {FULL} SELECT key, round(sum(CASE WHEN freq BETWEEN 4 AND 16 THEN power ELSE 0 END) / sum(power), 6) AS ratio FROM psd GROUP BY key")
def band_power_ratio(spark, d):
    return S.band_power_ratio(_full(spark, d), K, (LO, HI), (0.0, 32.0)).select("key", digits(F.col("ratio")).alias("ratio"))


@query("snr_at_reference", f"{EMB}, {FULL} SELECT key, round(10 * log10(sum(CASE WHEN abs(freq - (4 + key % 9)) <= 3 THEN power ELSE 0 END) / sum(CASE WHEN abs(freq - (4 + key % 9)) > 3 THEN power ELSE 0 END)), 5) AS snr_db FROM psd GROUP BY key")
def snr_at_reference(spark, d):
    ref = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), (F.lit(4.0) + F.col("vec_id") % 9).alias("ref"))
    return S.snr_at_reference(_full(spark, d), ref, K, 3.0).select("key", digits(F.col("snr_db"), 5).alias("snr_db"))


@query("spectral_meta", f"{EMB}, {FULL} SELECT key, round(arg_max(freq, {{'p': power, 'f': -freq}}), 6) AS peak_hz, round(max(power) / (median(power) + 1e-9), 5) AS peak_ratio, round(10 * log10(max(power) + 1e-12), 5) AS peak_db, round(10 * log10(max(power) + 1e-12) - 10 * log10(median(power) + 1e-12), 5) AS prom_db, round((max(freq) - min(freq)) / (count(*) - 1), 6) AS mean_df FROM psd GROUP BY key")
def spectral_meta(spark, d):
    r = S.spectral_meta(_full(spark, d), K)
    return r.select("key", digits(F.col("peak_hz")).alias("peak_hz"), *[digits(F.col(c), 5).alias(c) for c in ("peak_ratio", "peak_db", "prom_db")], digits(F.col("mean_df")).alias("mean_df"))


PERIODOGRAM = "sp AS (SELECT key, k * 1.0 AS freq, sum(y * cos(2 * pi() * k * n / 64)) ** 2 + sum(y * sin(2 * pi() * k * n / 64)) ** 2 AS power FROM sig, range(0, 33) t(k) GROUP BY ALL)"
THD = f"""{PERIODOGRAM}, f0 AS (SELECT key, arg_max(freq, {{'p': power, 'f': -freq}}) AS f0 FROM sp WHERE freq BETWEEN 4 AND 10 GROUP BY key),
 thd AS (SELECT key, (arg_min(power, {{'d': abs(freq - 2 * f0), 'f': freq}}) + arg_min(power, {{'d': abs(freq - 3 * f0), 'f': freq}})) / (arg_min(power, {{'d': abs(freq - f0), 'f': freq}}) + 1e-9) AS thd FROM sp JOIN f0 USING (key) GROUP BY key)"""


def periodogram(s, total=EMB_N, fs=EMB_FS):
    p = S.dft(s, K, 0, total // 2, total)
    return p.select("key", (F.col("k") * F.lit(fs / total)).alias("freq"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


@query("thd", f"{EMB}, {THD} SELECT key, round(thd, 5) AS thd FROM thd")
def thd(spark, d):
    return S.thd(periodogram(sig_emb(spark, d)), K, 4.0, 10.0).select("key", digits(F.col("thd"), 5).alias("thd"))


@query("mean_spectrum", f"{EMB}, {FULL}, b AS (SELECT key, freq, power / max(power) OVER (PARTITION BY key) AS p FROM psd WHERE freq BETWEEN 4 AND 16), l AS (SELECT key, freq, p, lead(freq) OVER w AS f2, lead(p) OVER w AS p2 FROM b WINDOW w AS (PARTITION BY key ORDER BY freq)) SELECT key % 10 AS label, CAST(g AS BIGINT) AS g, round(avg(p + (p2 - p) * (4 + g * 0.5 - freq) / (f2 - freq)), 6) AS power FROM l, range(0, 25) t(g) WHERE f2 IS NOT NULL AND 4 + g * 0.5 >= freq AND 4 + g * 0.5 < f2 GROUP BY ALL")
def mean_spectrum(spark, d):
    p = _full(spark, d).withColumn("label", F.col("key") % 10)
    r = S.mean_spectrum(p, ["label", "key"], ["label"], LO, HI, 25)
    return r.select("label", "g", digits(F.col("power")).alias("power"))


def _multitaper_sql(width: int, stride: int, nw: float, k_lo: int, k_hi: int) -> str:
    """The tapers are numbers computed here; windows, transforms and their average are SQL."""
    tapers = S.slepian_tapers(width, nw, int(2 * nw) - 1)
    h = ", ".join(f"({k}, {i}, {float(v)!r}::DOUBLE)" for k, t in enumerate(tapers) for i, v in enumerate(t))
    return f"""{EVT}, h(taper, i, h) AS (VALUES {h}), w AS (SELECT key, win, n - win * {stride} AS i, y FROM sig, range({(EVT_N - width) // stride + 1}) r(win) WHERE n >= win * {stride} AND n < win * {stride} + {width}),
 c AS (SELECT key, win, i, y - avg(y) OVER (PARTITION BY key, win) AS y FROM w),
 d AS (SELECT key, win, taper, k, sum(y * h * cos(2 * pi() * k * i / {width})) AS re, sum(y * h * sin(2 * pi() * k * i / {width})) AS im FROM c JOIN h USING (i), range({k_lo}, {k_hi + 1}) b(k) GROUP BY ALL)
 SELECT key, round(({width / 2} + win * {stride}) / {EVT_FS}, 6) AS t_center, round(k * {EVT_FS} / {width}, 6) AS freq, round(avg(re * re + im * im) * 2 / {EVT_FS}, 4) AS power FROM d GROUP BY key, win, k"""


@query("multitaper_spectrogram", _multitaper_sql(96, 24, 3.0, 2, 24))
def multitaper_spectrogram(spark, d):
    r = S.multitaper_spectrogram(sig_evt(spark, d), K, EVT_FS, 96, 24, 3.0, 0.5, 6.0)
    return r.select("key", digits(F.col("t_center")).alias("t_center"), digits(F.col("freq")).alias("freq"), digits(F.col("power"), 4).alias("power"))
