"""Queries of matching, metrics, ranking, strings and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.functions.scalars import digits
from cadenza.operators import conditioning as C
from cadenza.operators import evaluate as E
from cadenza.operators import ranking as R
from cadenza.operators import spectral as S
from cadenza.plans.registry import query
from cadenza.plans.signals import EMB, FULL, PERIODOGRAM, THD, periodogram
from cadenza.plans.views import EMB_FS, ES, ES_GT, GT, SIG_EMB, es_gt_emb, es_gt_evt, sig_emb, table
from cadenza.sources.files import upsert
from cadenza.sources.shared import shared_path

K = ["key"]


def _d(df, by, cols, places=6):
    return df.select(*by, *[digits(F.col(c), places).alias(c) for c in cols])


def nearest_sql(select: str) -> str:
    return f"""WITH es AS ({ES}), gt AS ({GT}), g1 AS (SELECT key, t, min(idx) AS i, arg_min(v, idx) AS v FROM gt GROUP BY key, t),
 b AS (SELECT es.key, es.idx, es.t, es.v AS es, g.t AS bt, g.i AS bi, g.v AS bv FROM es ASOF LEFT JOIN g1 g ON es.key = g.key AND es.t >= g.t),
 ab AS (SELECT b.*, g.t AS at_, g.i AS ai, g.v AS av FROM b ASOF LEFT JOIN g1 g ON b.key = g.key AND b.t <= g.t),
 m AS (SELECT key, idx, t, es, CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt < at_ - t OR (t - bt = at_ - t AND bi <= ai)) THEN bv ELSE av END AS gt,
   CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt < at_ - t OR (t - bt = at_ - t AND bi <= ai)) THEN bi ELSE ai END AS gt_idx FROM ab) {select}"""


def matched(spark, d):
    return E.nearest_match(*es_gt_evt(spark, d), K)


@query("nearest_match", nearest_sql("SELECT key, idx, round(es, 6) AS es, round(gt, 6) AS gt, gt_idx FROM m"))
def nearest_match(spark, d):
    return matched(spark, d).select("key", "idx", digits(F.col("es")).alias("es"), digits(F.col("gt")).alias("gt"), "gt_idx")


@query("estimate_vs_gt", nearest_sql("SELECT key, idx, round((gt - es) / nullif(gt, 0), 6) + 0.0 AS d FROM m"))
def estimate_vs_gt(spark, d):
    return _d(E.estimate_vs_gt(matched(spark, d), relative=True), ["key", "idx"], ["d"])


def _metric(name, sql, places=6):
    @query(name.lower() if name not in ("MAX", "R", "CCC") else {"MAX": "max_error", "R": "pearson_guarded", "CCC": "ccc_guarded"}[name], f"WITH j AS ({ES_GT}) SELECT key, round({sql}, {places}) + 0.0 AS v FROM j GROUP BY key")
    def run(spark, d):
        r = E.error_metrics(es_gt_emb(spark, d), K, [name], rounded=False)
        return r.select("key", digits(F.col(name), places).alias("v"))


_metric("RMSE", "sqrt(avg((gt - es) ** 2))")
_metric("MAE", "avg(abs(gt - es))")
_metric("MAPE", "100 * avg(abs((gt - es) / nullif(gt, 0)))", 3)
_metric("MAX", "max(abs(gt - es))")
PEARSON = "CASE WHEN count(*) >= 2 AND stddev_pop(es) >= 1e-6 AND stddev_pop(gt) >= 1e-6 THEN covar_pop(es, gt) / (stddev_pop(es) * stddev_pop(gt)) END"
CCC = "CASE WHEN count(*) >= 2 AND stddev_pop(es) >= 1e-6 AND stddev_pop(gt) >= 1e-6 THEN 2 * covar_pop(es, gt) / (var_pop(es) + var_pop(gt) + (avg(es) - avg(gt)) ** 2) END"
_metric("R", PEARSON)
_metric("CCC", CCC)


@query("error_report", nearest_sql(f"""SELECT key, pos, metric, round(value, 6) + 0.0 AS value FROM (SELECT key, unnest([0, 1, 2]) AS pos, unnest(['CCC', 'MAE', 'RMSE']) AS metric,
 unnest([{CCC.replace('count(*)', 'count(gt)').replace('(es)', '(CASE WHEN gt IS NOT NULL THEN es END)')}, avg(abs(gt - es)), sqrt(avg((gt - es) ** 2))]) AS value FROM m GROUP BY key)"""))
def error_report(spark, d):
    r = E.error_report(matched(spark, d), K, ["CCC", "MAE", "RMSE"], rounded=False)
    return r.select("key", "pos", "metric", digits(F.col("value")).alias("value"))


JERK = "jk AS (SELECT key, method, (n * 60 + 0.0) AS t, es * 30 + 60 AS bpm FROM j), st AS (SELECT key, abs(bpm - lag(bpm) OVER w) / 60 AS df, t - lag(t) OVER w AS dt FROM jk WINDOW w AS (PARTITION BY key ORDER BY t)), jr AS (SELECT key, median(df) / median(dt) FILTER (WHERE dt > 0) AS jerk FROM st GROUP BY key)"


def _jerk(spark, d):
    t = es_gt_emb(spark, d).select("key", (F.col("n") * 60.0).alias("t"), (F.col("es") * 30 + 60).alias("bpm"))
    return E.track_jerk(t, K)


@query("track_jerk", f"WITH j AS ({ES_GT}), {JERK} SELECT key, round(jerk, 8) AS jerk FROM jr")
def track_jerk(spark, d):
    return _d(_jerk(spark, d), K, ["jerk"], 8)


def records(spark, d):
    """One metric record per series: errors against the label's mean; every third has them in Hz only."""
    j = es_gt_emb(spark, d).withColumn("ae", F.abs(F.col("gt") - F.col("es")))
    r = j.groupBy("method", "key").agg(F.array_sort(F.collect_list("ae")).alias("ae"), E.pearson_guarded(F.col("es"), F.col("gt")).alias("r"), F.avg("es").alias("snr"))
    third = F.col("key") % 3 == 0
    stats = F.when(third, F.create_map(F.lit("track_frac_saturated"), F.col("key") % 5 / 10.0)).otherwise(F.create_map(F.lit("edge_saturation"), F.col("key") % 7 / 10.0, F.lit("nan_rate"), F.col("key") % 4 / 8.0))
    r = r.join(_jerk(spark, d), "key")
    return r.select("method", "key", F.when(~third, F.col("ae")).alias("ae_bpm"), F.when(third, F.transform("ae", lambda x: x / 60)).alias("ae_hz"), "r", "snr", "jerk", stats.alias("track_stats"))


SUMMARY = f"""{JERK}, rc AS (SELECT method, key, median(abs(gt - es)) AS mae, sqrt(avg((gt - es) ** 2)) AS rmse, {PEARSON} AS r, avg(es) AS snr, CASE WHEN key % 3 = 0 THEN key % 5 / 10.0 ELSE key % 7 / 10.0 END AS edge_sat,
  CASE WHEN key % 3 = 0 THEN NULL ELSE key % 4 / 8.0 END AS nan_rate FROM j GROUP BY method, key),
 su AS (SELECT method, median(mae) AS mae, median(rmse) AS rmse, avg(r) AS r, median(snr) AS snr, avg(edge_sat) AS edge_sat, avg(nan_rate) AS nan_rate, median(jerk) AS jerk FROM rc JOIN jr USING (key) GROUP BY method)"""
SUMS = ["mae", "rmse", "r", "snr", "edge_sat", "nan_rate", "jerk"]


@query("record_summary", f"WITH j AS ({ES_GT}), {SUMMARY} SELECT method, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in SUMS)} FROM su")
def record_summary(spark, d):
    return _d(E.record_summary(records(spark, d)), ["method"], SUMS)


@query("objective", f"WITH j AS ({ES_GT}), {SUMMARY} SELECT method, round(0.35 * mae + 0.35 * rmse + 0.1 * (1 - r) + 0.1 * mae, 6) + 0.0 AS objective FROM su")
def objective(spark, d):
    s = E.record_summary(records(spark, d))
    none = F.lit(None).cast("double")
    terms = {"mae_track": F.col("mae"), "rmse_track": F.col("rmse"), "r_track": F.col("r"), "mae_med": F.col("mae"), "rmse_med": none, "r_med": F.lit(float("nan"))}
    return s.select("method", digits(E.objective(terms)).alias("objective"))


FWHM = "pk AS (SELECT key, arg_max(freq, {'p': power, 'f': -freq}) AS f0, max(power) AS top, min(freq) AS lo, max(freq) AS hi FROM psd GROUP BY key), fw AS (SELECT key, coalesce(min(CASE WHEN freq > f0 AND power < top / 2 THEN freq END), any_value(hi)) - coalesce(max(CASE WHEN freq < f0 AND power < top / 2 THEN freq END), any_value(lo)) AS fwhm FROM psd JOIN pk USING (key) GROUP BY key)"


def _psd(spark, d):
    return S.welch_psd(sig_emb(spark, d), K, EMB_FS, 32)


@query("fwhm", f"{EMB}, {FULL}, {FWHM} SELECT key, round(fwhm, 6) AS fwhm FROM fw")
def fwhm(spark, d):
    return _d(E.fwhm(_psd(spark, d), K), K, ["fwhm"])


@query("quality_gate", f"""{EMB}, {FULL}, {FWHM}, me AS (SELECT key, max(power) / (median(power) + 1e-9) AS ratio, 10 * log10(max(power) + 1e-12) - 10 * log10(median(power) + 1e-12) AS prom FROM psd GROUP BY key),
 tr AS (SELECT key, stddev_pop(y) * 2 AS sd, count(DISTINCT y) / 64.0 AS uq, avg(CASE WHEN abs(y) > 0.2 THEN 1.0 ELSE 0 END) AS sat FROM sig GROUP BY key)
 SELECT key, concat_ws(',', CASE WHEN sd < 0.24 THEN 'constant' END, CASE WHEN uq < 0.05 THEN 'few_values' END, CASE WHEN sat > 0.15 THEN 'saturated' END, CASE WHEN ratio < 2.5 THEN 'low_peak' END, CASE WHEN prom < 4 THEN 'low_prominence' END, CASE WHEN fwhm > 6 THEN 'wide_peak' END) AS reasons,
 NOT (uq < 0.05 OR sat > 0.15 OR ratio < 2.5 OR prom < 4 OR fwhm > 6) AS ok FROM fw JOIN me USING (key) JOIN tr USING (key)""")
def quality_gate(spark, d):
    psd = _psd(spark, d)
    s = S.spectral_meta(psd, K).join(E.fwhm(psd, K), "key")
    t = sig_emb(spark, d).groupBy("key").agg((F.stddev_pop("y") * 2).alias("std_bpm"), (F.countDistinct("y") / 64).alias("unique_frac"), F.avg((F.abs("y") > 0.2).cast("double")).alias("saturation"))
    g = E.quality_gate(s.join(t, "key"), min_std_bpm=0.24, min_ratio=2.5, min_prom_db=4.0, max_fwhm=6.0, soft_constant=True)
    return g.select("key", F.array_join("reasons", ",").alias("reasons"), "ok")


@query("noise_diagnostics", f"""{EMB}, {THD}, k AS (SELECT key, any_value(method) AS method, kurtosis_pop(y) AS kurt, avg(y) AS m, stddev_pop(y) AS s FROM sig GROUP BY key),
 im AS (SELECT key, avg(CASE WHEN abs((y - m) / (s + 1e-8)) > 3 THEN 1.0 ELSE 0 END) AS impulse FROM sig JOIN k USING (key) GROUP BY key),
 df AS (SELECT key, y - lag(y) OVER (PARTITION BY key ORDER BY n) AS v FROM sig), dk AS (SELECT key, kurtosis_pop(v) AS ik FROM df WHERE v IS NOT NULL GROUP BY key)
 SELECT method, round(avg(kurt), 5) + 0.0 AS kurtosis, round(avg(thd), 5) AS thd, round(avg(impulse), 6) AS impulse, round(avg(ik), 5) + 0.0 AS innovation_kurtosis FROM k JOIN thd USING (key) JOIN im USING (key) JOIN dk USING (key) GROUP BY method""")
def noise_diagnostics(spark, d):
    r = diagnostics(sig_emb(spark, d))
    return r.select("method", digits(F.col("kurtosis"), 5).alias("kurtosis"), digits(F.col("thd"), 5).alias("thd"), digits(F.col("impulse")).alias("impulse"), digits(F.col("innovation_kurtosis"), 5).alias("innovation_kurtosis"))


def diagnostics(s):
    """Per method the means over its series of kurtosis, harmonic distortion, impulse rate and innovation kurtosis."""
    z = C.zscore(s, K)
    per = s.groupBy("key", "method").agg(F.kurtosis("y").alias("kurtosis")).join(S.thd(periodogram(s), K, 4.0, 10.0), "key")
    per = per.join(z.groupBy("key").agg(F.avg((F.abs("y") > 3).cast("double")).alias("impulse")), "key")
    per = per.join(C.first_difference(z, K).groupBy("key").agg(F.kurtosis("y").alias("innovation_kurtosis")), "key")
    return E.dataset_mean(per, ["method"], ["kurtosis", "thd", "impulse", "innovation_kurtosis"])


@query("regime_map", f"{EMB}, {THD}, k AS (SELECT key, any_value(method) AS method, kurtosis_pop(y) AS kurt FROM sig GROUP BY key) SELECT method, CASE WHEN avg(kurt) > 3 THEN 'robust' ELSE 'gaussian' END AS r, CASE WHEN avg(thd) > 0.5 THEN 'harmonic' ELSE 'single' END AS h, CASE WHEN any_value(i.impulse) > 0.01 THEN 'damped' ELSE 'plain' END AS q, 0.05 AS dt FROM k JOIN thd USING (key) JOIN (SELECT method, avg(imp) AS impulse FROM (SELECT key, any_value(method) AS method, avg(CASE WHEN abs((y - m) / (s + 1e-8)) > 3 THEN 1.0 ELSE 0 END) AS imp FROM sig JOIN (SELECT key, avg(y) AS m, stddev_pop(y) AS s FROM sig GROUP BY key) USING (key) GROUP BY key) GROUP BY method) i USING (method) GROUP BY method")
def regime_map(spark, d):
    return R.regime_map(diagnostics(sig_emb(spark, d)), 20.0)


def _horner(x: str, c: tuple[float, ...]) -> str:
    out = f"{c[0]}::DOUBLE"
    for v in c[1:]:
        out = f"({out} * {x} + {v}::DOUBLE)"
    return out


# The inverse normal distribution in the lower half, mirrored into the upper one.
QUANTILE = f"""oi AS (SELECT key, y, row_number() OVER (PARTITION BY key ORDER BY y) AS i, count(*) OVER (PARTITION BY key) AS n FROM sig),
 pp AS (SELECT key, y, i, CASE WHEN i = n THEN 0.5 ** (1.0 / n) WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM oi),
 lw AS (SELECT *, least(p, 1 - p) AS u, sqrt(-2 * ln(least(p, 1 - p))) AS q, (least(p, 1 - p) - 0.5) ** 2 AS c FROM pp),
 qn AS (SELECT key, i, y, CASE WHEN p > 0.5 THEN -1 ELSE 1 END * CASE WHEN u < 0.02425 THEN {_horner("q", E._C)} / ({_horner("q", E._D)} * q + 1)
  ELSE {_horner("c", E._A)} * (u - 0.5) / ({_horner("c", E._B)} * c + 1) END AS x FROM lw)"""


@query("qq_points", f"{EMB}, {QUANTILE} SELECT key, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM qn")
def qq_points(spark, d):
    return _d(E.qq_points(sig_emb(spark, d), K), ["key", "i"], ["x", "y"])


@query("phase_portrait", f"{EMB} SELECT key, n, round(y, 6) + 0.0 AS x, round(nx, 6) + 0.0 AS x_next FROM (SELECT key, n, y, lead(y) OVER (PARTITION BY key ORDER BY n) AS nx FROM sig) WHERE n % 4 = 0 AND nx IS NOT NULL")
def phase_portrait(spark, d):
    return _d(E.phase_portrait(sig_emb(spark, d), K, 16), ["key", "n"], ["x", "x_next"])


@query("innovation_histogram", f"{EMB}, df AS (SELECT method, y - lag(y) OVER (PARTITION BY key ORDER BY n) AS v FROM sig), s AS (SELECT method, min(v) AS lo, max(v) AS hi, count(v) AS n FROM df GROUP BY method) SELECT method, CAST(least(9, floor((v - lo) / ((hi - lo) / 10))) AS INT) AS bin, round(count(*) / (any_value(n) * any_value((hi - lo) / 10)), 6) AS density FROM df JOIN s USING (method) WHERE v IS NOT NULL GROUP BY ALL")
def innovation_histogram(spark, d):
    h = E.innovation_histogram(C.first_difference(sig_emb(spark, d), K), ["method"], 10)
    return h.select("method", "bin", digits(F.col("density")).alias("density"))


@query("report_merge", "WITH r AS (SELECT p_brand AS method, p_type AS run, p_size AS mae, p_retailprice AS rmse, p_partkey % 5 = 0 AS uniq FROM part), p AS (SELECT * FROM r QUALIFY rank() OVER (PARTITION BY method, run ORDER BY uniq DESC) = 1) SELECT method, median(mae) AS mae_med, round(stddev_samp(mae), 5) AS mae_std, round(median(rmse), 5) AS rmse_med, round(stddev_samp(rmse), 5) AS rmse_std FROM p GROUP BY method")
def report_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_type").alias("run"), F.col("p_size").alias("mae"), F.col("p_retailprice").alias("rmse"), (F.col("p_partkey") % 5 == 0).alias("uniq"))
    return _d(E.report_merge(p, ["mae", "rmse"], ["method"], "uniq"), ["method"], ["mae_med", "mae_std", "rmse_med", "rmse_std"], 5)


@query("dataset_mean", "SELECT p_brand AS method, round(avg(p_size), 6) AS mae, round(avg(p_retailprice), 5) AS rmse FROM part GROUP BY p_brand")
def dataset_mean(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_size").alias("mae"), F.col("p_retailprice").alias("rmse"))
    r = E.dataset_mean(p, ["method"], ["mae", "rmse"])
    return r.select("method", digits(F.col("mae")).alias("mae"), digits(F.col("rmse"), 5).alias("rmse"))


def trial_log(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_type").alias("family"), F.col("p_partkey").alias("trial"), F.col("p_retailprice").alias("objective"), F.col("p_size").alias("mae"), (F.col("p_size") / 50.0).alias("r"), (F.col("p_partkey") % 13).alias("snr"))


LOG = "lg AS (SELECT p_brand AS method, p_type AS family, p_partkey AS trial, p_retailprice AS objective, p_size AS mae, p_size / 50.0 AS r, p_partkey % 13 AS snr FROM part), best AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY method ORDER BY objective, trial) = 1)"


@query("best_trial", f"WITH {LOG} SELECT method, trial, round(objective, 4) AS objective FROM best")
def best_trial(spark, d):
    return R.best_trial(trial_log(spark, d), ["method"]).select("method", "trial", digits(F.col("objective"), 4).alias("objective"))


@query("leaderboard", f"WITH {LOG} SELECT method, trial, CAST(rank() OVER (ORDER BY objective, mae, r DESC, snr DESC) AS INT) AS rank FROM best")
def leaderboard(spark, d):
    return R.leaderboard(R.best_trial(trial_log(spark, d), ["method"])).select("method", "trial", "rank")


@query("method_order", "WITH o AS (SELECT s_name, s_suppkey FROM supplier), k AS (SELECT 'm' || n_nationkey AS method, n_nationkey AS pos FROM nation WHERE n_nationkey < 20) SELECT c_custkey AS key, 'm' || c_nationkey AS method, coalesce(pos, 20) AS pos FROM customer LEFT JOIN k ON k.method = 'm' || c_nationkey")
def method_order(spark, d):
    order = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("m"), "n_nationkey").alias("method"), F.col("n_nationkey").alias("pos"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("m"), "c_nationkey").alias("method"))
    return R.method_order(c, order).select("key", "method", "pos")


METHODS = "m AS (SELECT p_partkey AS pos, split_part(p_type, ' ', 1) || '_' || split_part(p_type, ' ', 2) || '__' || lower(replace(p_brand, '#', '')) AS method FROM part)"


def methods(spark, d):
    base = F.concat_ws("_", F.split_part("p_type", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(2)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(base, F.lit("__"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("method"))


@query("shard_assign", f"WITH {METHODS}, b AS (SELECT split_part(method, '__', 1) AS base, min(pos) AS first FROM m GROUP BY 1), s AS (SELECT base, CAST((dense_rank() OVER (ORDER BY first) - 1) % 3 AS INT) AS shard FROM b) SELECT pos, method, shard FROM m JOIN s ON s.base = split_part(method, '__', 1)")
def shard_assign(spark, d):
    return R.shard_assign(methods(spark, d), 3).select("pos", "method", "shard")


@query("bundle_manifest", f"WITH {LOG}, f AS (SELECT method, family, 'runs/' || trial || '.parquet' AS path, mae AS size FROM lg QUALIFY row_number() OVER (PARTITION BY method, family ORDER BY objective, trial) = 1) SELECT family, string_agg(method || '=' || path, ';' ORDER BY method) AS bundle, sum(size) AS size FROM f WHERE lower(method) IN (SELECT lower(p_brand) FROM part WHERE p_size < 3) GROUP BY family")
def bundle_manifest(spark, d):
    best = R.best_trial(trial_log(spark, d), ["method", "family"]).select("method", "family", F.concat(F.lit("runs/"), "trial", F.lit(".parquet")).alias("path"), F.col("mae").alias("size"))
    allowed = table(spark, d, "part").where("p_size < 3").select(F.upper("p_brand").alias("allowed")).distinct()
    b = R.bundle_manifest(best, allowed, ["family"])
    return b.select("family", F.array_join(F.transform(F.map_entries("bundle"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("bundle"), "size")


@query("sample_head", "SELECT p_brand AS dataset, p_partkey AS trial FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3")
def sample_head(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("trial"))
    return R.sample_head(p, ["dataset"], "trial", 3)


@query("ordered_dedupe", "SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name FROM events QUALIFY row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id) = 1")
def ordered_dedupe(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"))
    return R.ordered_dedupe(e, "name", "pos")


@query("method_family", f"WITH {METHODS}, f AS (SELECT pos, method AS name, CASE WHEN method LIKE '%1' THEN 'kf' WHEN method LIKE '%2' THEN 'ukf' WHEN method LIKE '%3' THEN 'pll' END AS family FROM m) SELECT pos, name, family FROM f WHERE family IS NOT NULL AND lower(name) LIKE 'standard%' QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY pos) = 1")
def method_family(spark, d):
    m = methods(spark, d).withColumnRenamed("method", "name")
    allowed = m.where(F.lower("name").startswith("standard")).select(F.upper("name").alias("allowed")).distinct()
    return R.method_family(m, {"1": "kf", "2": "ukf", "3": "pll"}, allowed).select("pos", "name", "family")


@query("run_suffix", "WITH t AS (SELECT p_size AS run, p_partkey AS pos, lower(replace(p_brand, '#', '')) AS tok FROM part), f AS (SELECT run, tok, min(pos) AS p FROM t GROUP BY run, tok), j AS (SELECT run, string_agg(tok, '_' ORDER BY p) AS s, count(*) AS n FROM f GROUP BY run) SELECT run, CASE WHEN length(s) > 64 THEN n || 'm_' || substr(sha1(s), 1, 10) ELSE s END AS suffix FROM j")
def run_suffix(spark, d):
    t = table(spark, d, "part").select(F.col("p_size").alias("run"), F.col("p_partkey").alias("pos"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("tok"))
    return R.run_suffix(t, ["run"], "tok", "pos")


@query("pending_only", "SELECT o_orderkey AS trial FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3)")
def pending_only(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("string").alias("output"))
    return R.pending_only(table(spark, d, "orders").select(F.col("o_orderkey").alias("trial")), done, ["1", "2", "3"], "trial")


@query("preferred_file", "SELECT l_orderkey AS trial, l_shipmode_ AS file FROM (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'data.mkv' WHEN 3 THEN 'data.avi' WHEN 4 THEN 'data.cfr.avi' ELSE 'other' END AS l_shipmode_ FROM lineitem) WHERE l_shipmode_ LIKE 'data%' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position(['data.cfr.avi', 'data.avi', 'data.mkv'], l_shipmode_)) = 1")
def preferred_file(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {1: "notes.txt", 2: "data.mkv", 3: "data.avi", 4: "data.cfr.avi"}.items() for x in kv])
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trial"), F.coalesce(names[F.col("l_linenumber")], F.lit("other")).alias("file"))
    return R.preferred_file(files, ["trial"], ["data.cfr.avi", "data.avi", "data.mkv"])


@query("upsert_estimates", "SELECT p_partkey AS trial, CASE WHEN p_size > 25 THEN 'kf' ELSE 'dof' END AS method, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 ELSE p_size END AS rate FROM part UNION ALL SELECT p_partkey, 'new', p_size * 2 FROM part WHERE p_partkey % 3 = 1")
def upsert_estimates(spark, d):
    p = table(spark, d, "part")
    method = F.when(F.col("p_size") > 25, "kf").otherwise("dof")
    old = p.select(F.col("p_partkey").alias("trial"), method.alias("method"), F.col("p_size").alias("rate"))
    new = p.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("trial"), F.when(F.col("p_partkey") % 3 == 1, "new").otherwise(method).alias("method"), (F.col("p_size") * 2).alias("rate"))
    path = shared_path(spark, "estimates")
    order = spark.createDataFrame([("dof", 0), ("kf", 1)], "method string, pos int")
    for rows in (old, new, new):  # the second time changes nothing
        out = upsert(rows, path, ["trial", "method"], ["method"], order)
    return out.select("trial", "method", "rate")


@query("obs_cache_join", "SELECT c_custkey AS key, coalesce(round(s_acctbal, 4), -1.0) AS obs, s_acctbal IS NOT NULL AS cached FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def obs_cache_join(spark, d):
    cache = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), digits(F.col("s_acctbal"), 4).alias("obs"))
    return R.obs_cache_join(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), cache, ["key"], "obs", F.lit(-1.0))


@query("override_lookup", f"WITH {METHODS}, p AS (SELECT method, max(pos) AS qx FROM m WHERE pos % 4 = 0 GROUP BY method), h AS (SELECT split_part(method, '__', 2) AS head, min(pos) AS qx FROM m WHERE pos % 2 = 0 GROUP BY 1) SELECT m.pos, m.method, coalesce(p.qx, h.qx) AS qx FROM m LEFT JOIN p ON p.method = m.method LEFT JOIN h ON h.head = split_part(m.method, '__', 2)")
def override_lookup(spark, d):
    m = methods(spark, d).withColumn("dataset", F.lit("a"))
    exact = m.where("pos % 4 = 0").groupBy("dataset", "method").agg(F.max("pos").alias("qx"))
    head = m.where("pos % 2 = 0").groupBy("dataset", F.split_part("method", F.lit("__"), F.lit(2)).alias("method")).agg(F.min("pos").alias("qx"))
    return R.override_lookup(m, exact.unionByName(head), "qx").select("pos", "method", "qx")


@query("missing_methods", "SELECT DISTINCT p_brand AS method FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_partkey % 40 = 0)")
def missing_methods(spark, d):
    p = table(spark, d, "part")
    return R.missing_methods(p.select(F.col("p_brand").alias("method")).distinct(), p.where("p_partkey % 40 = 0").select(F.upper("p_brand").alias("method")))


@query("natural_sort", "SELECT c_custkey AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS r FROM customer")
def natural_sort(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey", F.concat(F.lit("Customer"), "c_custkey", F.lit("x")).alias("name"))
    return c.select("key", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(X.natural_key(F.col("name")))).alias("r"))


@query("method_token", "WITH t AS (SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN ' DOF ' WHEN 1 THEN 'Farneback' WHEN 2 THEN 'profile1D-Cubic' WHEN 3 THEN 'profile1d quadratic' ELSE p_type END AS s FROM part) SELECT key, CASE key % 5 WHEN 0 THEN 'dof' WHEN 1 THEN 'of_farneback' WHEN 2 THEN 'profile1d_cubic' WHEN 3 THEN 'profile1d_quadratic' ELSE replace(replace(lower(trim(s)), ' ', '_'), '-', '_') END AS token FROM t")
def method_token(spark, d):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, " DOF ").when(k == 1, "Farneback").when(k == 2, "profile1D-Cubic").when(k == 3, "profile1d quadratic").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), X.method_token(s).alias("token"))


@query("sanitize_label", r"SELECT p_partkey AS key, nullif(regexp_replace(regexp_replace(p_brand || ' ' || p_name || '/' , '[^\p{L}\p{N}_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), '') AS label FROM part")
def sanitize_label(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), X.sanitize_label(F.concat("p_brand", F.lit(" "), "p_name", F.lit("/"))).alias("label"))


@query("split_method", f"WITH {METHODS} SELECT pos, split_part(method, '__', 1) AS base, split_part(method, '__', 2) AS head FROM m")
def split_method(spark, d):
    base, head = X.split_method(F.col("method"))
    return methods(spark, d).select("pos", base.alias("base"), head.alias("head"))


@query("dataset_of", "SELECT doc_id AS key, CASE doc_id % 3 WHEN 0 THEN lower(source) WHEN 1 THEN 'set' || (doc_id % 7) ELSE 'unknown' END AS dataset FROM documents")
def dataset_of(spark, d):
    k = F.col("doc_id") % 3
    file = F.when(k == 1, F.concat(F.lit("/a/b/SET"), F.col("doc_id") % 7, F.lit("_x.pkl"))).when(k == 2, F.lit("/a/_x.pkl"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), X.dataset_of([F.when(k == 0, F.upper("source")), F.lit("")], file).alias("dataset"))


@query("json_meta", "SELECT event_id AS key, json_extract_string(props, '$.k') AS k, length(CAST(event_id AS VARCHAR)) AS n FROM events")
def json_meta(spark, d):
    e = table(spark, d, "events")
    meta = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("k")))
    back = F.from_json(meta, "id string, k string")
    return e.select(F.col("event_id").alias("key"), back["k"].alias("k"), F.length(back["id"]).cast("bigint").alias("n"))


@query("pll_gains", "WITH s AS (SELECT event_id AS key, greatest(value, 0) AS snr FROM events), g AS (SELECT key, 2 * pi() * greatest(0.2, least(2.0, ln(1 + snr) / ln(10))) / 7 AS w FROM s) SELECT key, round(greatest(2 * 0.9 * w / 20, 0), 8) AS kp, round(greatest(w * w / 400, 0), 8) AS ki FROM g")
def pll_gains(spark, d):
    kp, ki = X.pll_gains(F.col("value"), F.lit(20.0))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), digits(kp, 8).alias("kp"), digits(ki, 8).alias("ki"))


@query("param_overlay", """WITH f AS (SELECT p_brand AS dataset, p_type AS method, p_size AS s FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1)
 SELECT dataset, method, CASE WHEN s % 2 = 0 THEN s * 10 ELSE s END AS qx, s + 1 AS rv FROM f""")
def param_overlay(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))).where("r = 1")
    size = F.col("p_size")
    rows = F.array(F.struct(F.lit(0).alias("prio"), F.lit("qx").alias("path"), size.alias("value")), F.struct(F.lit(1).alias("prio"), F.lit("qx").alias("path"), F.when(size % 2 == 0, size * 10).alias("value")), F.struct(F.lit(2).alias("prio"), F.lit("rv").alias("path"), (size + 1).alias("value")))
    return R.param_overlay(p.select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("method"), F.inline(rows)), ["qx", "rv"])


@query("clamp_overrides", "SELECT p_partkey AS key, CASE WHEN p_size > 5 THEN greatest(1e-7, least(5e-4, p_size * 2e-5)) ELSE p_size - 5.0 END AS qx, greatest(0.015, least(0.15, p_size / 200.0)) AS rv, greatest(1e-7, least(1e-3, p_size * 4e-5)) AS qf, CASE WHEN p_size % 2 = 0 THEN 0.88 ELSE 0.0 END AS alpha FROM part")
def clamp_overrides(spark, d):
    s = F.col("p_size")
    qx, rv, qf = X.clamp_overrides(F.when(s > 5, s * F.lit(2e-5)).otherwise(s - 5.0), s / 200.0, s * F.lit(4e-5))
    alpha = X.default_smoothing(F.lit(0.0), F.when(s % 2 == 0, "kfstd").otherwise("other"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), qx.alias("qx"), rv.alias("rv"), qf.alias("qf"), alpha.alias("alpha"))


@query("autotune_stats", "SELECT event_type AS dataset, CAST(user_id % 5 AS VARCHAR) AS method, count(*) AS count, round(sum(value), 4) AS sum_mad, sum(user_id) AS sum_snr, sum(event_id) AS sum_freq, round(max(value), 4) AS max_sigma FROM events GROUP BY ALL")
def autotune_stats(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).cast("string").alias("method"), F.col("value").alias("mad"), F.col("user_id").alias("snr"), F.col("event_id").alias("freq"))
    old, new = R.autotune_stats(e.where("freq % 3 = 0")), R.autotune_stats(e.where("freq % 3 > 0"))
    m = R.autotune_merge(old, new)
    return m.select("dataset", "method", "count", digits(F.col("sum_mad"), 4).alias("sum_mad"), "sum_snr", "sum_freq", digits(F.col("max_sigma"), 4).alias("max_sigma"))
