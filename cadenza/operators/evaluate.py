"""Matching estimates with truth, error metrics, diagnostics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import finite
from cadenza.operators.conditioning import Keys
from cadenza.sources.shared import stored

METRICS = ["RMSE", "MAE", "MAPE", "MAX", "R", "CCC"]


def nearest_match(es: DataFrame, gt: DataFrame, keys: Keys, t: str = "t", idx: str = "idx", value: str = "v", slots: int | None = None) -> DataFrame:
    """Every estimate with the truth nearest in time (the lowest truth index on ties): keys, idx, t, es, gt, gt_idx.

    Truth is folded to one row per time and united with the estimates. Key and time are cut into slots, ranges of about
    equally many rows by sampled splitters, so a key that holds most of the rows is spread over as many tasks; within a
    slot one ordered window looks both ways. What a slot's borders hide, its last and first truth, is carried over: one
    row for a key and slot, filled along the key. No range join. Estimates of keys without truth get nulls. slots: how
    many (else as many as there are shuffle partitions).
    """
    one = gt.groupBy(*keys, t).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col(idx).alias("i"), F.col(value).alias("v")), idx).alias("g"))
    both = es.select(*keys, t, idx, F.col(value).alias("es"), F.lit(None).cast(one.schema["g"].dataType).alias("g"), F.lit(1).alias("side"))
    both = both.unionByName(one.select(*keys, t, F.lit(None).cast(dict(es.dtypes)[idx]).alias(idx), F.lit(None).cast(dict(es.dtypes)[value]).alias("es"), "g", F.lit(0).alias("side")))
    slots = slots or int(es.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that both readers see the same slots.
    dealt = stored(both.repartitionByRange(slots, *keys, t).withColumn("_slot", F.spark_partition_id()))
    border = dealt.groupBy(*keys, "_slot").agg(F.max_by("g", F.when(F.col("side") == 0, F.col(t))).alias("_last"), F.min_by("g", F.when(F.col("side") == 0, F.col(t))).alias("_first"))
    k = Window.partitionBy(*keys).orderBy("_slot")
    border = border.select(*keys, "_slot", F.last("_last", ignorenulls=True).over(k.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(k.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy(*keys, "_slot").orderBy(t, "side")
    before = F.last("g", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("g", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    m = dealt.withColumn("b", before).withColumn("a", after).where("side = 1")
    same = F.col("_slot") == F.col("_at")
    for i, c in enumerate(keys):  # keys may be null
        border, same = border.withColumnRenamed(c, f"_k{i}"), same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    m = m.join(border.withColumnRenamed("_slot", "_at"), same)
    m = m.withColumn("b", F.coalesce("b", "_before")).withColumn("a", F.coalesce("a", "_after"))
    db, da = F.col(t) - F.col("b.t"), F.col("a.t") - F.col(t)
    first = F.col("a.t").isNull() | (db < da) | ((db == da) & (F.col("b.i") <= F.col("a.i")))
    pick = F.when(F.col("b.t").isNotNull() & first, F.col("b")).otherwise(F.col("a"))
    return m.select(*keys, idx, t, "es", pick["v"].alias("gt"), pick["i"].alias("gt_idx"))


def positional_match(es: DataFrame, gt: DataFrame, keys: Keys) -> DataFrame:
    """Without times: equal places n."""
    return es.select(*keys, "n", F.col("y").alias("es")).join(gt.select(*keys, "n", F.col("y").alias("gt")), [*keys, "n"])


def estimate_vs_gt(pairs: DataFrame, relative: bool = False) -> DataFrame:
    """pairs with d = gt - es, or over gt (null where gt is 0)."""
    d = F.col("gt") - F.col("es")
    return pairs.withColumn("d", F.try_divide(d, F.col("gt")) if relative else d)


def rmse(es: Column, gt: Column) -> Column:
    return F.sqrt(F.avg((gt - es) * (gt - es)))


def mae(es: Column, gt: Column) -> Column:
    return F.avg(F.abs(gt - es))


def mape(es: Column, gt: Column) -> Column:
    return 100 * F.avg(F.abs(F.try_divide(gt - es, gt)))


def max_error(es: Column, gt: Column) -> Column:
    return F.max(F.abs(gt - es))


def _both(es: Column, gt: Column) -> tuple[Column, Column, Column]:
    ok = finite(es) & finite(gt)
    return F.when(ok, es), F.when(ok, gt), F.count(F.when(ok, F.lit(1)))


def _steady(a: Column, b: Column, n: Column) -> Column:
    return (n >= 2) & (F.stddev_pop(a) >= 1e-6) & (F.stddev_pop(b) >= 1e-6)


def pearson_guarded(es: Column, gt: Column) -> Column:
    """Correlation of the finite pairs; null below 2 pairs or where either side hardly varies."""
    a, b, n = _both(es, gt)
    return F.when(_steady(a, b, n), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def ccc_guarded(es: Column, gt: Column) -> Column:
    """Lin's concordance under the same guards."""
    a, b, n = _both(es, gt)
    shift = F.avg(a) - F.avg(b)
    return F.when(_steady(a, b, n), 2 * F.covar_pop(a, b) / (F.var_pop(a) + F.var_pop(b) + shift * shift))


_OF = {"RMSE": (rmse, 2), "MAE": (mae, 2), "MAPE": (mape, 2), "MAX": (max_error, None), "R": (pearson_guarded, 2), "CCC": (ccc_guarded, 2)}


def error_metrics(pairs: DataFrame, keys: Keys, metrics: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """keys and one column per metric, in one aggregation."""
    es, gt = F.col("es"), F.col("gt")
    out = []
    for m in metrics or METRICS:
        f, places = _OF[m]
        out.append((F.round(f(es, gt), places) if rounded and places is not None else f(es, gt)).alias(m))
    return pairs.groupBy(*keys).agg(*out)


def error_report(pairs: DataFrame, keys: Keys, metrics: list[str], rounded: bool = True) -> DataFrame:
    """keys, pos, metric, value: the metrics in the order asked for."""
    wide = error_metrics(pairs, keys, metrics, rounded)
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(metrics)])
    return wide.select(*keys, F.inline(rows))


def track_jerk(track: DataFrame, keys: Keys, t: str = "t", bpm: str = "bpm") -> DataFrame:
    """keys, jerk: median of the absolute steps in Hz over the median positive time step."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = track.select(*keys, F.abs((F.col(bpm) - F.lag(bpm).over(w)) / 60).alias("df"), (F.col(t) - F.lag(t).over(w)).alias("dt"))
    return s.groupBy(*keys).agg(F.try_divide(F.percentile("df", 0.5), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5)).alias("jerk"))


def median_of(values: Column) -> Column:
    """Median of an array's finite numbers, null without any."""
    s = F.array_sort(F.filter(values, finite))
    n = F.size(s)
    mid = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(s, mid) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def record_summary(records: DataFrame) -> DataFrame:
    """Per method over metric records: medians of per-record errors, mean R and SNR, mean saturation and NaN rate.

    A record's absolute errors are ae_bpm, else ae_hz x 60; edge saturation and NaN rate fall back along their names.
    """
    ae = F.coalesce(F.col("ae_bpm"), F.transform("ae_hz", lambda x: x * 60))
    stats = F.col("track_stats")
    r = records.select(
        "method", median_of(ae).alias("mae"), F.sqrt(F.aggregate(ae, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(ae), F.lit(0))).alias("rmse"), "r", "snr", "jerk",
        F.coalesce(stats["edge_saturation"], stats["track_frac_saturated"], stats["edge_sat"]).alias("edge_sat"), F.coalesce(stats["nan_rate"], stats["nan_frac"]).alias("nan_rate"),
    )
    return r.groupBy("method").agg(
        F.percentile("mae", 0.5).alias("mae"), F.percentile("rmse", 0.5).alias("rmse"), F.avg("r").alias("r"), F.percentile("snr", 0.5).alias("snr"),
        F.avg("edge_sat").alias("edge_sat"), F.avg("nan_rate").alias("nan_rate"), F.percentile("jerk", 0.5).alias("jerk"),
    )


#: The weights of the tuning objective.
WEIGHTS = {"mae_track": 0.35, "rmse_track": 0.35, "r_track": 0.1, "mae_med": 0.1, "rmse_med": 0.05, "r_med": 0.05}


def objective(terms: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the finite terms; correlations (names that begin with r_) count as 1 - r. No term at all: 0."""
    out = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        x = 1 - terms[name] if name.startswith("r_") else terms[name]
        out = out + F.coalesce(F.when(finite(x), w * x), F.lit(0.0))
    return out


def fwhm(psd: DataFrame, keys: Keys) -> DataFrame:
    """keys, fwhm: distance of the nearest bins below half the peak on either side of it (the band's end without one)."""
    p = psd.groupBy(*keys).agg(F.max_by("freq", F.struct("power", -F.col("freq"))).alias("f0"), F.max("power").alias("top"), F.min("freq").alias("lo"), F.max("freq").alias("hi"))
    j = psd.join(p, keys)
    low = F.max(F.when((F.col("freq") < F.col("f0")) & (F.col("power") < F.col("top") / 2), F.col("freq")))
    high = F.min(F.when((F.col("freq") > F.col("f0")) & (F.col("power") < F.col("top") / 2), F.col("freq")))
    return j.groupBy(*keys).agg((F.coalesce(high, F.first("hi")) - F.coalesce(low, F.first("lo"))).alias("fwhm"))


def quality_gate(stats: DataFrame, min_std_bpm: float = 0.3, min_unique: float = 0.05, max_saturation: float = 0.15, min_ratio: float = 1.2, min_prom_db: float = 3.0, max_fwhm: float = 0.6, soft_constant: bool = False, enabled: bool = True) -> DataFrame:
    """stats (std_bpm, unique_frac, saturation, peak_ratio, prom_db, fwhm) with reasons and ok. Null statistics pass."""
    tests = [("constant", F.col("std_bpm") < min_std_bpm), ("few_values", F.col("unique_frac") < min_unique), ("saturated", F.col("saturation") > max_saturation), ("low_peak", F.col("peak_ratio") < min_ratio), ("low_prominence", F.col("prom_db") < min_prom_db), ("wide_peak", F.col("fwhm") > max_fwhm)]
    reasons = F.array_compact(F.array(*[F.when(F.lit(enabled) & c, F.lit(n)) for n, c in tests]))
    bad = F.array_remove(reasons, "constant") if soft_constant else reasons
    return stats.withColumn("reasons", reasons).withColumn("ok", F.size(bad) == 0)


def qq_points(values: DataFrame, keys: Keys, value: str = "y") -> DataFrame:
    """keys, i, x, y: Filliben's positions through the inverse normal distribution against the ordered values."""
    w = Window.partitionBy(*keys).orderBy(value)
    s = values.select(*keys, F.row_number().over(w).alias("i"), F.col(value).alias("y"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return s.select(*keys, "i", inverse_normal(p).alias("x"), "y")


#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(c[0])
    for v in c[1:]:
        out = out * x + v
    return out


def inverse_normal(p: Column) -> Column:
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(q, _C) / (_poly(q, _D) * q + 1)
    c = p - 0.5
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(_poly(c * c, _A) * c / (_poly(c * c, _B) * c * c + 1))


def fit_line(points: DataFrame, keys: Keys) -> DataFrame:
    return points.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"))


def phase_portrait(signal: DataFrame, keys: Keys, most: int = 5000) -> DataFrame:
    """keys, n, x, x_next at every max(1, N // most)-th sample."""
    s = signal.withColumn("x_next", F.lead("y").over(Window.partitionBy(*keys).orderBy("n"))).join(signal.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("_step")), keys)
    return s.where((F.col("n") % F.col("_step") == 0) & F.col("x_next").isNotNull()).select(*keys, "n", F.col("y").alias("x"), "x_next")


def innovation_histogram(values: DataFrame, keys: Keys, bins: int, value: str = "y") -> DataFrame:
    """keys, bin, density over even bins from the least to the greatest value; the last bin is closed."""
    s = values.join(values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("_n")), keys)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("lo"), width)))
    return s.groupBy(*keys, F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.try_divide(F.count("*"), F.first("_n") * F.first(width)).alias("density"))


def report_merge(runs: DataFrame, metrics: list[str], by: Keys, prefer: str | None = None) -> DataFrame:
    """Median and deviation of each metric over runs; prefer: a flag whose rows stand for their (by, run) where set."""
    r = runs
    if prefer:
        w = Window.partitionBy(*by, "run").orderBy(F.desc(prefer))
        r = r.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    return r.groupBy(*by).agg(*[x for m in metrics for x in (F.percentile(m, 0.5).alias(f"{m}_med"), F.stddev_samp(m).alias(f"{m}_std"))])


def dataset_mean(trials: DataFrame, by: Keys, metrics: list[str]) -> DataFrame:
    return trials.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
