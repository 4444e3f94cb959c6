"""Conditioning of long signals (keys, n, y): grids, trends, scales, windows. Built-in functions, but for the
recursion of ema, which scans its chunks.

Statistics of a key are one aggregation joined back, so a long key is summed map-side and never gathered; windows use
one partitioning and order, so chained ones share a shuffle and a sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import clip, finite
from cadenza.operators import scans, selection

Keys = list[str]


def _by_n(keys: Keys):
    return Window.partitionBy(*keys).orderBy("n")


def regular_grid(df: DataFrame, keys: Keys, ts: str, value: str, origin: str, step: int, size: int, fill: float | None = 0.0) -> DataFrame:
    """Timestamped rows summed into size buckets of step seconds from origin; empty buckets get fill."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp_ntz").cast("timestamp"))
    sums = df.select(*keys, F.floor(at / F.lit(step * 1_000_000)).cast("int").alias("n"), value).groupBy(*keys, "n").agg(F.sum(value).alias("y"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("n"))
    return grid.join(sums, [*keys, "n"], "left").select(*keys, "n", F.coalesce("y", F.lit(fill)).alias("y"))


def clean(signal: DataFrame, drop: bool = False) -> DataFrame:
    """NaN becomes 0; or (drop) what is not finite goes."""
    return signal.where(finite(F.col("y"))) if drop else signal.withColumn("y", F.nanvl(F.coalesce("y", F.lit(0.0)), F.lit(0.0)))


def with_stats(signal: DataFrame, keys: Keys, **stats: Column) -> DataFrame:
    """Every row with its key's aggregates."""
    return signal.join(signal.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def detrend_linear(signal: DataFrame, keys: Keys) -> DataFrame:
    """Minus the least-squares line in n (a lone sample: minus itself)."""
    n, y = F.col("n").cast("double"), F.col("y")
    s = with_stats(signal, keys, _b=F.regr_slope(y, n), _my=F.avg(y), _mn=F.avg(n))
    return s.withColumn("y", y - F.col("_my") - F.coalesce("_b", F.lit(0.0)) * (n - F.col("_mn"))).drop("_b", "_my", "_mn")


def zscore(signal: DataFrame, keys: Keys) -> DataFrame:
    """(y - mean) / (std + 1e-8); only centred where std is at most 1e-8."""
    s = with_stats(signal, keys, _m=F.avg("y"), _s=F.stddev_pop("y"))
    return s.withColumn("y", F.when(F.col("_s") > 1e-8, (F.col("y") - F.col("_m")) / (F.col("_s") + 1e-8)).otherwise(F.col("y") - F.col("_m"))).drop("_m", "_s")


def robust_stats(signal: DataFrame, keys: Keys) -> DataFrame:
    """keys, med, mad, sigma, std, snr per key. Keys of more than selection.LIMIT samples get their medians by rounds of
    counts."""
    if selection.largest(signal, keys) <= selection.LIMIT:
        med = signal.groupBy(*keys).agg(F.percentile("y", 0.5).alias("med"), F.stddev_pop("y").alias("std"))
        off = F.percentile(F.abs(F.col("y") - F.col("med")), 0.5)
        mad = signal.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.first("std").alias("std"), off.alias("mad"))
    else:
        med = selection.quantiles(signal, keys, F.col("y"), [0.5]).select(*keys, F.get("q", F.lit(0)).alias("med"))
        off = selection.quantiles(signal.join(med, keys), keys, F.abs(F.col("y") - F.col("med")), [0.5]).select(*keys, F.get("q", F.lit(0)).alias("mad"))
        mad = signal.groupBy(*keys).agg(F.stddev_pop("y").alias("std")).join(med, keys).join(off, keys)
    sigma = F.lit(1.4826) * F.col("mad")
    return mad.select(*keys, "med", "mad", sigma.alias("sigma"), "std", F.when(sigma > 0, F.col("std") / F.greatest(sigma, F.lit(1e-6))).otherwise(0.0).alias("snr"))


def robust_zscore(signal: DataFrame, keys: Keys, eps: float = 1e-6, limit: float | None = 3.5) -> DataFrame:
    """(y - median) / max(1.4826 MAD, eps), limited; with sigma, snr and whether the row was limited."""
    s = signal.join(robust_stats(signal, keys), keys)
    z = (F.col("y") - F.col("med")) / F.greatest(F.col("sigma"), F.lit(eps))
    s = s.withColumn("_z", z).withColumn("clipped", (F.abs("_z") >= limit) if limit else F.lit(False))
    return s.withColumn("y", clip(F.col("_z"), -limit, limit) if limit else F.col("_z")).drop("_z", "med", "mad", "std")


def sign_align(signal: DataFrame, keys: Keys, fs: float, f0: DataFrame, seconds: float = 12.0) -> DataFrame:
    """The whole series negated where its first seconds run against cos(2 pi f0 t). f0: keys, hz."""
    seg = max(1, round(seconds * fs))
    dot = signal.where(F.col("n") < seg).join(f0, keys).groupBy(*keys).agg(F.sum(F.col("y") * F.cos(F.lit(2 * math.pi) * F.col("hz") * F.col("n") / fs)).alias("_dot"))
    return signal.join(dot, keys, "left").withColumn("y", F.when(F.col("_dot") < 0, -F.col("y")).otherwise(F.col("y"))).drop("_dot")


def first_difference(signal: DataFrame, keys: Keys) -> DataFrame:
    d = F.col("y") - F.lag("y").over(_by_n(keys))
    return signal.withColumn("y", d).where("y IS NOT NULL")


def innovations(signal: DataFrame, keys: Keys) -> DataFrame:
    """First differences, (x - mean) / (std + 1e-9)."""
    s = with_stats(first_difference(signal, keys), keys, _m=F.avg("y"), _s=F.stddev_pop("y"))
    return s.withColumn("y", (F.col("y") - F.col("_m")) / (F.col("_s") + 1e-9)).drop("_m", "_s")


def even_extend(signal: DataFrame, keys: Keys, k: int) -> DataFrame:
    """k samples mirrored at both ends without repeating the end samples; needs k < N."""
    s = with_stats(signal, keys, _last=F.max("n"))
    low = s.where((F.col("n") >= 1) & (F.col("n") <= k)).withColumn("n", -F.col("n"))
    high = s.where((F.col("n") < F.col("_last")) & (F.col("n") >= F.col("_last") - k)).withColumn("n", 2 * F.col("_last") - F.col("n"))
    return s.unionByName(low).unionByName(high).drop("_last")


def moving_average(signal: DataFrame, keys: Keys, w: int = 5) -> DataFrame:
    """Sum of the 2w samples from n - w on, over 2w + 1, on the extended series; N + 1 values, as specified."""
    s = even_extend(signal, keys, w)
    total = F.sum("y").over(_by_n(keys).rowsBetween(-w, w - 1))
    s = with_stats(s.withColumn("_y", total / (2 * w + 1)), keys, _hi=F.max("n"))
    return s.where((F.col("n") >= 0) & (F.col("n") <= F.col("_hi") - w + 1)).withColumn("y", F.col("_y")).drop("_y", "_hi")


def decimate(signal: DataFrame, raw: float, target: float) -> DataFrame:
    """Every k-th sample, k = max(1, raw / target rounded half to even); with the effective rate fs."""
    k = max(1, round(raw / target))
    return signal.where(F.col("n") % k == 0).withColumn("n", (F.col("n") / k).cast("int")).withColumn("fs", F.lit(raw / k))


def sliding_windows(signal: DataFrame, keys: Keys, width: int, stride: int, fs: float) -> DataFrame:
    """Each sample in every window it belongs to: win, i (place in the window), t_center."""
    s = with_stats(signal, keys, _n=F.count("*"))
    last = F.least(F.floor(F.col("n") / stride), F.floor((F.col("_n") - width) / stride))
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("n") - width + 1) / stride))
    s = s.where((F.col("_n") >= width) & (first <= last)).withColumn("win", F.explode(F.sequence(first, last)))
    return s.withColumn("i", F.col("n") - F.col("win") * stride).withColumn("t_center", (F.lit(width / 2) + F.col("win") * stride) / fs).drop("_n")


def minmax_display(es: DataFrame, gt: DataFrame, keys: Keys) -> DataFrame:
    """Both series as (x - mean) / (std + 1e-6), only for keys where they are equally long."""
    out = []
    for side, df in (("es", es), ("gt", gt)):
        s = with_stats(df, keys, _m=F.avg("y"), _s=F.stddev_pop("y"), _c=F.count("*"))
        out.append(s.select(*keys, "n", ((F.col("y") - F.col("_m")) / (F.col("_s") + 1e-6)).alias(side), F.col("_c").alias(f"n_{side}")))
    return out[0].join(out[1], [*keys, "n"]).where("n_es = n_gt").drop("n_es", "n_gt")


def signal_stats(signal: DataFrame, keys: Keys) -> DataFrame:
    """Moments, extent and energy per key; what is not finite is left out."""
    y = F.when(finite(F.col("y")), F.col("y"))
    return signal.groupBy(*keys).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), (F.max(y) - F.min(y)).alias("ptp"), F.sum(y * y).alias("energy"),
        F.avg(F.abs(y)).alias("abs_mean"), F.stddev_pop(F.abs(y)).alias("abs_std"), F.avg((y >= 0).cast("double")).alias("positive"),
    )


def ema(signal: DataFrame, keys: Keys, alpha: float, size: int = scans.CHUNK) -> DataFrame:
    """Exponential smoothing, by chunks of size places. alpha outside (0, 1): as is. A missing sample (null or NaN)
    gives null, and smoothing starts anew after it."""
    return scans.exponential(signal, keys, alpha, size) if 0 < alpha < 1 else signal.select(*keys, "n", "y")
