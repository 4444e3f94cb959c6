"""Spectra and rate estimators on long signals (keys, n, y).

Windows are cut, tapered and transformed in numpy, all those of a chunk of a series at once; a chunk carries the samples
that its last windows reach beyond it, so samples are copied once and not for each window. Correlations are sums over
pairs of blocks, each by one transform. dft, for single bins, is a join of the samples with a broadcast grid of bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import clip, finite
from cadenza.operators.conditioning import Keys, sliding_windows, with_stats

#: The most bins that dft may be asked for: their list is broadcast.
GRID_LIMIT = 100_000
#: Samples of a block of a correlation, and the least of a chunk of windows.
BLOCK = 16_384
#: The symmetric Blackman-Harris window's coefficients.
BLACKMAN_HARRIS = (0.35875, 0.48829, 0.14128, 0.01168)


def _grid(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    if hi - lo > GRID_LIMIT:
        raise ValueError(f"{hi - lo} grid points; at most {GRID_LIMIT}")
    return F.broadcast(spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("k")))


def dft(signal: DataFrame, keys: Keys, k_lo: int, k_hi: int, size: int, place: str = "n", value: str = "y") -> DataFrame:
    """keys, k, re, im: sums of value * cos and sin of 2 pi k place / size."""
    turn = F.lit(2 * math.pi / size) * F.col("k") * F.col(place)
    rows = signal.join(_grid(signal.sparkSession, k_lo, k_hi))
    return rows.groupBy(*keys, "k").agg(F.sum(F.col(value) * F.cos(turn)).alias("re"), F.sum(F.col(value) * F.sin(turn)).alias("im"))


def band_bins(lo: float, hi: float, fs: float, nfft: int, closed: bool = True) -> tuple[int, int]:
    """The bins whose frequency lies in [lo, hi] (or in (lo, hi))."""
    inside = [k for k in range(nfft // 2 + 1) if (lo <= k * fs / nfft <= hi if closed else lo < k * fs / nfft < hi)]
    return (inside[0], inside[-1]) if inside else (0, -1)


def spectra(signal: DataFrame, keys: Keys, fs: float, width: int, stride: int, tapers: np.ndarray, nfft: int, k_lo: int, k_hi: int, per_window: bool = True) -> DataFrame:
    """keys, win, t_center, freq, power (density) of the bins k_lo to k_hi of full windows less their mean, averaged over
    the tapers (one row each); or (per_window false) keys, freq, power averaged over the windows too.

    A key's places n begin at 0. Windows that a chunk's places begin are cut from it and from the width - stride samples
    after it. Missing samples count as the window's mean.
    """
    size = max(1, round(max(BLOCK, 8 * width) / stride)) * stride
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = dict(signal.dtypes)
    at = F.floor(F.col("n") / size).cast("long")
    # A sample within reach of the end of the chunk before goes there too.
    lent = F.when(F.col("n") - at * size < width - 1, F.array(at - 1, at)).otherwise(F.array(at))
    rows = signal.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], "n", F.col("y").cast("double").alias("y"), F.explode(lent).alias("chunk")).where("chunk >= 0")
    chunks = rows.groupBy(*names, "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "y"))).alias("s")).select(*names, "chunk", F.col("s.n").alias("n"), F.col("s.y").alias("y"))
    ks = np.arange(k_lo, k_hi + 1)
    scale = np.where((ks == 0) | (2 * ks == nfft), 1.0, 2.0) / fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, (chunk, n, y) in enumerate(zip(b["chunk"], b["n"], b["y"], strict=True)):
                place = np.asarray(n, np.int64) - chunk * size
                x = np.full(int(place[-1]) + 1, np.nan)
                x[place] = np.asarray(y, float)
                if len(x) < width:
                    continue
                w = np.lib.stride_tricks.sliding_window_view(x, width)[::stride][: size // stride]
                w = w - np.nanmean(w, axis=1, keepdims=True)
                w = np.where(np.isnan(w), 0.0, w)
                power = np.zeros((len(w), len(ks)))
                for h in tapers:
                    power += np.abs(np.fft.rfft(w * h, nfft, axis=1)[:, k_lo : k_hi + 1]) ** 2 if nfft >= width else np.abs((w * h) @ np.exp(-2j * np.pi / nfft * np.outer(np.arange(width), ks))) ** 2
                power *= scale / len(tapers)
                if per_window:
                    out += [(i, chunk * (size // stride) + j, p) for j, p in enumerate(power)]
                else:
                    out.append((i, len(power), power.sum(0)))
            f = b[names].iloc[[o[0] for o in out]].reset_index(drop=True)
            yield f.assign(win=[int(o[1]) for o in out], power=[o[2] for o in out])

    schema = "".join(f"`{a}` {kinds[k]}, " for k, a in zip(keys, names, strict=True)) + "win long, power array<double>"
    back = [F.col(a).alias(k) for k, a in zip(keys, names, strict=True)]
    p = chunks.mapInPandas(run, schema).select(*back, "win", F.posexplode("power").alias("_k", "power")).withColumn("freq", (F.col("_k") + k_lo) * F.lit(fs) / nfft)
    if per_window:
        return p.select(*keys, "win", ((F.lit(width / 2) + F.col("win") * stride) / fs).alias("t_center"), "freq", "power")
    return p.groupBy(*keys, "freq").agg((F.sum("power") / F.sum("win")).alias("power"))


def welch_psd(signal: DataFrame, keys: Keys, fs: float, nperseg: int, noverlap: int | None = None, nfft: int | None = None, lo: float | None = None, hi: float | None = None, closed: bool = True, per_window: bool = False) -> DataFrame:
    """keys, freq, power: averaged periodograms (periodic Hann, mean removed, density). Only the band is computed.

    per_window: no average, one spectrum per segment (win, t_center).
    """
    nfft = nfft or nperseg
    noverlap = nperseg // 2 if noverlap is None else noverlap
    k_lo, k_hi = band_bins(0 if lo is None else lo, fs if hi is None else hi, fs, nfft, closed)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi / nperseg * np.arange(nperseg))
    return spectra(signal, keys, fs, nperseg, nperseg - noverlap, hann[None] / math.sqrt(0.375 * nperseg), nfft, k_lo, k_hi, per_window)


def peak(psd: DataFrame, keys: Keys) -> DataFrame:
    """keys, hz, power of the greatest power; the lowest frequency on ties."""
    best = F.max_by(F.struct("freq", "power"), F.struct("power", -F.col("freq"))).alias("p")
    return psd.groupBy(*keys).agg(best).select(*keys, F.col("p.freq").alias("hz"), F.col("p.power").alias("power"))


def welch_candidate(signal: DataFrame, keys: Keys, fs: float, total: int, lo: float, hi: float) -> DataFrame:
    """keys, hz, confidence, ratio: the in-band Welch peak over the median of the band. total: samples per key."""
    if total < 8:
        return signal.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("hz"), F.lit(0.0).alias("confidence"), F.lit(None).cast("double").alias("ratio"))
    nperseg = int(min(max(fs * 20, fs), total))
    nperseg = nperseg if nperseg >= 8 else min(256, total)
    psd = welch_psd(signal, keys, fs, nperseg, lo=lo, hi=hi)
    p = psd.groupBy(*keys).agg(F.max_by(F.struct("freq", "power"), F.struct("power", -F.col("freq"))).alias("p"), F.percentile("power", 0.5).alias("m"))
    ratio = F.col("p.power") / (F.col("m") + 1e-9)
    return p.select(*keys, F.col("p.freq").alias("hz"), clip(ratio / 4, 0.0, 5.0).alias("confidence"), ratio.alias("ratio"))


def autocorrelation(signal: DataFrame, keys: Keys, lag_lo: int, lag_hi: int, size: int | None = None) -> DataFrame:
    """keys, lag, r: raw sums of y[n] y[n + lag].

    Series are cut into blocks of size places; a block meets those that its lags reach, and each pair is one product of
    transforms of twice the size (overlap-save). No task holds a series; a lag costs a row only once a pair's sums for
    it are added up.
    """
    size = size or BLOCK
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = dict(signal.dtypes)
    b = signal.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.floor(F.col("n") / size).cast("long").alias("block"), (F.col("n") % size).alias("n"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))
    b = b.groupBy(*names, "block").agg(F.collect_list(F.struct("n", "y")).alias("s")).select(*names, "block", F.col("s.n").alias("n"), F.col("s.y").alias("y"))
    reach = F.explode(F.sequence(F.lit(max(0, (lag_lo - size + 1) // size)), F.lit((lag_hi + size - 1) // size)))
    early = b.select(*names, reach.alias("d"), F.col("block").alias("_b"), F.col("n").alias("na"), F.col("y").alias("ya")).withColumn("block", F.col("_b") + F.col("d"))

    def placed(n, y, most):
        x = np.zeros(most)
        x[np.asarray(n, np.int64)] = np.asarray(y, float)
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for i, (d, na, ya, n, y) in enumerate(zip(f["d"], f["na"], f["ya"], f["n"], f["y"], strict=True)):
                most = int(max(max(na), max(n))) + 1  # shorter blocks need shorter transforms
                x, z = placed(na, ya, most), placed(n, y, most)
                length = 1 << (2 * most - 1).bit_length()
                c = np.fft.irfft(np.conj(np.fft.rfft(x, length)) * np.fft.rfft(z, length), length)
                lo, hi = max(lag_lo, d * size - most + 1, 0), min(lag_hi, d * size + most - 1)
                if lo <= hi:
                    out.append((i, lo, c[(np.arange(lo, hi + 1) - d * size) % length]))
            g = f[names].iloc[[o[0] for o in out]].reset_index(drop=True)
            yield g.assign(lo=[int(o[1]) for o in out], r=[o[2] for o in out])

    schema = "".join(f"`{a}` {kinds[k]}, " for k, a in zip(keys, names, strict=True)) + "lo long, r array<double>"
    pairs = early.join(b, [*names, "block"]).select(*names, "d", "na", "ya", "n", "y").mapInPandas(run, schema)
    back = [F.col(a).alias(k) for k, a in zip(keys, names, strict=True)]
    return pairs.select(*back, "lo", F.posexplode("r").alias("_i", "r")).groupBy(*keys, (F.col("lo") + F.col("_i")).cast("int").alias("lag")).agg(F.sum("r").alias("r"))


def autocorr_candidate(signal: DataFrame, keys: Keys, fs: float, total: int, lo: float, hi: float) -> DataFrame:
    """keys, hz, confidence, lag of the greatest autocorrelation at the lags of the band (the last one left out)."""
    lag_lo, lag_hi = int(max(1, round(fs / max(hi, 1e-3)))), int(min(total - 1, round(fs / max(lo, 1e-3))))
    if total < 16 or lag_hi <= lag_lo:
        return signal.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("hz"), F.lit(0.0).alias("confidence"), F.lit(None).cast("int").alias("lag"))
    r = autocorrelation(signal, keys, lag_lo, lag_hi - 1).groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.col("lag"))).alias("p"))
    zero = signal.groupBy(*keys).agg(F.sum(F.col("y") * F.col("y")).alias("r0"))
    return r.join(zero, keys).select(*keys, (F.lit(fs) / F.col("p.lag")).alias("hz"), (F.col("p.r") / F.greatest("r0", F.lit(1e-9))).alias("confidence"), F.col("p.lag").alias("lag"))


def coarse_frequency(candidates: DataFrame, keys: Keys, lo: float, hi: float, margin: float = 0.01) -> DataFrame:
    """Confidence-weighted vote of candidates (keys, hz, confidence, label); keys without a valid one get mid-band.

    A candidate is valid when both numbers are finite and positive. The result stays margin inside the band.
    """
    band = hi - lo
    margin = max(0.0, 0.5 * band - 1e-8) if 0 < band <= 2 * margin else margin
    ok = finite(F.col("hz")) & (F.col("hz") > 0) & finite(F.col("confidence")) & (F.col("confidence") > 0)
    c = F.when(ok, F.greatest("confidence", F.lit(1e-6)))
    a = candidates.groupBy(*keys).agg(
        (F.sum(F.col("hz") * c) / F.sum(c)).alias("blend"),
        F.max_by(F.when(ok, F.col("hz")), F.when(ok, F.col("confidence"))).alias("raw_hz"),
        (F.sum(c * F.when(ok, F.col("confidence"))) / F.sum(c)).alias("confidence_weighted"),
        F.max(F.when(ok, F.col("confidence"))).alias("confidence_max"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("label", "hz", "confidence")))).alias("candidates"),
    )
    mid = 0.5 * (lo + hi)
    return a.withColumn("hz", F.coalesce(clip(F.col("blend"), lo + margin, hi - margin), F.lit(mid))).withColumn("raw_hz", F.coalesce("raw_hz", F.lit(mid))).drop("blend")


def external_candidates(meta: DataFrame, keys: Keys) -> DataFrame:
    """meta (keys, hz, ratio, db) as candidates: confidence max(ratio, 1e-3), else 10^(db/10)."""
    conf = F.when(finite(F.col("ratio")), F.greatest("ratio", F.lit(1e-3))).when(finite(F.col("db")), F.greatest(F.pow(F.lit(10.0), F.col("db") / 10), F.lit(1e-3)))
    return meta.select(*keys, "hz", conf.alias("confidence"), F.lit("external").alias("label")).where("confidence IS NOT NULL")


def parabolic_peak(series: DataFrame, keys: Keys, order: str, value: str, at: DataFrame | None = None) -> DataFrame:
    """keys, x, y: the vertex of the parabola through a peak and its neighbours. at: keys, peak (else the maximum)."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = series.select(*keys, F.col(order).alias("x"), F.col(value).alias("b"), F.lag(value).over(w).alias("a"), F.lead(value).over(w).alias("c"))
    if at is None:
        best = s.groupBy(*keys).agg(F.max_by(F.struct("x", "a", "b", "c"), F.struct("b", -F.col("x"))).alias("p")).select(*keys, "p.*")
    else:
        best = s.join(at, keys).where("x = peak")
    x = 0.5 * F.try_divide(F.col("a") - F.col("c"), F.col("a") - 2 * F.col("b") + F.col("c")) + F.col("x")
    return best.select(*keys, x.alias("x"), (F.col("b") - 0.25 * (F.col("a") - F.col("c")) * (x - F.col("x"))).alias("y"))


def freq_autocorr(signal: DataFrame, keys: Keys, fs: float, total: int) -> DataFrame:
    """fs over the refined lag of the greatest autocorrelation beyond its first rise."""
    r = autocorrelation(signal, keys, 0, total - 1)
    w = Window.partitionBy(*keys).orderBy("lag")
    rise = r.withColumn("d", F.lead("r").over(w) - F.col("r")).where("d > 0").groupBy(*keys).agg(F.min("lag").alias("start"))
    peak_at = r.join(rise, keys).where("lag >= start").groupBy(*keys).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("peak"))
    return parabolic_peak(r, keys, "lag", "r", peak_at).select(*keys, (F.lit(fs) / F.col("x")).alias("hz"))


def freq_crossings(signal: DataFrame, keys: Keys, fs: float) -> DataFrame:
    """fs over the mean spacing of interpolated rising zero crossings."""
    s = signal.withColumn("_n", F.lead("y").over(Window.partitionBy(*keys).orderBy("n"))).where("y < 0 AND _n >= 0")
    at = F.col("n") - F.col("y") / (F.col("_n") - F.col("y"))
    return s.groupBy(*keys).agg(F.try_divide(F.lit(fs) * (F.count("*") - 1), F.max(at) - F.min(at)).alias("hz")).where("hz IS NOT NULL")


def freq_fft(signal: DataFrame, keys: Keys, fs: float, total: int) -> DataFrame:
    """fs i / N at the refined peak of the Blackman-Harris magnitude spectrum; one transform of the whole series, so one
    key's total samples must fit a task."""
    at = 2 * np.pi / (total - 1) * np.arange(total)
    w = sum((-1) ** i * c * np.cos(i * at) for i, c in enumerate(BLACKMAN_HARRIS))
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = dict(signal.dtypes)
    s = signal.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(F.collect_list(F.struct("n", F.col("y").cast("double").alias("y"))).alias("s")).select(*names, F.col("s.n").alias("n"), F.col("s.y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), total))
            for i, (n, y) in enumerate(zip(b["n"], b["y"], strict=True)):
                x[i, np.asarray(n, np.int64)] = np.nan_to_num(np.asarray(y, float))
            mag = np.abs(np.fft.rfft(x * w, axis=1))
            top = mag.argmax(1)
            part = [[{"k": int(k), "mag": float(m[k])} for k in range(max(0, p - 1), min(len(m), p + 2))] for m, p in zip(mag, top, strict=True)]
            yield b[names].assign(near=part)

    schema = "".join(f"`{a}` {kinds[k]}, " for k, a in zip(keys, names, strict=True)) + "near array<struct<k: int, mag: double>>"
    d = s.mapInPandas(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], F.inline("near"))
    return parabolic_peak(d, keys, "k", "mag").select(*keys, (F.col("x") * fs / total).alias("hz"))


def band_power_ratio(psd: DataFrame, keys: Keys, band: tuple[float, float], whole: tuple[float, float]) -> DataFrame:
    """In-band over whole power; -1 where the whole is 0."""
    part = F.sum(F.when(F.col("freq").between(*band), F.col("power")).otherwise(0.0))
    all_ = F.sum(F.when(F.col("freq").between(*whole), F.col("power")).otherwise(0.0))
    return psd.groupBy(*keys).agg(F.when(all_ > 0, part / all_).otherwise(-1.0).alias("ratio"))


def snr_at_reference(psd: DataFrame, reference: DataFrame, keys: Keys, reach: float) -> DataFrame:
    """10 log10 of the power within reach of the reference (keys, ref) over the rest."""
    j = psd.join(reference, keys)
    near = F.sum(F.when(F.abs(F.col("freq") - F.col("ref")) <= reach, F.col("power")).otherwise(0.0))
    rest = F.sum(F.when(F.abs(F.col("freq") - F.col("ref")) > reach, F.col("power")).otherwise(0.0))
    return j.groupBy(*keys).agg((10 * F.log10(F.try_divide(near, rest))).alias("snr_db"))


def spectral_meta(psd: DataFrame, keys: Keys) -> DataFrame:
    """Peak frequency, ratio to the median, dB, prominence over the median in dB, mean spacing of the bins."""
    a = psd.groupBy(*keys).agg(F.max_by(F.struct("freq", "power"), F.struct("power", -F.col("freq"))).alias("p"), F.percentile("power", 0.5).alias("m"), ((F.max("freq") - F.min("freq")) / (F.count("*") - 1)).alias("mean_df"))
    db = 10 * F.log10(F.col("p.power") + 1e-12)
    return a.select(*keys, F.col("p.freq").alias("peak_hz"), (F.col("p.power") / (F.col("m") + 1e-9)).alias("peak_ratio"), db.alias("peak_db"), (db - 10 * F.log10(F.col("m") + 1e-12)).alias("prom_db"), "mean_df")


def thd(spectrum: DataFrame, keys: Keys, lo: float, hi: float) -> DataFrame:
    """(P at 2f + P at 3f) / (P at f + 1e-9) at the nearest bins; f is the in-band peak; 0 without one."""
    f0 = peak(spectrum.where(F.col("freq").between(lo, hi)), keys).select(*keys, F.col("hz").alias("f0"))
    j = spectrum.join(f0, keys)
    at = [F.min_by("power", F.struct(F.abs(F.col("freq") - h * F.col("f0")), F.col("freq"))) for h in (1, 2, 3)]
    found = j.groupBy(*keys).agg(((at[1] + at[2]) / (at[0] + 1e-9)).alias("thd"))
    return spectrum.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("thd", F.lit(0.0)).alias("thd"))


def mean_spectrum(psd: DataFrame, keys: Keys, by: Keys, lo: float, hi: float, points: int) -> DataFrame:
    """by, f, power: spectra over the band's maximum, interpolated to an even grid, averaged."""
    s = psd.where(F.col("freq").between(lo, hi))
    w = Window.partitionBy(*keys).orderBy("freq")
    top = F.max("power").over(Window.partitionBy(*keys))
    s = s.withColumn("p", F.try_divide(F.col("power"), top)).withColumn("f2", F.lead("freq").over(w)).withColumn("p2", F.lead("p").over(w)).where("f2 IS NOT NULL")
    step = (hi - lo) / (points - 1)
    near = F.sequence(F.floor((F.col("freq") - lo) / step), F.ceil((F.col("f2") - lo) / step))
    inside = F.filter(near, lambda g: (g >= 0) & (g < points) & (g * step + lo >= F.col("freq")) & (g * step + lo < F.col("f2")))
    s = s.withColumn("g", F.explode(inside))
    f = F.col("g") * F.lit(step) + lo
    v = F.col("p") + (F.col("p2") - F.col("p")) * (f - F.col("freq")) / (F.col("f2") - F.col("freq"))
    return s.withColumn("v", v).groupBy(*by, "g").agg(F.avg("v").alias("power")).withColumn("f", F.col("g") * F.lit(step) + lo)


def slepian_tapers(n: int, nw: float, count: int) -> np.ndarray:
    """The count leading discrete prolate sequences, from their tridiagonal matrix."""
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(i[1:] * (n - i[1:]) / 2.0, 1) + np.diag(i[1:] * (n - i[1:]) / 2.0, -1)
    _, v = np.linalg.eigh(m)
    v = v[:, ::-1][:, :count].T
    for k, t in enumerate(v):
        if (t.sum() if k % 2 == 0 else t[: n // 2].sum()) < 0:
            t *= -1
    return v


def multitaper_spectrogram(signal: DataFrame, keys: Keys, fs: float, width: int, stride: int, nw: float = 3.0, lo: float = 0.0, hi: float | None = None, nfft: int | None = None) -> DataFrame:
    """keys, t_center, freq, power: windows less their mean, eigenspectra of 2 NW - 1 tapers averaged with equal weight."""
    nfft = nfft or width
    tapers = slepian_tapers(width, nw, int(2 * nw) - 1)
    k_lo, k_hi = band_bins(lo, fs if hi is None else hi, fs, nfft)
    return spectra(signal, keys, fs, width, stride, tapers, nfft, k_lo, k_hi).select(*keys, "t_center", "freq", "power")
