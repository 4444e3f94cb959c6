"""Framewise operators on pixel tables (trial, frame, row, col, gray or r, g, b): one value per frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["trial", "frame"]


def gray(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma; the weights are the fixed values of ITU-R BT.601, taken as thousandths: halves come out exactly and
    go up."""
    return F.round((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def shoulder_box(marks: DataFrame) -> DataFrame:
    """trial, left, right, top, bottom (half-open) from img_w, img_h and both shoulders' x and y."""
    left, right = F.greatest("x_right", F.lit(0.0)), F.least("x_left", F.col("img_w").cast("double"))
    height, mid = 0.2 * (F.col("x_left") - F.col("x_right")), F.least("y_left", "y_right")
    top, bottom = F.greatest(mid - height / 2, F.lit(0.0)), F.least(mid + height / 2, F.col("img_h").cast("double"))
    return marks.select("trial", *[F.round(v).cast("int").alias(n) for v, n in ((left, "left"), (right, "right"), (top, "top"), (bottom, "bottom"))])


def roi_crop(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels inside their trial's box (left, right, top, bottom); one box per trial for all frames."""
    j = frames.join(boxes, "trial")
    return j.where((F.col("row") >= F.col("top")) & (F.col("row") < F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") < F.col("right"))).select(*frames.columns)


def frame_difference(frames: DataFrame, threshold: int = 100, wrap: bool = True) -> DataFrame:
    """trial, frame, y: pixels that changed by more than threshold since the frame before (8-bit wrap-around or signed)."""
    w = Window.partitionBy("trial", "row", "col").orderBy("frame")
    d = F.col("gray") - F.lag("gray").over(w)
    d = F.pmod(d, F.lit(256)) if wrap else d
    return frames.withColumn("d", d).where("d IS NOT NULL").groupBy(*FRAME).agg(F.sum((F.col("d") > threshold).cast("long")).alias("y"))


def flow_median(flow: DataFrame) -> DataFrame:
    """trial, frame, y: the median of the vertical flow vy."""
    return flow.groupBy(*FRAME).agg(F.percentile("vy", 0.5).alias("y"))


def row_profile(frames: DataFrame) -> DataFrame:
    """trial, frame, row, p: half of mean plus deviation of each image row, less that of the row above."""
    r = frames.groupBy(*FRAME, "row").agg((0.5 * (F.avg("gray") + F.stddev_pop("gray"))).alias("v"))
    return r.withColumn("p", F.col("v") - F.lag("v").over(Window.partitionBy(*FRAME).orderBy("row"))).where("p IS NOT NULL").drop("v")


def profile_correlation(profile: DataFrame) -> DataFrame:
    """trial, frame, lag, c: full cross-correlation of a frame's profile with the one before (lag 0 .. 2L - 2)."""
    before = profile.select("trial", (F.col("frame") + 1).alias("frame"), F.col("row").alias("j"), F.col("p").alias("q"))
    size = profile.groupBy("trial").agg((F.max("row") - F.min("row")).alias("span"))
    j = profile.join(before, FRAME).join(size, "trial")
    return j.groupBy(*FRAME, (F.col("row") - F.col("j") + F.col("span")).alias("lag")).agg(F.sum(F.col("p") * F.col("q")).alias("c"))


def _not_a_knot(n: int) -> np.ndarray:
    """Maps n values at knots 1 apart to the second derivatives of their not-a-knot cubic spline."""
    a, r = np.zeros((n, n)), np.zeros((n, n))
    inner = np.arange(1, n - 1)
    for shift, left, right in ((-1, 1, 6), (0, 4, -12), (1, 1, 6)):
        a[inner, inner + shift], r[inner, inner + shift] = left, right
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    return np.linalg.solve(a, r)


#: Grid points that are evaluated at a time, but for a single longer row; a dozen arrays of so many doubles are held.
GRID = 1 << 18


def _parts(b: pd.DataFrame, fine: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most GRID grid points together, as if each were as long as the longest (or one row)."""
    many = max(1, GRID // max(1, fine * int(b["c"].map(len).max()))) if len(b) else 1
    for lo in range(0, len(b), many):
        yield b.iloc[lo : lo + many]


def _spline_peaks(fine: int):
    """The grid index of the peak of each row's spline. The system depends on the length only and is solved once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict[int, np.ndarray] = {}
        for b in (part for whole in batches for part in _parts(whole, fine)):
            at = np.zeros(len(b))
            length = b["c"].map(len).to_numpy()
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                y, grid = np.stack([np.asarray(b["c"].iloc[i], float) for i in rows]), np.linspace(0, n - 1, n * fine)
                k = np.clip(grid.astype(int), 0, max(0, n - 2))
                u, v = grid - k, k + 1 - grid
                if n not in maps:
                    maps[n] = _not_a_knot(n) if n >= 4 else np.zeros((n, n))
                m, z = y @ maps[n].T, np.minimum(k + 1, n - 1)
                f = (m[:, k] * v**3 + m[:, z] * u**3) / 6 + (y[:, k] - m[:, k] / 6) * v + (y[:, z] - m[:, z] / 6) * u
                at[rows] = f.argmax(1)
            yield pd.DataFrame({"trial": b["trial"], "frame": b["frame"], "at": at})

    return run


def profile_shift(profile: DataFrame, fps: float, interp: str = "linear", fine: int = 100) -> DataFrame:
    """trial, frame, y: place of the cross-correlation's peak on a grid fine times as dense (a grid index), times fps.

    linear: the better of the two grid points beside the integer peak. quadratic: the vertex of the parabola through
    it. cubic: the peak of the exact spline, per frame.
    """
    c = profile_correlation(profile)
    if interp == "cubic":
        rows = c.groupBy(*FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "c"))), lambda s: s["c"]).alias("c"))
        return rows.mapInPandas(_spline_peaks(fine), "trial int, frame int, at double").select(*FRAME, (F.col("at") * fps).alias("y"))
    w = Window.partitionBy(*FRAME).orderBy("lag")
    s = c.withColumn("a", F.lag("c").over(w)).withColumn("z", F.lead("c").over(w))
    p = s.groupBy(*FRAME).agg(F.max_by(F.struct("lag", "a", "c", "z"), F.struct("c", -F.col("lag"))).alias("p"), F.count("*").alias("m")).select(*FRAME, "p.*", "m")
    per = (F.col("m") * fine - 1) / (F.col("m") - 1)  # grid points per lag
    if interp == "quadratic":
        x = F.col("lag") + F.coalesce(0.5 * F.try_divide(F.col("a") - F.col("z"), F.col("a") - 2 * F.col("c") + F.col("z")), F.lit(0.0))
        return p.select(*FRAME, (x * per * fps).alias("y"))
    low = F.floor(F.col("lag") * per + 1e-9)
    left = F.col("c") - (F.col("c") - F.col("a")) * (F.col("lag") - low / per)
    right = F.col("c") - (F.col("c") - F.col("z")) * ((low + 1) / per - F.col("lag"))
    best = F.when(F.col("a").isNull() | F.col("z").isNull() | (left >= right), low).otherwise(low + 1)
    return p.select(*FRAME, (best * F.lit(fps)).alias("y"))


def roi_intensity(frames: DataFrame) -> DataFrame:
    """trial, mean, std (means over frames) and 20 log10(mean / std), null without deviation."""
    f = frames.groupBy(*FRAME).agg(F.avg("gray").alias("m"), F.stddev_pop("gray").alias("s"))
    a = f.groupBy("trial").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))
    return a.withColumn("snr_db", F.when(F.col("std") > 0, 20 * F.log10(F.col("mean") / F.greatest("std", F.lit(1e-6)))))


def centre_patch(frames: DataFrame, half: int = 5) -> DataFrame:
    """trial, frame, z, kurtosis: standardised mean of the centre patch of each frame, and the trial's excess kurtosis."""
    size = frames.groupBy("trial").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    j = frames.join(size, "trial")
    mid_r, mid_c = F.floor(F.col("h") / 2), F.floor(F.col("w") / 2)
    p = j.where((F.col("row") >= mid_r - half) & (F.col("row") < mid_r + half) & (F.col("col") >= mid_c - half) & (F.col("col") < mid_c + half))
    m = p.groupBy(*FRAME).agg(F.avg("gray").alias("y"))
    s = m.groupBy("trial").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"), F.kurtosis("y").alias("kurtosis"))
    return m.join(s, "trial").select(*FRAME, ((F.col("y") - F.col("mu")) / (F.col("sd") + 1e-9)).alias("z"), "kurtosis")


def rate_stats(frames: DataFrame, rates: DataFrame) -> DataFrame:
    """trial, frames, fps, seconds. rates: trial, fps."""
    n = frames.groupBy("trial").agg(F.countDistinct("frame").alias("frames"))
    return n.join(rates, "trial").select("trial", "frames", "fps", F.try_divide(F.col("frames"), F.col("fps")).alias("seconds"))


def square_box(boxes: DataFrame) -> DataFrame:
    """The largest square around the centre of a relative box (x, y, w, h of an img_w x img_h image), clipped to it."""
    cx, cy = (F.col("x") + F.col("w") / 2) * F.col("img_w"), (F.col("y") + F.col("h") / 2) * F.col("img_h")
    d = F.least(F.greatest(F.col("img_w") - cx, cx), F.greatest(F.col("img_h") - cy, cy))
    low = lambda v: F.greatest(v.cast("int"), F.lit(0))
    return boxes.select("trial", low(cx - d).alias("left"), F.least((cx + d).cast("int"), "img_w").alias("right"), low(cy - d).alias("top"), F.least((cy + d).cast("int"), "img_h").alias("bottom"))


def channel_select(frames: DataFrame, c: int, rgb: str = "rgb") -> DataFrame:
    """One channel (0, 1, 2) of an array column as y."""
    return frames.withColumn("y", F.element_at(rgb, c + 1)).drop(rgb)


def drop_empty_frames(frames: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that have pixels, and the expected (trial, method) rows whose trial has none."""
    full = frames.where("gray IS NOT NULL")
    return full, expected.join(full.select("trial").distinct(), "trial", "left_anti")
