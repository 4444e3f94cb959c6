"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """x limited to [lo, hi]; NaN and null stay as they are (Spark sorts NaN above every number)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def wrapped(d: Column) -> Column:
    """A phase increment in (-pi, pi], as unwrapping and differencing give it."""
    w = F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.when((w == -math.pi) & (d > 0), math.pi).otherwise(w)


def digits(x: Column, places: int = 6) -> Column:
    """x rounded, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def natural_key(s: Column) -> Column:
    """Sorts digit runs as numbers, the rest as lower-case text."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p))


#: Other spellings of the observation methods.
ALIASES = {
    "of_farneback": ["of_farneback", "of_farneback_", "farneback", "of"],
    "dof": ["dof", "dof_sum"],
    "profile1d_linear": ["profile1d_linear", "profile1d linear", "profile1d-linear"],
    "profile1d_quadratic": ["profile1d_quadratic", "profile1d quadratic", "profile1d-quadratic"],
    "profile1d_cubic": ["profile1d_cubic", "profile1d cubic", "profile1d-cubic"],
}


def method_token(s: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """The canonical method id: an alias's target, else blanks and dashes become underscores."""
    x = F.lower(F.trim(s))
    out = F.regexp_replace(x, "[ -]", "_")
    for name, spellings in (ALIASES if aliases is None else aliases).items():
        out = F.when(x.isin(spellings), F.lit(name)).otherwise(out)
    return out


def sanitize_label(s: Column) -> Column:
    """Anything but letters, digits, _ and - becomes _; _ and - at the ends go; nothing left is null."""
    x = F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "_")
    return F.nullif(F.regexp_replace(x, r"^[_-]+|[_-]+$", ""), F.lit(""))


def split_method(s: Column) -> tuple[Column, Column]:
    """Base and head at the first double underscore, nulls where there is none."""
    at = F.instr(s, "__")
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)), F.when(at > 0, F.substring(s, at + 2, F.length(s)))


def dataset_of(names: list[Column], file: Column) -> Column:
    """The first name that is set, else the file name's part before _, else unknown; lower case."""
    base = F.nullif(F.split_part(F.element_at(F.split(file, "/"), -1), F.lit("_"), F.lit(1)), F.lit(""))
    return F.lower(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], base, F.lit("unknown")))


def pll_gains(snr: Column, fs: Column, zeta: float = 0.9, ttrack: float = 7.0, kp_min: float = 0.0, ki_min: float = 0.0) -> tuple[Column, Column]:
    """Loop gains that widen with the signal-to-noise ratio."""
    fs = F.greatest(fs, F.lit(1.0))
    scale = clip(F.log1p(F.greatest(snr, F.lit(0.0))) / math.log(10.0), 0.2, 2.0)
    omega = F.lit(2 * math.pi) * scale / max(ttrack, 1e-3)
    return F.greatest(2 * max(zeta, 1e-3) * omega / fs, F.lit(float(kp_min))), F.greatest(omega * omega / (fs * fs), F.lit(float(ki_min)))


def clamp_overrides(qx: Column, rv: Column, qf: Column, base_qx: float = 1e-4, base_rv: float = 0.03, base_qf: float = 5e-5) -> tuple[Column, Column, Column]:
    """Learned noise levels kept near their configured bases; values that are not positive stay as they are."""
    limits = ((qx, 1e-7, max(5 * base_qx, base_qx + 5e-5)), (rv, max(0.5 * base_rv, 1e-3), max(5 * base_rv, base_rv + 0.02)), (qf, 1e-7, max(5 * base_qf, 1e-3)))
    return tuple(F.when(finite(x) & (x > 0), clip(x, lo, hi)).otherwise(x) for x, lo, hi in limits)  # type: ignore[return-value]


#: Fixed value: heads that get a default smoother.
SMOOTHED = ["kfstd", "ukffreq", "pll"]


def default_smoothing(alpha: Column, head: Column) -> Column:
    return F.when(head.isin(SMOOTHED) & ~F.coalesce((alpha > 0) & (alpha < 1), F.lit(False)), 0.88).otherwise(alpha)
