"""Recursions along one series over many tasks.

A series is cut into chunks by its places n. Each chunk alone gives a summary of what it does to whatever state enters
it (an affine map; for the Kalman filter, the map of mean and covariance); a scan over a key's summaries, one row for a
chunk, gives the state that enters each; then all chunks run at once, each from its own. A task holds some chunks, never
a series, and the chunks of an Arrow batch are stepped together in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = list[str]
#: Places of a chunk.
CHUNK = 4096


def chunked(signal: DataFrame, keys: Keys, size: int = CHUNK, extra: list[str] | None = None) -> DataFrame:
    """keys, chunk, extra (constant per key), n and y: each chunk's samples as arrays in order of n."""
    extra = extra or []
    at = F.floor(F.col("n") / size).cast("long")
    g = signal.groupBy(*keys, at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "y"))).alias("_s"), *[F.first(c).alias(c) for c in extra])
    return g.select(*keys, "chunk", *extra, F.transform("_s", lambda s: s["n"]).alias("n"), F.transform("_s", lambda s: s["y"]).alias("y"))


def unchunked(chunks: DataFrame, keys: Keys, columns: list[str]) -> DataFrame:
    """Long rows (keys, n, columns) of array columns."""
    r = chunks.select(*keys, F.explode(F.arrays_zip("n", *columns)).alias("_r"))
    return r.select(*keys, "_r.n", *[F.col(f"_r.{c}").alias(c) for c in columns])


#: Places that fn is given at a time, chunks padded to the longest among them.
PLACES = 1 << 17


def parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive rows that have at most PLACES places together once padded, or one row."""
    lo = longest = 0
    for i, size in enumerate(b["n" if "n" in b else "at"].map(len).tolist() if len(b) else []):
        if i > lo and max(longest, size) * (i - lo + 1) > PLACES:
            yield b.iloc[lo:i]
            lo, longest = i, 0
        longest = max(longest, size)
    if lo < len(b):
        yield b.iloc[lo:]


def each(chunks: DataFrame, keep: list[str], fn: Callable[[pd.DataFrame], dict], out: dict[str, str]) -> DataFrame:
    """The columns keep of each Arrow batch and what fn makes of it, a part at a time; out: names and types of fn's
    columns."""
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in parts(b):
                yield pd.DataFrame({k: part[k] for k in keep} | fn(part))

    return chunks.mapInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{n}` {t}" for n, t in out.items()]))


def carried(summaries: DataFrame, keys: Keys, step: Callable, first: Callable, backward: bool = False) -> DataFrame:
    """keys, chunk, state: the state that enters each chunk.

    summaries: keys, chunk, and what step reads. first(row): the state that enters a key's first chunk (backward: the
    last one); step(state, row): the state that leaves it. Rows stream through a task one by one: a key costs one row
    for a chunk, and no memory.
    """
    kinds = dict(summaries.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            states = []
            names = list(zip(*[b[k].tolist() for k in keys], strict=True)) if keys else [()] * len(b)
            for name, row in zip(names, b.itertuples(index=False), strict=True):
                if name != last:
                    last, state = name, first(row)
                states.append(state)
                state = step(state, row)
            yield b[[*keys, "chunk"]].assign(state=[np.asarray(s, float).ravel() for s in states])

    order = F.desc("chunk") if backward else F.asc("chunk")
    dealt = (summaries.repartition(*keys) if keys else summaries.repartition(1)).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "chunk long, state array<double>")


def stack(arrays) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with NaN to the longest, and their lengths; nulls are NaN."""
    n = np.array([len(a) for a in arrays], int)
    y = np.full((len(n), n.max(initial=0)), np.nan)
    for i, a in enumerate(arrays):
        y[i, : n[i]] = np.asarray(a, float)
    return y, n


def _cut(x: np.ndarray, n: np.ndarray) -> list:
    return [x[i, :k] for i, k in enumerate(n)]


# ---- linear filters ------------------------------------------------------------------------------------------------


def filtered(b: np.ndarray, a: np.ndarray, y: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of y through b / a from their states (transposed direct form II), and the states after n samples each."""
    z, last, out = state.astype(float).copy(), state.astype(float).copy(), np.zeros_like(y)
    for t in range(y.shape[1]):
        x = y[:, t]
        v = b[0] * x + z[:, 0]
        out[:, t] = v
        z = np.c_[z[:, 1:], np.zeros(len(z))] + np.outer(x, b[1:]) - np.outer(v, a[1:])
        ends = n == t + 1
        last[ends] = z[ends]
    return out, last


def linear_filter(signal: DataFrame, keys: Keys, b: np.ndarray, a: np.ndarray, settled: np.ndarray | None = None, size: int = CHUNK) -> DataFrame:
    """keys, n, y through b / a in order of n. settled: the state that a constant 1 settles to; a key then starts from
    it times its first sample, else at rest."""
    order = len(a) - 1
    move = np.c_[-a[1:], np.eye(order)[:, :-1]]
    powers: dict[int, np.ndarray] = {}

    def summary(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        return {"left": list(filtered(b, a, np.nan_to_num(y), n, np.zeros((len(n), order)))[1]), "size": n, "y0": y[:, 0]}

    def step(state, row):
        if row.size not in powers:
            powers[row.size] = np.linalg.matrix_power(move, row.size)
        return powers[row.size] @ state + row.left

    def whole(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        return {"y": _cut(filtered(b, a, np.nan_to_num(y), n, np.stack(list(f["state"])))[0], n)}

    chunks = chunked(signal, keys, size)
    s = each(chunks, [*keys, "chunk"], summary, {"left": "array<double>", "size": "long", "y0": "double"})
    enters = carried(s, keys, step, lambda row: np.zeros(order) if settled is None else settled * row.y0)
    kinds = dict(chunks.dtypes)
    done = each(chunks.join(enters, [*keys, "chunk"]).withColumnRenamed("n", "at"), [*keys, "at"], whole, {"y": "array<double>"})
    return unchunked(done.withColumn("n", F.col("at").cast(kinds["n"])), keys, ["y"])


def zero_phase(signal: DataFrame, keys: Keys, b: np.ndarray, a: np.ndarray, settled: np.ndarray, pad: int, size: int = CHUNK) -> DataFrame:
    """keys, n, y through b / a forward and backward, extended by pad samples mirrored through the end samples; keys of
    at most pad samples give nulls. Places n must be whole and without gaps."""
    ends = signal.groupBy(*keys).agg(F.min("n").alias("_a"), F.max("n").alias("_z"), F.min_by("y", "n").alias("_ya"), F.max_by("y", "n").alias("_yz"))
    s = signal.select(*keys, "n", "y").join(ends, keys)
    short = s.where(F.col("_z") - F.col("_a") < pad).select(*keys, "n", F.lit(None).cast("double").alias("y"))
    s = s.where(F.col("_z") - F.col("_a") >= pad)
    low = s.where((F.col("n") > F.col("_a")) & (F.col("n") <= F.col("_a") + pad)).withColumn("y", 2 * F.col("_ya") - F.col("y")).withColumn("n", 2 * F.col("_a") - F.col("n"))
    high = s.where((F.col("n") < F.col("_z")) & (F.col("n") >= F.col("_z") - pad)).withColumn("y", 2 * F.col("_yz") - F.col("y")).withColumn("n", 2 * F.col("_z") - F.col("n"))
    x = s.unionByName(low).unionByName(high).select(*keys, "n", "y")
    for _ in range(2):
        x = linear_filter(x, keys, b, a, settled, size).select(*keys, (-F.col("n")).alias("n"), "y")
    inside = x.join(ends.select(*keys, "_a", "_z"), keys).where(F.col("n").between(F.col("_a"), F.col("_z")))
    return inside.select(*keys, "n", "y").unionByName(short)


def exponential(signal: DataFrame, keys: Keys, alpha: float, size: int = CHUNK) -> DataFrame:
    """keys, n, y: y = alpha times the value before + (1 - alpha) times the sample; a missing sample (null, NaN) gives
    null, and smoothing starts anew after it."""

    def run(y: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, last = np.empty_like(y), state.copy()
        for t in range(y.shape[1]):
            state = np.where(np.isnan(state), y[:, t], alpha * state + (1 - alpha) * y[:, t])
            out[:, t] = state
            last[n == t + 1] = state[n == t + 1]
        return out, last

    def summary(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        _, anew = run(y, n, np.full(len(n), np.nan))
        _, from0 = run(y, n, np.zeros(len(n)))
        gap = np.array([np.isnan(y[i, :k]).any() for i, k in enumerate(n)])
        return {"anew": anew, "from0": from0, "gain": np.where(gap, 0.0, alpha ** n.astype(float))}

    def step(state, row):
        return row.anew if np.isnan(state) else (row.from0 if row.gain == 0 else row.gain * state + row.from0)

    def whole(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        return {"y": _cut(run(y, n, np.array([s[0] for s in f["state"]], float))[0], n)}

    chunks = chunked(signal, keys, size)
    s = each(chunks, [*keys, "chunk"], summary, {"anew": "double", "from0": "double", "gain": "double"})
    # Arrow gives NaN and null of these alike as NaN.
    enters = carried(s, keys, step, lambda row: np.nan)
    done = each(chunks.join(enters, [*keys, "chunk"]).withColumnRenamed("n", "at"), [*keys, "at"], whole, {"y": "array<double>"})
    out = unchunked(done.withColumnRenamed("at", "n"), keys, ["y"])
    return out.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


# ---- the oscillator's filter and smoother --------------------------------------------------------------------------


def _rotations(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = 2 * np.pi * f["f0"].to_numpy(float) / f["fs"].to_numpy(float)
    rho, qx, rv = (f[c].to_numpy(float) for c in ("rho", "qx", "rv"))
    return rho[:, None, None] * np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]]).transpose(2, 0, 1), qx, rv


def filter_elements(y: np.ndarray, n: np.ndarray, rot: np.ndarray, qx: np.ndarray, rv: np.ndarray) -> np.ndarray:
    """Each row's samples as one element (A, b, C, eta, J) of the associative form of Kalman filtering (Särkkä and
    García-Fernández, 2021), 16 numbers: composed with the mean and covariance before them, it gives those after."""
    k, eye = len(y), np.eye(2)
    s = qx + rv
    gain = np.stack([qx / s, np.zeros(k)], 1)
    keep = np.tile(eye, (k, 1, 1))
    keep[:, :, 0] -= gain
    a1, c1 = keep @ rot, keep * qx[:, None, None]
    row = rot[:, 0, :] / s[:, None]  # F' H' / s
    j1 = row[:, :, None] * rot[:, 0, None, :]
    big_a, b, c, eta, j = np.tile(eye, (k, 1, 1)), np.zeros((k, 2)), np.zeros((k, 2, 2)), np.zeros((k, 2)), np.zeros((k, 2, 2))
    out = np.zeros((k, 16))
    mul = lambda m, v: (m @ v[..., None])[..., 0]
    turn = lambda m: m.transpose(0, 2, 1)
    for t in range(y.shape[1]):
        b1, eta1 = gain * y[:, t, None], row * y[:, t, None]
        inv = np.linalg.inv(eye + c @ j1)
        left = a1 @ inv
        right = turn(big_a) @ turn(inv)
        eta, j, b, c, big_a = mul(right, eta1 - mul(j1, b)) + eta, right @ j1 @ big_a + j, mul(left, b + mul(c, eta1)) + b1, left @ c @ turn(a1) + c1, left @ big_a
        ends = n == t + 1
        out[ends] = np.concatenate([big_a.reshape(k, 4), b, c.reshape(k, 4), eta, j.reshape(k, 4)], 1)[ends]
    return out


def _after(state: np.ndarray, element: np.ndarray) -> np.ndarray:
    """(mean, covariance) after an element's samples, from those before."""
    m, p = state[:2], state[2:].reshape(2, 2)
    a, b, c, eta, j = element[:4].reshape(2, 2), element[4:6], element[6:10].reshape(2, 2), element[10:12], element[12:].reshape(2, 2)
    left = a @ np.linalg.inv(np.eye(2) + p @ j)
    return np.r_[left @ (m + p @ eta) + b, (left @ p @ a.T + c).ravel()]


def kalman(signal: DataFrame, keys: Keys, model: list[str], run: Callable, smooth: bool = False, size: int = CHUNK) -> DataFrame:
    """keys, n, x1, x2: the oscillator filter (or smoother) of a series of any length.

    run(y, w, rho, qx, rv, state): filtered means and covariances (x1, x2, p11, p12, p22; rows x samples) of rows from
    states (mean, covariance; six numbers). signal: keys, n, y and the model's columns per key.
    """
    chunks = chunked(signal, keys, size, model)
    mine = [*keys, "chunk"]

    def summary(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        return {"element": list(filter_elements(np.nan_to_num(y), n, *_rotations(f))), "qx0": f["qx"].to_numpy(float)}

    s = each(chunks, mine, summary, {"element": "array<double>", "qx0": "double"})
    enters = carried(s, keys, lambda state, row: _after(state, row.element), lambda row: np.array([0, 0, row.qx0, 0, 0, row.qx0]))
    names = ["x1", "x2", "p11", "p12", "p22"]

    def whole(f: pd.DataFrame) -> dict:
        y, n = stack(f["y"])
        w = 2 * np.pi * f["f0"].to_numpy(float) / f["fs"].to_numpy(float)
        x = run(np.nan_to_num(y), w, *[f[c].to_numpy(float) for c in ("rho", "qx", "rv")], np.stack(list(f["state"])))
        return {c: _cut(x[i], n) for i, c in enumerate(names if smooth else names[:2])}

    filtered_ = each(chunks.join(enters, mine).withColumnRenamed("n", "at"), [*mine, "at", *(model if smooth else [])], whole, dict.fromkeys(names if smooth else names[:2], "array<double>"))
    if not smooth:
        return unchunked(filtered_.withColumnRenamed("at", "n"), keys, ["x1", "x2"])

    def gains(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per sample the smoother's gain e and offset g: smoothed = e @ the next one's + g."""
        rot, qx, _ = _rotations(f)
        x1, n = stack(f["x1"])
        x = np.stack([x1, stack(f["x2"])[0]], -1)
        p11, p12, p22 = (np.nan_to_num(stack(f[c])[0], nan=1.0 if c != "p12" else 0.0) for c in names[2:])
        p = np.stack([np.stack([p11, p12], -1), np.stack([p12, p22], -1)], -2)
        r = rot[:, None]
        e = p @ r.swapaxes(-1, -2) @ np.linalg.pinv(r @ p @ r.swapaxes(-1, -2) + qx[:, None, None, None] * np.eye(2))
        return x, n, e, x - (e @ (r @ x[..., None]))[..., 0]

    def backward(f: pd.DataFrame) -> dict:
        x, n, e, g = gains(f)
        out = []
        for i, k in enumerate(n):
            m, v = np.eye(2), np.zeros(2)
            for t in range(k - 1, 0 - 1, -1):
                m, v = e[i, t] @ m, e[i, t] @ v + g[i, t]
            # A series' last sample is smoothed by itself: what is before it, without the map of its own.
            h, u = np.eye(2), np.zeros(2)
            for t in range(k - 2, -1, -1):
                h, u = e[i, t] @ h, e[i, t] @ u + g[i, t]
            out.append(np.r_[m.ravel(), v, h @ x[i, k - 1] + u])
        return {"back": out}

    b = each(filtered_, mine, backward, {"back": "array<double>"})

    def step(state, row):
        m, v, own = row.back[:4].reshape(2, 2), row.back[4:6], row.back[6:]
        return own if np.isnan(state[0]) else m @ state + v

    follows = carried(b, keys, step, lambda row: np.full(2, np.nan), backward=True)

    def smoothed(f: pd.DataFrame) -> dict:
        x, n, e, g = gains(f)
        s = np.stack(list(f["state"]))
        out = np.full_like(x, np.nan)
        width = x.shape[1]
        for t in range(width - 1, -1, -1):
            live = n > t
            moved = (e[:, t] @ s[..., None])[..., 0] + g[:, t]
            s = np.where(live[:, None], np.where(np.isnan(s), x[:, t], moved), s)
            out[:, t] = s
        return {"x1": _cut(out[..., 0], n), "x2": _cut(out[..., 1], n)}

    done = each(filtered_.join(follows, mine), [*keys, "at"], smoothed, {"x1": "array<double>", "x2": "array<double>"})
    return unchunked(done.withColumnRenamed("at", "n"), keys, ["x1", "x2"])
