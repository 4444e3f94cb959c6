"""Conditioning, spectra and filters against numpy on small series, with degenerate input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import conditioning as C
from cadenza.operators import filters as K
from cadenza.operators import spectral as S

NAN = float("nan")


def frame(spark, series):
    rows = [(k, n, float(v)) for k, y in series.items() for n, v in enumerate(y)]
    return spark.createDataFrame(rows, "key string, n int, y double")


def lists(df, value="y"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["key"], r["n"])):
        out.setdefault(r["key"], []).append(r[value])
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(0)
    t = np.arange(120)
    return {"a": np.sin(2 * np.pi * 0.3 * t / 10 + 0.4) + 0.1 * rng.normal(size=120), "b": rng.normal(size=120).cumsum()}


def test_detrend_and_zscore(spark, noise):
    s = frame(spark, noise | {"c": [5.0], "d": [2.0, 2.0, 2.0]})
    got = lists(C.detrend_linear(s, ["key"]))
    n = np.arange(120)
    for k in "ab":
        p = np.polyfit(n, noise[k], 1)
        assert np.allclose(got[k], noise[k] - np.polyval(p, n))
    assert got["c"] == [0.0] and np.allclose(got["d"], 0)
    z = lists(C.zscore(s, ["key"]))
    assert np.allclose(z["b"], (noise["b"] - noise["b"].mean()) / (noise["b"].std() + 1e-8)) and z["d"] == [0, 0, 0]


def test_robust_zscore_is_affine_invariant(spark, noise):
    s = frame(spark, {"a": noise["b"], "b": 3 * noise["b"] + 7, "c": [4.0] * 9})
    z = lists(C.robust_zscore(s, ["key"], limit=1.5))
    assert np.allclose(z["a"], z["b"]) and max(map(abs, z["a"])) <= 1.5
    assert z["c"] == [0.0] * 9


def test_clean(spark):
    s = frame(spark, {"a": [1.0, NAN, float("inf")]})
    assert lists(C.clean(s))["a"] == [1.0, 0.0, float("inf")]
    assert lists(C.clean(s, drop=True))["a"] == [1.0]


def test_windows_and_extension(spark):
    s = frame(spark, {"a": np.arange(10.0), "b": [1.0, 2.0]})
    w = C.sliding_windows(s, ["key"], 4, 3, 2.0).where("key = 'a'").groupBy("win", "t_center").agg(F.array_sort(F.collect_list("n")).alias("n")).orderBy("win").collect()
    assert [(r.win, r.t_center, r.n) for r in w] == [(0, 1.0, [0, 1, 2, 3]), (1, 2.5, [3, 4, 5, 6]), (2, 4.0, [6, 7, 8, 9])]
    assert C.sliding_windows(s, ["key"], 4, 3, 2.0).where("key = 'b'").count() == 0
    e = {r.n: r.y for r in C.even_extend(s.where("key = 'a'"), ["key"], 2).collect()}
    assert [e[n] for n in range(-2, 12)] == [2, 1, *range(10), 8, 7]


def test_ema(spark, noise):
    got = lists(C.ema(frame(spark, noise), ["key"], 0.9))["a"]
    s = [noise["a"][0]]
    for v in noise["a"][1:]:
        s.append(0.9 * s[-1] + 0.1 * v)
    assert np.allclose(got, s)
    assert lists(C.ema(frame(spark, noise), ["key"], 1.0))["a"] == list(noise["a"])


def test_welch_matches_fft(spark, noise):
    got = {(r.key, round(r.freq, 9)): r.power for r in S.welch_psd(frame(spark, noise), ["key"], 10.0, 40).collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(40) / 40)
    for k, y in noise.items():
        parts = [y[i : i + 40] for i in range(0, 81, 20)]
        p = np.mean([np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 for x in parts], 0) / (10 * (w**2).sum())
        p[1:-1] *= 2
        assert np.allclose([got[k, round(i / 4, 9)] for i in range(21)], p)


def test_tone_is_found(spark):
    fs, f, n = 10.0, 0.5, 200
    s = frame(spark, {"t": np.cos(2 * np.pi * f * np.arange(n) / fs + 0.3)})
    one = lambda df: df.first()
    assert abs(one(S.welch_candidate(s, ["key"], fs, n, 0.1, 2.0)).hz - f) <= fs / n
    assert abs(one(S.autocorr_candidate(s, ["key"], fs, n, 0.1, 2.0)).hz - f) < 0.05
    assert abs(one(S.freq_crossings(s, ["key"], fs)).hz - f) < 1e-3
    assert abs(one(S.freq_fft(s, ["key"], fs, n)).hz - f) < 5e-3
    assert abs(one(S.freq_autocorr(s, ["key"], fs, n)).hz - f) < 5e-3
    assert abs(one(K.hilbert_candidate(s, ["key"], fs, 0.1, 2.0)).hz - f) < 5e-3


def test_parabola(spark):
    s = frame(spark, {"p": [2, 3, 1, 6, 4, 2, 3, 1]})
    r = S.parabolic_peak(s, ["key"], "n", "y").first()
    assert (r.x, r.y) == pytest.approx((3.2142857142857144, 6.1607142857142856))


def test_thd_of_harmonics(spark):
    t = np.arange(64)
    y = sum(a * np.cos(2 * np.pi * 4 * h * t / 64) for h, a in ((1, 1), (2, 0.5), (3, 0.25)))
    from cadenza.plans.signals import periodogram

    assert S.thd(periodogram(frame(spark, {"h": y})), ["key"], 2.0, 6.0).first().thd == pytest.approx(0.3125)


def test_coarse_frequency(spark):
    rows = [("a", 5.0, 1.0, "x"), ("a", 7.0, 3.0, "y"), ("a", NAN, 9.0, "z"), ("b", None, 0.0, "x"), ("c", 99.0, 1.0, "x")]
    got = {r.key: r for r in S.coarse_frequency(spark.createDataFrame(rows, "key string, hz double, confidence double, label string"), ["key"], 4.0, 16.0).collect()}
    assert got["a"].hz == pytest.approx(6.5) and got["a"].raw_hz == 7.0 and len(got["a"].candidates) == 2
    assert got["b"].hz == 10.0 and got["c"].hz == pytest.approx(15.99)


def test_multitaper(spark):
    v = S.slepian_tapers(32, 3.0, 5)
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-9)
    y = np.cos(2 * np.pi * 2.0 * np.arange(96) / 16)
    m = S.multitaper_spectrogram(frame(spark, {"t": y}), ["key"], 16.0, 32, 32)
    top = m.groupBy("t_center").agg(F.max_by("freq", "power").alias("f")).collect()
    assert len(top) == 3 and all(abs(r.f - 2.0) <= 1.0 for r in top)


def test_butterworth():
    b, a = K.butterworth(2, 20.0, 0.08, 0.5)
    assert np.allclose(b, [0.00397627, 0, -0.00795254, 0, 0.00397627], atol=1e-8)
    assert np.allclose(a, [1, -3.80633403, 5.44313093, -3.46655852, 0.82977586], atol=1e-7)
    b, a = K.butterworth(6, 64.0, None, 12.0)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 64)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 64)))
    assert gain(0) == pytest.approx(1) and gain(12) == pytest.approx(1 / math.sqrt(2))


def test_zero_phase(spark):
    t = np.arange(300)
    y = np.cos(2 * np.pi * 1.0 * t / 20)
    s = frame(spark, {"t": y, "short": y[:10]})
    for edges in ("pad", "gust"):
        got = lists(K.bandpass(s.where("key = 't'"), ["key"], 20.0, 0.5, 2.0, edges))["t"]
        assert np.abs(np.array(got)[60:-60] - y[60:-60]).max() < 0.02
    assert lists(K.bandpass(s, ["key"], 20.0, 0.5, 2.0))["short"] == [None] * 10


def test_gust_agrees_both_ways():
    rng = np.random.default_rng(2)
    b, a = K.butterworth(2, 20.0, 0.5, 2.0)
    y = rng.normal(size=(2, 150))
    there = K.filtfilt_gust(b, a, y)
    back = K.filtfilt_gust(b, a, y[:, ::-1])[:, ::-1]
    assert np.allclose(there, back, atol=1e-6)


def model(s, fs, f0, **kw):
    p = {"fs": fs, "f0": f0, "rho": 0.99, "qx": 1e-3, "rv": 0.05, "qf": 1e-4} | kw
    return s.withColumns({k: F.lit(float(v)) for k, v in p.items()})


def test_kalman_and_smoother(spark, noise):
    s = frame(spark, noise)
    got = lists(K.kf_states(model(s, 10.0, 0.3), ["key"], smooth=True), "x1")["a"]
    w, n = 2 * np.pi * 0.3 / 10, 120
    f = 0.99 * np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]])
    x, p, xs, ps, xp, pp = np.zeros(2), np.eye(2) * 1e-3, [], [], [], []
    for v in noise["a"]:
        xp.append(f @ x)
        pp.append(f @ p @ f.T + np.eye(2) * 1e-3)
        k = pp[-1][:, 0] / (pp[-1][0, 0] + 0.05)
        x, p = xp[-1] + k * (v - xp[-1][0]), pp[-1] - np.outer(k, pp[-1][0])
        p = 0.5 * (p + p.T)
        xs.append(x)
        ps.append(p)
    for t in range(n - 2, -1, -1):
        xs[t] = xs[t] + ps[t] @ f.T @ np.linalg.pinv(pp[t + 1]) @ (xs[t + 1] - xp[t + 1])
    assert np.allclose(got, [v[0] for v in xs], atol=1e-8)


def one_ukf(y, fs, f0, rho, qx, rv, qf, lo, hi, nu=None):
    """A plain, sample by sample unscented filter, written from its equations."""
    al, be, n = 1e-3, 2.0, 3
    lam = al**2 * n - n
    c = max(n + lam, 1e-9)
    wm = np.r_[lam / c, np.full(6, 0.5 / c)]
    wc = wm.copy()
    wc[0] += 1 - al**2 + be
    x, p, track = np.array([0, 0, math.log(f0)]), np.diag([1, 1, 0.0625]), []
    for v in y:
        p = 0.5 * (p + p.T)
        r = np.linalg.cholesky(p + 1e-9 * max(1, p.diagonal().max()) * np.eye(3)) * math.sqrt(c)
        sg = np.vstack([x, *(x + r[:, i] for i in range(3)), *(x - r[:, i] for i in range(3))])
        mv = []
        for a, b, l in sg:
            w = 2 * np.pi * np.clip(np.exp(l), lo, hi) / fs
            mv.append([rho * (np.cos(w) * a - np.sin(w) * b), rho * (np.sin(w) * a + np.cos(w) * b), l if nu else np.clip(l, math.log(lo), math.log(hi))])
        mv = np.array(mv)
        m = wm @ mv
        q = np.diag([qx, qx, qf * (np.clip(np.hypot(m[0], m[1]) / (2 * math.sqrt(rv)), 0.1, 1) if nu else 1)])
        d = mv - m
        pred = q + (wc[:, None] * d).T @ d
        s = rv + (wc * d[:, 0]) @ d[:, 0]
        pxz = (wc * d[:, 0]) @ d
        e = v - m[0]
        if nu:
            wt = (nu + 1) / (nu + e * e / s)
            s = s - rv + rv / max(wt, 1e-4)
            k = pxz / s
            p = pred - s * np.outer(k, k)
        else:
            k = pxz / s
            h = np.eye(3)
            h[:, 0] -= k
            p = h @ pred @ h.T + rv * np.outer(k, k)
        x = m + k * e
        p = 0.5 * (p + p.T)
        p[np.diag_indices(3)] = np.maximum(p.diagonal(), 1e-8)
        x[2] = np.clip(x[2], math.log(lo), math.log(hi))
        track.append(math.exp(x[2]))
    return track


@pytest.mark.parametrize("nu", [None, 4.0])
def test_unscented_filters(spark, nu):
    fs, t = 10.0, np.arange(300)
    y = np.cos(2 * np.pi * 0.31 * t / fs)
    y[::50] += 4
    s = frame(spark, {"a": y, "b": y[:40]})
    got = lists(K.ukf_tracks(model(s, fs, 0.35), ["key"], 0.1, 1.0, nu), "track_hz")
    assert np.allclose(got["a"], one_ukf(y, fs, 0.35, 0.99, 1e-3, 0.05, 1e-4, 0.1, 1.0, nu), rtol=1e-4)
    assert len(got["b"]) == 40
    assert abs(np.median(got["a"]) - 0.31) * 60 < 1.0


def test_custom_filter(spark, noise):
    K.register_filter("twice", lambda arrays, f: {"y2": [2 * a for a in arrays]}, {"y2": "array<double>"})
    packed = K.pack(frame(spark, noise), ["key"])
    assert np.allclose(lists(K.unpack(K.run_filter(packed, ["key"], "twice"), ["key"], ["y2"]), "y2")["b"], 2 * noise["b"])


def dense(prior, cross, y, r):
    """Mean and covariance of Gaussian states given all samples, by one dense solve; cross: Cov(state, sample)."""
    g = np.linalg.solve(prior + r * np.eye(len(y)), cross.T).T
    return g @ y, g


def dense_level(y, q, r):
    n = len(y)
    t = np.arange(n)
    c = 1 + q * (np.minimum(t[:, None], t) + 1)
    m, g = dense(c, c, y, r)
    v = c - g @ c
    p, d = np.diag(v), y - m
    steps = (np.diff(m) ** 2 + p[1:] + p[:-1] - 2 * np.diag(v, 1)).sum()
    return np.array([n, n - 1, (d * d + p).sum(), steps, -0.5 * (np.log(2 * np.pi * (p + r)) + d * d / (p + r)).sum()])


def test_oscillator_moments():
    a, w, q, r = 0.9, 0.7, 0.2, 0.5
    rng = np.random.default_rng(11)
    f = a * np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]])
    want, arrays = np.zeros(7), [rng.normal(size=k) for k in (12, 20, 12)]
    for y in arrays:
        n = len(y)
        var = [f @ (q * np.eye(2)) @ f.T + q * np.eye(2)]
        for _ in range(n - 1):
            var.append(f @ var[-1] @ f.T + q * np.eye(2))
        c = np.zeros((2 * n, 2 * n))
        for s in range(n):
            x = var[s]
            for t in range(s, n):
                c[2 * t : 2 * t + 2, 2 * s : 2 * s + 2] = x
                c[2 * s : 2 * s + 2, 2 * t : 2 * t + 2] = x.T
                x = f @ x
        m, g = dense(c[::2, ::2], c[:, ::2], y, r)
        v = c - g @ c[::2]
        e = (np.outer(m, m) + v).reshape(n, 2, n, 2).transpose(0, 2, 1, 3)
        s00, s11 = sum(e[t, t] for t in range(n - 1)), sum(e[t, t] for t in range(1, n))
        s10 = sum(e[t, t - 1] for t in range(1, n))
        want += [n, np.trace(s00), np.trace(s10), s10[1, 0] - s10[0, 1], np.trace(s11), ((y - m[::2]) ** 2 + np.diag(v)[::2]).sum(), n - 1]
    assert np.allclose(K.oscillator_statistics(arrays, a, w, q, r), want)


def test_ema_restarts(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 4.0), ("a", 3, 8.0), ("b", 5, 2.0)]
    got = C.ema(spark.createDataFrame(rows, "key string, n int, y double"), ["key"], 0.5).collect()
    assert {(r.key, r.n): r.y for r in got} == {("a", 0): 1.0, ("a", 1): None, ("a", 2): 4.0, ("a", 3): 6.0, ("b", 5): 2.0}


def test_em(spark):
    rng = np.random.default_rng(3)
    seqs = {str(i): rng.normal(scale=0.03, size=40 + i % 2).cumsum() + rng.normal(scale=0.1, size=40 + i % 2) for i in range(4)}
    packed = K.pack(frame(spark, seqs | {"short": [1.0] * 5}), ["key"])
    q, r, ll, rounds = K.em_local_level(packed, ["key"], iterations=6)
    a, b = 3e-4, 5e-3
    for _ in range(6):
        st = sum(dense_level(y, a, b) for y in seqs.values())
        a, b, last = float(np.clip(st[3] / st[1], 5e-6, 5e-3)), float(np.clip(st[2] / st[0], 1e-5, 0.05)), st[4]
    assert (q, r, ll) == pytest.approx((a, b, last), rel=1e-4) and rounds == 6
    w = 2 * np.pi / 12
    osc = {"o": np.cos(w * np.arange(200)) + 0.05 * rng.normal(size=200)}
    e = K.oscillator_em(K.pack(frame(spark, osc), ["key"]), ["key"], w * 1.1, iterations=12)
    assert e["w"] == pytest.approx(w, rel=0.03) and 0.95 < e["a"] < 1


def test_oscillator_em_query_runs_all_rounds(spark, tmp_path, monkeypatch):
    from cadenza.plans import QUERIES

    rng = np.random.default_rng(6)
    vectors = [(i, f"l{i % 2}", [float(v) for v in np.cos(2 * np.pi * 8 * np.arange(64) / 64 + i) + 0.3 * rng.normal(size=64)]) for i in range(6)]
    spark.createDataFrame(vectors, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rounds, sums = [], K._sums
    monkeypatch.setattr(K, "_sums", lambda *a: rounds.append(1) or sums(*a))
    got = QUERIES["oscillator_em"](spark, str(tmp_path)).first()
    assert len(rounds) == 50 and 0 < got.a < 1


def test_block_append(spark):
    t = np.arange(200)
    y = np.cos(2 * np.pi * t / 20) + np.cos(2 * np.pi * t / 6)
    blocks = [{"a": 0.99, "w": 2 * np.pi / 20, "q": 0.01}, {"a": 0.99, "w": 2 * np.pi / 6, "q": 0.01}]
    rows = K.block_append(K.pack(frame(spark, {"a": y}), ["key"]), ["key"], blocks, 0.05).collect()
    got = {c: [r.x for r in sorted(rows, key=lambda r: r.n) if r.component == c] for c in (0, 1)}
    assert np.abs(np.array(got[0])[100:] - np.cos(2 * np.pi * t / 20)[100:]).max() < 0.15


def test_coupling(spark):
    ph = np.linspace(0, 8 * np.pi, 401)[:-1]
    rows = [("a", float(p), float(2 + 0.8 * np.cos(p - 0.7))) for p in ph]
    r = K.phase_amplitude_coupling(spark.createDataFrame(rows, "key string, p double, a double"), ["key"], "p", "a").first()
    assert (r.a0, r.k, r.phi_mod) == pytest.approx((2.0, 0.4, 0.7))


def test_guidance_branches(spark):
    rows = [(1.0, 9.0, 9.0), (2.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "key double, confidence double, snr double").withColumns({"qx": F.lit(1e-3), "qf": F.lit(1e-4), "rv": F.lit(0.5)})
    a, b = K.spectral_guidance(d, offset=0.5).orderBy("key").collect()
    assert a.qf < 1e-4 < b.qf and a.rv < 0.5 < b.rv and a.qx < 1e-3 < b.qx
    assert K.spectral_guidance(d, strength=0.0).first().qf == 1e-4


def test_estimator_on_tones(spark):
    from cadenza.plans.tracking import estimate_rates

    fs, n = 10.0, 400
    rng = np.random.default_rng(1)
    s = frame(spark, {str(f): np.cos(2 * np.pi * f * np.arange(n) / fs) + 0.2 * rng.normal(size=n) for f in (0.2, 0.3)})
    for head in ("kfstd", "ukffreq", "robust_attention"):
        got = {r.key: r.rr_hz for r in estimate_rates(s, ["key"], fs, n, 0.08, 0.5, head).collect()}
        assert all(abs(got[k] - float(k)) * 60 < 1.5 for k in got), (head, got)
