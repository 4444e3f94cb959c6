"""Long series of one key over many chunks against one pass, and operators that must not gather a key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import conditioning as C
from cadenza.operators import filters as K
from cadenza.operators import scans

KEYS = ["key"]


@pytest.fixture(scope="module")
def long(spark):
    """One key of 20,000 samples and two short ones."""
    rng = np.random.default_rng(7)
    y = {"a": rng.normal(size=20_000) + np.sin(np.arange(20_000) / 5), "b": rng.normal(size=37), "c": rng.normal(size=1)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"key": k, "n": np.arange(len(v)), "y": v}) for k, v in y.items()])).repartition(4).cache()
    return df, y


def arrays(df, *cols):
    p = df.orderBy("key", "n").toPandas()
    return {k: [g[c].to_numpy(float) for c in cols] for k, g in p.groupby("key")}


def test_lowpass_in_chunks(long):
    df, y = long
    b, a = K.butterworth(6, 64.0, None, 12.0)
    got = arrays(K.lowpass(df, KEYS, 64.0, 12.0, size=400), "y")
    for k, v in y.items():
        assert np.allclose(got[k][0], K.lfilter(b, a, v[None])[0], atol=1e-9)


def test_no_task_holds_a_series(long, monkeypatch):
    df, _ = long
    s = scans.chunked(df, KEYS, 400)
    assert s.where("key = 'a'").count() == 50 and s.agg(F.max(F.size("y"))).first()[0] == 400


def test_bandpass_in_chunks(long):
    df, y = long
    b, a = K.butterworth(2, 64.0, 4.0, 16.0)
    got = arrays(K.bandpass(df, KEYS, 64.0, 4.0, 16.0, size=400), "y")
    assert np.allclose(got["a"][0], K.filtfilt_pad(b, a, y["a"][None])[0], atol=1e-9)
    assert np.allclose(got["b"][0], K.filtfilt_pad(b, a, y["b"][None])[0], atol=1e-9)
    assert np.isnan(got["c"][0]).all()


def test_ema_in_chunks(long):
    df, y = long
    df = df.withColumn("y", F.when(F.col("n") % 997 != 500, F.col("y")))
    got = arrays(C.ema(df, KEYS, 0.9, size=300), "y")["a"][0]
    state, want = np.nan, []
    for i, v in enumerate(y["a"]):
        v = np.nan if i % 997 == 500 else v
        state = v if np.isnan(state) else 0.9 * state + 0.1 * v
        want.append(state)
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("smooth", [False, True])
def test_kalman_in_chunks(long, smooth):
    df, y = long
    s = df.withColumns({c: F.lit(v) for c, v in {"fs": 64.0, "f0": 8.0, "rho": 0.98, "qx": 0.01, "rv": 0.05, "qf": 5e-4}.items()})
    got = arrays(K.kf_states(s, KEYS, smooth, size=400), "x1", "x2")
    one = lambda x: np.array([x])
    for k, v in y.items():
        n, w = one(len(v)), one(2 * np.pi * 8 / 64)
        r = K.kf(v[None], n, w, one(0.98), one(0.01), one(0.05))
        want = K.rts(r, n, w, one(0.98)) if smooth else r["filtered"][:2]
        assert np.allclose(got[k][0], want[0][0], atol=1e-9) and np.allclose(got[k][1], want[1][0], atol=1e-9)


def test_scans_of_empty_tables(spark):
    df = spark.createDataFrame([], "key string, n int, y double")
    model = df.withColumns({c: F.lit(1.0) for c in K.MODEL})
    for out in (K.lowpass(df, KEYS, 64.0, 12.0), C.ema(df, KEYS, 0.5), K.bandpass(df, KEYS, 64.0, 4.0, 16.0), K.kf_states(model, KEYS), K.kf_states(model, KEYS, True)):
        assert out.collect() == []


def test_nearest_match_of_one_hot_key(spark):
    from cadenza.operators import evaluate as E

    rng = np.random.default_rng(3)
    es = pd.DataFrame({"key": "a", "t": rng.integers(0, 50_000, 3000), "idx": np.arange(3000), "v": rng.normal(size=3000)})
    gt = pd.DataFrame({"key": "a", "t": np.r_[rng.integers(0, 9_000, 300), rng.integers(40_000, 45_000, 40)], "idx": np.arange(340), "v": rng.normal(size=340)})
    es.loc[:4, "key"] = "none"
    got = E.nearest_match(spark.createDataFrame(es), spark.createDataFrame(gt), KEYS, slots=16).toPandas().sort_values("idx")
    t, i = gt["t"].to_numpy(), gt["idx"].to_numpy()
    for key, at, found in zip(got["key"], got["t"], got["gt_idx"], strict=True):
        if key == "none":
            assert pd.isna(found)
        else:
            d = np.abs(t - at)
            assert found == i[d == d.min()].min()
    dealt = spark.createDataFrame(es).repartitionByRange(16, "key", "t").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 3000 / 4


def test_windows_over_chunks(long, monkeypatch):
    from cadenza.operators import spectral as S

    df, y = long
    monkeypatch.setattr(S, "BLOCK", 500)
    got = S.welch_psd(df, KEYS, 64.0, 60, 45, 128, lo=2.0, hi=20.0, per_window=True).where("key = 'a'").orderBy("win", "freq").toPandas()
    x = np.lib.stride_tricks.sliding_window_view(y["a"], 60)[::15]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(60) / 60)
    p = 2 * np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann, 128)) ** 2 / (64 * 0.375 * 60)
    assert np.allclose(got["power"].to_numpy().reshape(len(x), -1), p[:, 4:41], rtol=1e-9, atol=1e-12)
    assert np.allclose(got["t_center"].to_numpy()[::37], (30 + 15 * np.arange(len(x))) / 64)
    mean = S.welch_psd(df, KEYS, 64.0, 60, 45, 128, lo=2.0, hi=20.0).where("key = 'a'").orderBy("freq").toPandas()
    assert np.allclose(mean["power"], p[:, 4:41].mean(0), rtol=1e-9)


def test_correlation_over_blocks(long):
    from cadenza.operators import spectral as S

    df, y = long
    for lo, hi in ((0, 30), (90, 1300)):
        got = S.autocorrelation(df, KEYS, lo, hi, size=256).orderBy("key", "lag").toPandas()
        for k in ("a", "b"):
            v = y[k]
            want = [(lag, v[: len(v) - lag] @ v[lag:]) for lag in range(lo, min(hi, len(v) - 1) + 1)]
            g = got[got["key"] == k]
            assert g["lag"].tolist() == [w[0] for w in want] and np.allclose(g["r"], [w[1] for w in want], atol=1e-8)


def test_long_series_have_rates(spark):
    from cadenza.operators import spectral as S

    n = np.arange(100_000)
    df = spark.createDataFrame(pd.DataFrame({"key": 1, "n": n, "y": np.sin(2 * np.pi * 1.7 * n / 100.0)})).repartition(4)
    assert S.freq_autocorr(df, KEYS, 100.0, 100_000).first()["hz"] == pytest.approx(1.7, rel=1e-3)
    assert S.freq_fft(df, KEYS, 100.0, 100_000).first()["hz"] == pytest.approx(1.7, rel=1e-6)


def test_spectra_of_empty_tables(spark):
    from cadenza.operators import spectral as S

    df = spark.createDataFrame([], "key string, n int, y double")
    assert S.welch_psd(df, KEYS, 64.0, 16).collect() == [] and S.freq_fft(df, KEYS, 64.0, 64).collect() == []
    assert S.autocorrelation(df, KEYS, 0, 5).collect() == [] and S.multitaper_spectrogram(df, KEYS, 64.0, 16, 8).collect() == []


def dense_blocks(y, blocks, r):
    d = 2 * len(blocks)
    f, q, h = np.zeros((d, d)), np.zeros((d, d)), np.tile([1.0, 0.0], len(blocks))
    for i, (a, w, v) in enumerate(blocks):
        f[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = a * np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]])
        q[2 * i, 2 * i] = q[2 * i + 1, 2 * i + 1] = v
    x, p, out = np.zeros(d), q.copy(), []
    for v in y:
        x, p = f @ x, f @ p @ f.T + q
        g = p @ h / (h @ p @ h + r)
        x, p = x + g * (v - h @ x), p - np.outer(g, h @ p)
        out.append(x[::2])
    return np.array(out).T


def test_models_of_one_two_and_three_components(spark):
    rng = np.random.default_rng(5)
    models = {m: [(0.9 + 0.02 * c, 0.3 + 0.4 * c + 0.1 * m, 0.01 * (c + 1)) for c in range(m)] for m in (1, 2, 3)}
    rows = [(m, c, *v) for m, b in models.items() for c, v in enumerate(b)]
    table = K.block_models(spark.createDataFrame(rows, "model int, comp int, a double, w double, q double"), ["model"])
    y = {k: rng.normal(size=20 + k) for k in range(8)}
    df = spark.createDataFrame([(k, k % 4, n, float(v)) for k, s in y.items() for n, v in enumerate(s)], "key int, model int, n int, y double")
    got = K.block_append(K.pack(df, KEYS, ["model"]), KEYS, table, 0.05).orderBy("key", "component", "n").toPandas()
    assert set(got["key"]) == {k for k in y if k % 4}  # model 0 is not there
    for k, g in got.groupby("key"):
        assert np.allclose(g["x"].to_numpy().reshape(k % 4, -1), dense_blocks(y[k], models[k % 4], 0.05), atol=1e-12)


def test_unscented_filters_step_ragged_keys_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    calls = []
    own = K.ukf
    monkeypatch.setattr(K, "ukf", lambda *a, **k: calls.append(a[0].shape) or own(*a, **k))
    arrays = [rng.normal(size=n) for n in range(1, 60)]
    frame = pd.DataFrame({c: [v] * len(arrays) for c, v in {"fs": 64.0, "f0": 8.0, "rho": 0.98, "qx": 0.01, "rv": 0.05, "qf": 5e-4}.items()})
    got = K._ukf_columns(4.0, 16.0, 4.0)(arrays, frame)
    assert calls == [(59, 59)]
    one = lambda v: np.array([v])
    for i in (0, 20, 58):
        x, logf, w = own(arrays[i][None], *[one(v) for v in (64.0, 8.0, 0.98, 0.01, 0.05, 5e-4)], 4.0, 16.0, 4.0)
        assert np.allclose(got["signal_hat"][i], x[0]) and np.allclose(got["weight"][i], w[0]) and len(got["track_hz"][i]) == i + 1
    assert K.weight_summary(spark.createDataFrame([("a", 0.5), ("a", 1.0)], "key string, weight double"), KEYS).first()["mean_weight"] == 0.75


def test_quantiles_by_rounds_of_counts(spark, monkeypatch):
    from cadenza.operators import selection as Q

    rng = np.random.default_rng(8)
    data = {"normal": rng.normal(size=5001), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(2500, 3.25), "wide": np.exp(rng.normal(size=4000) * 4), "far": np.r_[rng.normal(size=2999), 1.5e308, -1.5e308], "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"key": k, "n": np.arange(len(v)), "y": v}) for k, v in data.items()])).repartition(4).cache()
    monkeypatch.setattr(Q, "BUCKETS", 64)
    for limit in (200, Q.LIMIT):
        got = {r.key: r.q for r in Q.quantiles(df, KEYS, F.col("y"), [0.05, 0.5], limit).collect()}
        for k, v in data.items():
            assert np.allclose(got[k], np.quantile(v, [0.05, 0.5]), rtol=1e-12), k
    want = {r.key: (r.med, r.mad) for r in C.robust_stats(df, KEYS).collect()}
    monkeypatch.setattr(Q, "LIMIT", 200)
    got = {r.key: (r.med, r.mad) for r in C.robust_stats(df, KEYS).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    assert Q.quantiles(df.where("key = ''"), KEYS, F.col("y"), [0.5], -1).collect() == []


def test_learning_steps_ragged_sequences_together(monkeypatch):
    rng = np.random.default_rng(9)
    arrays = [rng.normal(size=n) for n in range(20, 520)]
    steps = []
    own = K.model_states
    monkeypatch.setattr(K, "model_states", lambda y, *a: steps.append(y.shape) or own(y, *a))
    got = K.oscillator_statistics(arrays, 0.9, 0.7, 0.2, 0.5), K.level_statistics(arrays, 3e-4, 5e-3)
    assert steps == [(500, 519)] * 2  # as many steps as the longest
    some = arrays[::71]
    for fn, args in ((K.oscillator_statistics, (0.9, 0.7, 0.2, 0.5)), (K.level_statistics, (3e-4, 5e-3))):
        assert np.allclose(fn(some, *args), sum(fn([y], *args) for y in some))
    assert np.isfinite(got[0]).all() and np.isfinite(got[1]).all()


def test_chunks_are_handed_on_in_bounded_parts():
    import pandas as pd

    from cadenza.operators import scans

    sizes = [5, 0, 4096, 7, 3] + [1000] * 300 + [scans.PLACES + 1, 2]
    b = pd.DataFrame({"key": range(len(sizes)), "n": [[0] * k for k in sizes]})

    class Chunks:
        dtypes = [("key", "bigint"), ("n", "array<int>")]

        def mapInPandas(self, run, schema):
            return run(iter([b[:0], b]))

    seen = []
    got = list(scans.each(Chunks(), ["key"], lambda f: seen.append([len(x) for x in f["n"]]) or {"size": f["n"].map(len)}, {"size": "int"}))
    assert [k for f in got for k in f["size"]] == sizes and [k for f in got for k in f["key"]] == list(range(len(sizes)))
    assert len(seen) < 10 and all(len(x) == 1 or max(x) * len(x) <= scans.PLACES for x in seen)
