"""Matching, metrics, ranking, frames and streams on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.operators import evaluate as E
from cadenza.operators import frames as V
from cadenza.operators import ranking as R


def test_nearest_match_ties_and_gaps(spark):
    es = spark.createDataFrame([("a", 5, 0, 1.0), ("a", 10, 1, 2.0), ("a", 99, 2, 3.0), ("b", 1, 0, 9.0)], "key string, t long, idx long, v double")
    gt = spark.createDataFrame([("a", 0, 7, 10.0), ("a", 10, 3, 20.0), ("a", 10, 1, 30.0)], "key string, t long, idx long, v double")
    got = {(r.key, r.idx): (r.gt, r.gt_idx) for r in E.nearest_match(es, gt, ["key"]).collect()}
    # At t = 5 both are 5 away: the lower index wins.
    assert got == {("a", 0): (30.0, 1), ("a", 1): (30.0, 1), ("a", 2): (30.0, 1), ("b", 0): (None, None)}


def test_metrics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=50), rng.normal(size=50)
    rows = [("x", float(p), float(q)) for p, q in zip(a, b)] + [("flat", 1.0, 2.0)] * 3 + [("zero", 1.0, 0.0)] * 2
    got = {r.key: r for r in E.error_metrics(spark.createDataFrame(rows, "key string, es double, gt double"), ["key"], rounded=False).collect()}
    x = got["x"]
    assert (x.RMSE, x.MAE, x.MAX, x.R) == pytest.approx((np.sqrt(((b - a) ** 2).mean()), abs(b - a).mean(), abs(b - a).max(), np.corrcoef(a, b)[0, 1]))
    assert x.CCC == pytest.approx(2 * np.cov(a, b, ddof=0)[0, 1] / (a.var() + b.var() + (a.mean() - b.mean()) ** 2))
    assert x.RMSE >= x.MAE and abs(x.CCC) <= abs(x.R)
    assert got["flat"].R is None and got["flat"].CCC is None and got["zero"].MAPE is None


def test_qq_points(spark):
    rows = [("a", float(v)) for v in np.random.default_rng(1).normal(size=400)]
    p = E.qq_points(spark.createDataFrame(rows, "key string, y double"), ["key"])
    line = E.fit_line(p, ["key"]).first()
    assert line.r > 0.99 and abs(line.slope - 1) < 0.1
    q = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(E.inverse_normal(F.col("p")).alias("x")).collect()
    assert [r.x for r in q] == pytest.approx([0.0, 1.959964, -3.090232], abs=1e-6)


def test_gate_and_objective(spark):
    d = spark.createDataFrame([(0.0, 1.0, 0.0, 2.0, 5.0, 0.1), (2.0, 0.01, 0.9, 1.0, 1.0, 2.0)], "std_bpm double, unique_frac double, saturation double, peak_ratio double, prom_db double, fwhm double")
    a, b = E.quality_gate(d, soft_constant=True).orderBy("std_bpm").collect()
    assert (a.reasons, a.ok) == (["constant"], True) and not b.ok and len(b.reasons) == 5
    assert E.quality_gate(d, enabled=False).where("ok").count() == 2
    one = spark.range(1).select(E.objective({k: F.lit(None).cast("double") for k in E.WEIGHTS}).alias("o")).first()
    assert one.o == 0.0


def test_frame_difference_wraps(spark):
    fr = spark.createDataFrame([(1, f, 0, 0, v) for f, v in enumerate([10, 5, 200, 0])], "trial int, frame int, row int, col int, gray int")
    assert [r.y for r in V.frame_difference(fr).orderBy("frame").collect()] == [1, 1, 0]
    assert [r.y for r in V.frame_difference(fr, wrap=False).orderBy("frame").collect()] == [0, 1, 0]


def test_gray_of_halves(spark):
    px = [(r, g, b) for r in range(0, 256, 3) for g in range(0, 256, 5) for b in range(0, 256, 2) if (299 * r + 587 * g + 114 * b) % 1000 == 500]
    got = spark.createDataFrame(px, "r long, g long, b long").select("r", "g", "b", V.gray(F.col("r"), F.col("g"), F.col("b")).alias("y")).collect()
    assert len(got) > 500 and all(x.y == (299 * x.r + 587 * x.g + 114 * x.b + 500) // 1000 for x in got)


def test_profile_shift_cubic(spark):
    rng = np.random.default_rng(4)
    img = rng.integers(0, 255, (3, 9, 6))
    rows = [(0, f, r, c, int(img[f, r, c])) for f in range(3) for r in range(9) for c in range(6)]
    p = V.row_profile(spark.createDataFrame(rows, "trial int, frame int, row int, col int, gray int"))
    prof = [np.diff(0.5 * (x.mean(1) + x.std(1))) for x in img]
    for kind in ("linear", "quadratic", "cubic"):
        got = [r.y for r in V.profile_shift(p, 20.0, kind).orderBy("frame").collect()]
        for f, y in enumerate(got, 1):
            c = np.correlate(prof[f], prof[f - 1], "full")
            per = (len(c) * 100 - 1) / (len(c) - 1)
            if kind == "linear":
                assert y == 20 * np.argmax(np.interp(np.linspace(0, len(c) - 1, len(c) * 100), np.arange(len(c)), c))
            else:
                assert abs(y / 20 - np.argmax(c) * per) <= per


def test_spline_peaks_hold_few_grid_points():
    import tracemalloc

    import pandas as pd

    c = list(np.random.default_rng(5).normal(size=(4000, 13)))
    b = pd.DataFrame({"trial": 1, "frame": range(4000), "c": c})
    tracemalloc.start()
    got = pd.concat(list(V._spline_peaks(100)(iter([b, b[:0]]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["frame"].tolist() == b["frame"].tolist() and peak < 40e6
    alone = [next(V._spline_peaks(100)(iter([b[i : i + 1]])))["at"].iloc[0] for i in range(0, 4000, 500)]
    assert got["at"].tolist()[::500] == alone


def test_labels(spark):
    d = spark.createDataFrame([("a b/c-", "x10", "kf__y__z"), ("--", "x9", "plain"), ("", "x2b", "__q")], "s string, k string, m string")
    base, head = X.split_method(F.col("m"))
    got = d.select(X.sanitize_label(F.col("s")).alias("s"), base.alias("b"), head.alias("h")).collect()
    assert [r.s for r in got] == ["a_b_c", None, None] and [(r.b, r.h) for r in got] == [("kf", "y__z"), (None, None), ("", "q")]
    assert [r.k for r in d.orderBy(X.natural_key(F.col("k"))).collect()] == ["x2b", "x9", "x10"]


def test_clip_keeps_nan(spark):
    d = spark.createDataFrame([(float("nan"),), (5.0,), (None,), (-5.0,)], "x double").select(X.clip(F.col("x"), -1, 1).alias("y")).collect()
    assert np.isnan(d[0].y) and [r.y for r in d[1:]] == [1.0, None, -1.0]


def test_ranking(spark):
    log = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, None)], "method string, trial int, objective double")
    assert {(r.method, r.trial) for r in R.best_trial(log, ["method"]).collect()} == {("a", 2), ("b", 1)}
    m = spark.createDataFrame([(i, f"{b}__{h}") for i, (b, h) in enumerate([("x", "1"), ("y", "1"), ("x", "2"), ("z", "1")])], "pos int, method string")
    assert {r.method: r.shard for r in R.shard_assign(m, 2).collect()} == {"x__1": 0, "x__2": 0, "y__1": 1, "z__1": 0}
    t = spark.createDataFrame([(1, i, f"method{i % 12}") for i in range(30)] + [(2, 0, "a"), (2, 1, "a")], "run int, pos int, tok string")
    got = {r.run: r.suffix for r in R.run_suffix(t, ["run"], "tok", "pos").collect()}
    assert got[2] == "a" and got[1].startswith("12m_") and len(got[1]) == 14


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, m string, v int")
    new = spark.createDataFrame([(1, "b", 9), (2, "c", 3)], "k int, m string, v int")
    assert sorted(map(tuple, R.upsert_estimates(old, new, ["k", "m"]).collect())) == [(1, "a", 1), (1, "b", 9), (2, "c", 3)]


def test_late_rows_are_dropped(spark, tmp_path):
    from cadenza.streaming import streams as T

    for i, rows in enumerate([[("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-02 00:00:00", 1.0)], [("a", "2024-01-02 00:05:00", 2.0)], [("a", "2024-01-01 00:10:00", 5.0), ("a", "2024-01-02 00:10:00", 5.0)]]):
        spark.createDataFrame(rows, "key string, ts string, y double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}.parquet")
    s = spark.readStream.schema("key string, ts timestamp_ntz, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = T.drain(T.stream_windows(s, "key", "ts", "y", "1 hour", "1 hour", "2 hours"), "update", ["key", "start"])
    n = {str(r.start): r.n for r in got.collect()}
    assert n["2024-01-02 00:00:00"] == 3 and n["2024-01-01 00:00:00"] == 1


def test_every_name_has_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "key"


def test_upsert_sink(spark, tmp_path, monkeypatch):
    import os

    from cadenza.sources import files as S

    path = str(tmp_path / "estimates")
    rows = lambda *r: spark.createDataFrame(r, "trial int, method string, rate double")
    stored = lambda: sorted(map(tuple, spark.read.parquet(path).select("trial", "method", "rate").collect()))
    order = spark.createDataFrame([("kf", 0), ("dof", 1)], "method string, pos int")
    put = lambda df: S.upsert(df, path, ["trial", "method"], ["method"], order)
    put(rows((1, "kf", 1.0), (2, "kf", 2.0), (1, "dof", 3.0)))
    untouched = {f: os.path.getmtime(f"{path}/method=dof/{f}") for f in os.listdir(f"{path}/method=dof")}
    new = rows((2, "kf", 20.0), (3, "kf", 30.0), (9, "odd", 9.0))
    want = [(1, "dof", 3.0), (1, "kf", 1.0), (2, "kf", 20.0), (3, "kf", 30.0), (9, "odd", 9.0)]
    # A write that fails on the way leaves the table as it was, and nothing of its own.
    with monkeypatch.context() as m:
        m.setattr(S, "method_order", lambda *a: 1 / 0)
        try:
            put(new)
        except ZeroDivisionError:
            pass
    assert stored() == [(1, "dof", 3.0), (1, "kf", 1.0), (2, "kf", 2.0)] and not os.listdir(path + "_staged")
    for _ in range(2):
        assert sorted(map(tuple, put(new).select("trial", "method", "rate").collect())) == want == stored()
    assert {f: os.path.getmtime(f"{path}/method=dof/{f}") for f in os.listdir(f"{path}/method=dof")} == untouched
    put(rows())
    assert stored() == want


def test_upsert_sink_without_partitions(spark, tmp_path):
    from cadenza.sources import files as S

    path = str(tmp_path / "flat")
    for r in ([(1, 1.0), (2, 2.0)], [(2, 5.0)]):
        S.upsert(spark.createDataFrame(r, "trial int, rate double"), path, ["trial"], [])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1.0), (2, 5.0)]
