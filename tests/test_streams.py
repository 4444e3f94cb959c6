"""Streams whose samples come out of order over batches, and keys that fall silent."""

import math
import os
import time

import numpy as np
import pandas as pd
import pytest

from cadenza.streaming import streams as T

W = 2 * math.pi / 16


def feed(spark, root, batches):
    """One file a batch, read in that order."""
    os.makedirs(root)
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["key", "n", "y", "w", "ts"]).astype({"n": "int32", "ts": "datetime64[us]"}).to_parquet(f"{root}/{i}.parquet")
        os.utime(f"{root}/{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    return T.read_stream(spark, str(root), 1)


def row(key, n, at=None, y=None):
    return key, n, math.sin(n) if y is None else y, W, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=n if at is None else at)


def in_one_pass(ys):
    step, state, out = T.filter_step(0.98, 0.01, 0.05, 0.9), (0.0, 0.0, 0.01, 0.0, 0.01, float("nan")), []
    for y in ys:
        state, r = step(state, (y, W))
        out.append(r)
    return np.array(out)


def run(stream, **kw):
    return T.drain(T.stream_filter(stream, "string", 0.98, 0.01, 0.05, 0.9, **kw), "append").orderBy("key", "n").toPandas()


def test_samples_out_of_order_over_batches(spark, tmp_path):
    order = np.random.default_rng(1).permutation(60)
    batches = [[row(k, int(n)) for n in order[i : i + 15] for k in "ab"] for i in range(0, 60, 15)]
    batches[2] += batches[0][:4]  # repeats
    got = run(feed(spark, tmp_path / "in", batches))
    for k in "ab":
        g = got[got["key"] == k]
        assert g["n"].tolist() == list(range(60))
        assert np.allclose(g[["x1", "x2", "smooth"]], in_one_pass([math.sin(n) for n in range(60)]), atol=1e-12)


def test_gaps_end_at_the_watermark_and_idle_keys_start_anew(spark, tmp_path):
    first = [row("a", n) for n in (0, 1, 3, 4)]
    # Key b's times move the watermark: a's missing sample 2 can not come any more, then a is idle.
    batches = [first, [row("b", 0, 500)], [row("b", 1, 501)], [row("b", 2, 9000)], [row("b", 3, 9001)], [row("a", 0, 9002, 7.0)], [row("b", 4, 9003)]]
    got = run(feed(spark, tmp_path / "in", batches), delay="10 seconds", idle="1000 seconds")
    a = got[got["key"] == "a"]
    assert sorted(a["n"]) == [0, 0, 1, 3, 4]
    want = in_one_pass([math.sin(n) for n in (0, 1, 3, 4)])
    assert np.allclose(a[a["n"] > 0][["x1", "x2", "smooth"]], want[1:], atol=1e-12)
    assert a[a["n"] == 0]["smooth"].tolist() == pytest.approx([0.0, 7.0]) or a[a["n"] == 0]["smooth"].tolist() == pytest.approx([7.0, 0.0])


def test_samples_enter_and_leave_the_state_as_one_row_for_a_key(spark, tmp_path):
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"key": ["a", None, "a", "b", None, "a"], "n": pa.array([2, 0, 0, 0, 1, 1], pa.int32()), "y": [0.2, 5.0, 0.0, 7.0, 6.0, 0.1], "ms": [20, 9, 0, 3, 8, 10]})
    got = [r for x in T._packs(["n", "y", "ms"])([b, b.slice(0, 0)]) for r in x.to_pylist()]
    assert sorted(got, key=lambda r: r["key"] or "") == [
        {"key": None, "n": [0, 1], "y": [5.0, 6.0], "ms": [9, 8], "latest": 9},
        {"key": "a", "n": [2, 0, 1], "y": [0.2, 0.0, 0.1], "ms": [20, 0, 10], "latest": 20},
        {"key": "b", "n": [0], "y": [7.0], "ms": [3], "latest": 3},
    ]


def test_late_samples_that_come_with_newer_ones(spark, tmp_path):
    batches = [[row("a", 0, 0)], [row("b", 0, 500)], [row("b", 1, 501)], [row("a", 1, 1), row("a", 2, 600)], [row("a", 3, 2)], [row("b", 2, 601)]]
    got = run(feed(spark, tmp_path / "in", batches), delay="10 seconds", idle="100000 seconds")
    a = got[got["key"] == "a"]
    assert a["n"].tolist() == [0, 1, 2]  # 1 came late, but with 2; 3 came late alone
    assert np.allclose(a[["x1", "x2", "smooth"]], in_one_pass([math.sin(n) for n in range(3)]), atol=1e-12)
