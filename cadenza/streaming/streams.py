"""Structured Streaming forms of the causal operators: windows, running statistics, filters with state per key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.sources.shared import shared_path


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it gave; keys: the last row of each (update mode).

    Every epoch is a Parquet folder in the shared folder, so a repeated epoch overwrites its own.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/part={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", shared_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).drop("part")
    if keys:
        rest = [c for c in got.columns if c not in keys]
        got = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*keys, "_r.*")
    return got.drop("_epoch")


def _pattern(path: str) -> str:
    """A pattern that only path matches: its last character in brackets."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def read_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The Parquet files at path (one file, which as a stream is a pattern of its exact name, or a folder)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_pattern(path))


def stream_windows(rows: DataFrame, key: str, ts: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    """Statistics per key and event-time window; rows later than delay are dropped. ts may be a local timestamp."""
    r = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).alias("y")).withWatermark("ts", delay)
    w = r.groupBy("key", F.window("ts", width, slide).alias("w"))
    a = w.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), (F.max("y") - F.min("y")).alias("ptp"), F.sum(F.col("y") * F.col("y")).alias("energy"))
    return a.select("key", F.col("w.start").alias("start"), "n", "mean", "std", "ptp", "energy")


def stream_autotune(rows: DataFrame) -> DataFrame:
    """Running statistics per dataset and method (mad, snr, freq)."""
    return rows.groupBy("dataset", "method").agg(F.count("*").alias("count"), F.sum("mad").alias("sum_mad"), F.sum("snr").alias("sum_snr"), F.sum("freq").alias("sum_freq"), F.max("mad").alias("max_sigma"))


#: The provider that holds value, map and timer state on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NONE = -1
#: Samples of a row that leaves the state, at most.
_PACK = 10_000
#: Where times begin for samples without any (the first watermark is 1970, and what is not after it is late).
_EPOCH = 946_684_800


class InOrder(StatefulProcessor):
    """Hands each key's samples on in order of n, whatever order batches bring them in.

    A sample whose turn it is goes on at once; one that comes early waits until those before it have come, or until the
    watermark has passed its time, when they can not come any more. Samples at or below the last one handed on are
    dropped. A key without samples for idle_ms of event time loses its state; what comes later starts it anew.

    start: the state before the first sample; step(state, values) gives the state after a sample and its output row (or
    None).
    """

    def __init__(self, values: list[str], kinds: str, out: list[str], start: tuple, step: Callable, state: str, idle_ms: int):
        self.values, self.kinds, self.out, self.start, self.step, self.schema, self.idle_ms = values, kinds, out, start, step, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"last int, seen long, {self.schema}")
        self.waiting = handle.getMapState("waiting", "n int", f"ts long, {self.kinds}")
        self.row = Row("key", "n", *self.out)

    def _packed(self, key, rows: list[tuple]) -> Iterator[Row]:
        for lo in range(0, len(rows), _PACK):
            yield self.row(key, *map(list, zip(*rows[lo : lo + _PACK], strict=True)))

    def _load(self) -> tuple[int, int, tuple, bool]:
        """The last sample handed on, the latest time seen, the state, and whether there was any."""
        got = self.state.get()
        if got is None:
            return _NONE, 0, self.start, False
        last, seen, *rest = got
        return last, seen, tuple(rest), True

    def _hand_on(self, last: int, state: tuple, ready: list[tuple[int, tuple]]) -> tuple[int, tuple, list]:
        rows = []
        for n, v in ready:
            state, row = self.step(state, v)
            last = n
            if row is not None:
                rows.append((n, *row))
        return last, state, rows

    def _save(self, last: int, seen: int, state: tuple, early: dict[int, tuple]) -> None:
        self.state.update((last, seen, *state))
        self.handle.registerTimer((min(v[0] for v in early.values()) if early else seen + self.idle_ms) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, seen, state, known = self._load()
        was = {n[0]: tuple(v) for n, v in self.waiting.iterator()} if known else {}
        early = dict(was)
        for r in rows:
            for n, t, *v in zip(r["n"], r["ms"], *[r[c] for c in self.values], strict=True):
                seen = max(seen, t)
                if n > last:
                    early.setdefault(n, (t, *v))
        ready, n = [], last + 1
        while n in early:
            ready.append((n, early.pop(n)[1:]))
            n += 1
        last, state, out = self._hand_on(last, state, ready)
        for n in was.keys() - early.keys():
            self.waiting.removeKey((n,))
        for n in early.keys() - was.keys():
            self.waiting.updateValue((n,), early[n])
        self._save(last, seen, state, early)
        yield from self._packed(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, seen, state, known = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        early = {n[0]: tuple(v) for n, v in self.waiting.iterator()}
        out: list = []
        if early:
            gone = [n for n, v in early.items() if v[0] <= now]
            to = max(gone, default=_NONE)
            while to + 1 in early:  # and those whose turn it then is
                to += 1
            ready = [(n, early[n][1:]) for n in sorted(early) if n <= to]
            last, state, out = self._hand_on(last, state, ready)
            for n, _ in ready:
                self.waiting.removeKey((n,))
                early.pop(n)
            self._save(last, seen, state, early)
        elif known and seen + self.idle_ms <= now:
            self.state.clear()
        yield from self._packed(key[0], out)

    def close(self) -> None:
        pass


def _packs(columns: list[str]) -> Callable:
    """Each Arrow batch's rows as one row for a key: its samples as arrays, in the order they came, and their latest
    time (latest, in ms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("key").dictionary_encode("encode").indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            head = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            rows = b.take(pa.array(order))
            ends = pa.array(np.r_[head, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, rows.column(c)) for c in columns]
            latest = np.maximum.reduceat(rows.column("ms").to_numpy(), head)
            yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(head)), *lists, pa.array(latest)], ["key", *columns, "latest"])

    return run


def _in_order(signal: DataFrame, processor: InOrder, key_type: str, schema: str, delay: str) -> DataFrame:
    """key, n and what the processor gives (schema). Samples come to the state and leave it as arrays, one row for a key
    and Arrow batch: the state's rows pass through Python one by one, and each key's as an Arrow batch of its own.

    A row's time is that of its latest sample, so samples that are late by more than delay are dropped only where no
    newer one of their key came with them; the others go on if their turn has not passed.
    """
    signal.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ts = F.col("ts") if "ts" in signal.columns else F.timestamp_seconds(F.lit(_EPOCH) + F.col("n"))
    flat = signal.select(F.col("key").cast(key_type).alias("key"), F.col("n").cast("int").alias("n"), *[F.col(c).cast("double").alias(c) for c in processor.values], F.unix_millis(ts.cast("timestamp")).alias("ms"))
    columns = ["n", *processor.values, "ms"]
    kinds = f"key {key_type}, n array<int>, {''.join(f'{c} array<double>, ' for c in processor.values)}ms array<long>, latest long"
    packed = flat.mapInArrow(_packs(columns), kinds).withColumn("ts", F.timestamp_millis("latest")).drop("latest").withWatermark("ts", delay)
    out = [f.split()[0] for f in schema.split(", ")]
    arrays = ", ".join(f"{f.split()[0]} array<{f.split()[1]}>" for f in schema.split(", "))
    got = packed.groupBy("key").transformWithState(processor, f"key {key_type}, {arrays}", "append", "eventTime")
    return got.select("key", F.inline(F.arrays_zip(*out)))


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def filter_step(rho: float, qx: float, rv: float, alpha: float) -> Callable:
    """One sample (y, w) of the oscillator filter and the smoother; state: x1, x2, p11, p12, p22, s."""

    def step(state: tuple, v: tuple) -> tuple[tuple, tuple]:
        (x1, x2, p11, p12, p22, s), (y, w) = state, v
        a, b = rho * math.cos(w), rho * math.sin(w)
        m1, m2 = a * x1 - b * x2, b * x1 + a * x2
        a11 = a * a * p11 - 2 * a * b * p12 + b * b * p22 + qx
        a12 = a * b * p11 + (a * a - b * b) * p12 - a * b * p22
        a22 = b * b * p11 + 2 * a * b * p12 + a * a * p22 + qx
        var = max(a11 + rv, 1e-12)
        g1, g2 = a11 / var, a12 / var
        x1, x2 = m1 + g1 * (y - m1), m2 + g2 * (y - m1)
        s = y if math.isnan(s) else alpha * s + (1 - alpha) * y
        p11, p12, p22 = max(a11 - g1 * a11, 1e-10), 0.5 * ((a12 - g1 * a12) + (a12 - g2 * a11)), max(a22 - g2 * a12, 1e-10)
        return (x1, x2, p11, p12, p22, s), (x1, x2, s)

    return step


def stream_filter(signal: DataFrame, key_type: str, rho: float, qx: float, rv: float, alpha: float, delay: str = "1 day", idle: str = "30 days") -> DataFrame:
    """key, n, x1, x2, smooth: the oscillator filter and an exponential smoother with state per key.

    signal: key, n (from 0, each once), y, w (radians a sample), ts (without it: n seconds from some time on). Samples may come late by
    delay; a key that is silent for idle loses its state.
    """
    kinds = "x1 double, x2 double, p11 double, p12 double, p22 double, s double"
    p = InOrder(["y", "w"], "y double, w double", ["x1", "x2", "smooth"], (0.0, 0.0, qx, 0.0, qx, float("nan")), filter_step(rho, qx, rv, alpha), kinds, _millis(idle))
    return _in_order(signal, p, key_type, "n int, x1 double, x2 double, smooth double", delay)


def impulse_step(limit: float) -> Callable:
    """One sample (y) against the count, mean and sum of squares of those before."""

    def step(state: tuple, v: tuple) -> tuple[tuple, tuple | None]:
        (count, mean, m2), (y,) = state, v
        z = (y - mean) / (math.sqrt(m2 / count) + 1e-8) if count > 1 else None
        d = y - mean
        mean += d / (count + 1)
        return (count + 1, mean, m2 + d * (y - mean)), None if z is None else (z, abs(z) > limit)

    return step


def stream_impulse(signal: DataFrame, key_type: str, limit: float = 3.0, delay: str = "1 day", idle: str = "30 days") -> DataFrame:
    """key, n, z, impulse: scores against the mean and deviation of the samples before, kept as state per key. signal
    as for stream_filter, without w."""
    p = InOrder(["y"], "y double", ["z", "impulse"], (0, 0.0, 0.0), impulse_step(limit), "count long, mean double, m2 double", _millis(idle))
    return _in_order(signal, p, key_type, "n int, z double, impulse boolean", delay)
