"""Repeated windows, found where equal windows meet.

Every window of `width` symbols is routed by its minimiser, the least hash among its grams: equal windows have equal
minimisers. Neighbouring windows with one minimiser form a run. Runs whose minimiser occurs once in the corpus hold
no repeat and end here, as narrow rows; the others are cut out of their texts as short segments and meet their like in
one task, sorted by minimiser, which reads them as shards of bounded size. Within a task's batch, copies are folded before anything is shuffled, so a passage that a third of
the documents share costs one row per batch and not one per document. Where that passage stands in many contexts, the
segments at its borders differ and would all meet under one minimiser: such a hot key is parted into its windows, each
under a key of its own, so that only equal windows meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when more than so many of its runs came after the first of their batch, and all SLOTS of their prints
#: are taken (by 64 different segments at the least, about 300 as a rule).
HOT, SLOTS = 5_000, 64
#: A packed run: n in the low bits, then its print, two flags, and the first window.
_N, _PRINT, _SURE, _TWICE, _START = 10, 6, 1 << 16, 1 << 17, 18
#: A run that goes on to its text keeps n and the first window, and whether its minimiser is hot.
_HOT = 1 << 16
#: Windows of hot segments that are folded at a time; bytes of segments that are read as one shard, but for the rest of
#: a minimiser's segments, which are not parted (at most one for each batch and about HOT more).
CHUNK, SHARD = 100_000, 1_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of `size` symbols, by doubling; x holds one uint64 per symbol."""
    h, have, out, done, p = x * _M1 + _M3, 1, None, 0, _M1
    n = len(x) - size + 1
    while True:
        if size & have:
            part = h[done : done + n]
            out = part if out is None else out * p + part
            done += have
        if done == size:
            return mix(out)
        h = h[: len(h) - have] * p + h[have:]
        h ^= h >> np.uint64(29)
        have *= 2
        p = (p * _M2 + _M1) | np.uint64(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    extra = width - have
    return np.minimum(x[: len(x) - extra], x[extra:]) if extra else x


def runs(x: np.ndarray, width: int, gram: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows, own, print) of each run of at most `longest` windows.

    own: the run may hold one window twice, as its minimiser comes in again after the first window. print: a number
    under SLOTS that all of the run's grams decide.
    """
    if len(x) < width:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, bool), none
    with np.errstate(over="ignore"):
        g = gram_hashes(x, gram)
    m = sliding_min(g, width - gram + 1)
    starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    lengths = np.diff(np.r_[starts, len(m)])
    again = g[width - gram :] == m
    again[starts] = False
    own = np.logical_or.reduceat(again, starts)
    parts = -(-lengths // longest)
    if (parts > 1).any():
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(starts, parts) + at * longest
        lengths = np.minimum(longest, np.repeat(lengths, parts) - at * longest)
        starts, own = first, np.repeat(own, parts)
    total = np.r_[np.uint64(0), np.cumsum(g)]
    prints = (mix(total[starts + lengths + width - gram] - total[starts]) >> np.uint64(64 - _PRINT)).astype(np.int64)
    return m[starts].view(np.int64), starts, lengths, own, prints


def rows_of(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(did, row, text, more): a row's id (null: the least long), a hash that tells rows of one id apart, and a struct
    of the columns to keep."""
    more = F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.lit(None).cast("boolean")
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), more.alias("more"))
    return d.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("doc_id", "text").alias("row"), "text", "more")


def _run_rows(symbols: Callable, width: int, gram: int, longest: int, within: bool):
    """row, key, at, deal: a batch's later rows of a key are repeats for sure and need no count. All that is no key is
    packed into one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b["text"]):
                r = runs(symbols(t), width, gram, longest)
                if len(r[0]):
                    at.append(np.full(len(r[0]), i))
                    out.append(r)
            if not out:
                continue
            at = np.concatenate(at)
            key, start, n, own, prints = (np.concatenate([r[k] for r in out]) for k in range(5))
            sure = np.ones(len(key), bool)
            sure[np.unique(key, return_index=True)[1]] = False
            twice = np.isin(key, key[sure])  # first rows that are repeats too, but stand for their batch in the count
            if within:
                twice |= own
            row = b["row"].to_numpy()[at]
            pack = n | prints << _N | sure * _SURE | twice * _TWICE | start.astype(np.int64) << _START
            deal = np.where(sure, 1 + ((row ^ start) & 0xFFFF), 0).astype(np.int32)
            for part in range(0, len(key), 500_000):
                c = slice(part, part + 500_000)
                yield pd.DataFrame({"row": row[c], "key": key[c], "at": pack[c], "deal": deal[c]})

    return run


def repeated_runs(rows: DataFrame, symbols: Callable, width: int, gram: int, longest: int, within: bool) -> DataFrame:
    """(row, key, at) of all runs whose minimiser occurs more than once, or (within) twice in the run."""
    found = rows.select("row", "text").mapInPandas(_run_rows(symbols, width, gram, longest, within), "row long, key long, at long, deal int")
    # Rows that count meet by key; the sure ones are dealt anywhere.
    dealt = found.repartition("key", "deal")
    flag = lambda bits: F.col("at").bitwiseAND(F.lit(bits)) > 0
    sure = flag(_SURE)
    slot = F.shiftright("at", _N).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    # No filter stands before the sum, which would part the exchange from that of the runs: rows that are not sure add up under 0.
    counts = dealt.groupBy(F.coalesce(F.when(sure, F.col("key")), F.lit(0)).alias("key")).agg(F.count("*").alias("runs"), F.bit_or(F.when(sure, F.call_function("shiftleft", F.lit(1).cast("long"), slot))).alias("slots"), F.count("deal").alias("_"), F.max("row").alias("_r"))
    # At most one key for HOT runs.
    hot = counts.where((F.col("runs") > HOT) & (F.col("slots") == -1) & F.col("_").isNotNull() & F.col("_r").isNotNull()).select("key", F.lit(_HOT).alias("hot"))
    known = dealt.withColumn("met", F.count("*").over(Window.partitionBy("key", "deal"))).where(flag(_SURE | _TWICE) | (F.col("met") > 1))
    place = F.col("at").bitwiseAND(F.lit(-1 << _START | (1 << _N) - 1))
    return known.join(F.broadcast(hot), "key", "left").select("row", "key", place.bitwiseOR(F.coalesce("hot", F.lit(0))).alias("at"))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, n) ranges in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(ranges):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]))
        else:
            out.append((start, n))
    return out


COLUMNS = ["did", "row", "key", "start", "n", "times", "seg", "more"]


def _pack(starts) -> bytes | None:
    return np.asarray(starts, np.int32).tobytes() if len(starts) else None


def _windows(segs: list[list], width: int, same_row_is_sure: bool) -> pd.DataFrame:
    """Segments (in order of id) taken apart: every window travels under half of its digest as key. Equal windows fold
    as segments do."""
    segs = [x if k < 0 else [*x[:3], x[7][k], *x[4:]] for x in segs for k in range(-1, len(x[7]))]
    did, row, start, n, times = (np.array([x[k] for x in segs], np.int64) for k in (0, 1, 3, 4, 5))
    windows = []
    for x in segs:
        seg, size = x[6], len(x[6]) // (x[4] + width - 1)
        windows += [seg[k * size : (k + width) * size] for k in range(x[4])]
    digests = [blake2b(x, digest_size=16).digest() for x in windows]
    half = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    start = np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(half))
    did, row, times = np.repeat(did, n), np.repeat(row, n), np.repeat(times, n)
    order = np.lexsort((half[:, 1], half[:, 0]))
    new = np.r_[True, (half[order][1:] != half[order][:-1]).any(1)]
    first = order[new][np.cumsum(new) - 1]
    times[order[new]] = np.add.reduceat(times[order], np.flatnonzero(new))
    sure = ~new if same_row_is_sure else did[order] > did[first]
    go = order[~sure]
    head = np.flatnonzero(np.r_[True, (half[go][1:] != half[go][:-1]).any(1) | (did[go][1:] != did[go][:-1]) | (row[go][1:] != row[go][:-1])])
    more = [_pack(start[go[lo + 1 : hi]]) for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(go)], strict=True)]
    go = go[head]
    out = pd.DataFrame({"did": did[go], "row": row[go], "key": half[go, 0], "start": start[go], "n": 1, "times": times[go], "seg": [windows[i] for i in go.tolist()], "more": more})
    at = order[sure]
    if not len(at):
        return out
    at = at[np.lexsort((start[at], row[at], did[at]))]
    did, row, start = did[at], row[at], start[at]
    new = np.r_[True, (did[1:] != did[:-1]) | (row[1:] != row[:-1])]
    edge = np.flatnonzero(new | np.r_[True, start[1:] > start[:-1] + 1])
    pairs = np.stack([start[edge], start[np.r_[edge[1:], len(at)] - 1] - start[edge] + 1], 1)
    head = np.flatnonzero(new[edge])
    more = [_pack(pairs[lo:hi]) for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(edge)], strict=True)]
    return pd.concat([out, pd.DataFrame({"did": did[edge[head]], "row": row[edge[head]], "key": 0, "start": 0, "n": 0, "times": 0, "seg": None, "more": more})], ignore_index=True)


def _ranges(b: pd.DataFrame) -> pd.DataFrame:
    """The sure ranges that rows carry, one row each."""
    pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in b["more"]]
    out = b[["did", "row"]].loc[b.index.repeat([len(x) for x in pairs])]
    return out.assign(**dict(zip(("start", "n"), np.concatenate(pairs).T, strict=True))).drop_duplicates()


def _cut_out(pieces: Callable, width: int, same_row_is_sure: bool):
    """Segments of each row's runs. In a batch, equal segments fold: the first (by id) is the one that travels, with
    how often it was met; the others are ranges that repeat for sure, joined where they touch, one row (more) for each
    text. Where a row
    meets its own segment again and is not sure, the first takes its start along (more). Of hot keys' segments the
    windows travel instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first: dict[bytes, list] = {}
            held, apart = [], []
            for did, row, text, keys, places in sorted(zip(b["did"], b["row"], b["text"], b["keys"], b["places"], strict=True), key=lambda r: (r[0], r[1])):
                (cut, size), sure = pieces(text), []
                order = np.argsort(places)
                for key, at in zip(keys[order].tolist(), places[order].tolist(), strict=True):
                    start, n = at >> _START, at & ((1 << _N) - 1)
                    if start + n + width - 1 > size:  # another row's run, whose hash is the same
                        continue
                    seg = cut(start, start + n + width - 1)
                    met = first.get(seg)
                    if met is not None and not same_row_is_sure and (met[0], met[1]) == (did, row):
                        met[7].append(start)
                    elif met is None or (not same_row_is_sure and met[0] == did):
                        new = [did, row, key, start, n, 1, seg, []]
                        (apart if at & _HOT else held).append(new)
                        first.setdefault(seg, new)
                    else:
                        met[5] += 1
                        sure.append((start, n))
                if sure:
                    held.append([did, row, 0, 0, 0, 0, None, [x for r in _joined(sure) for x in r]])
            del first
            if held:
                yield pd.DataFrame([[*x[:7], _pack(x[7])] for x in held], columns=COLUMNS)
            size, lo = 0, 0
            for hi, x in enumerate(apart, 1):
                size += x[4] * (1 + len(x[7]))
                if size >= CHUNK or hi == len(apart):
                    yield _windows(apart[lo:hi], width, same_row_is_sure)
                    size, lo = 0, hi

    return run


def segments(rows: DataFrame, found: DataFrame, pieces: Callable, width: int, same_row_is_sure: bool) -> DataFrame:
    """The runs' segments, those that count dealt and sorted by key; times is 0 (and seg null) where a range is sure to
    repeat. pieces(text) gives a function (from, to) to a segment as bytes, and the text's symbols. Hot keys' segments
    come as windows. Runs find their text by the row's hash; were it another row's too, both would be judged, rightly,
    by what they hold there."""
    # A set: rows that repeat id and text share their runs. Most runs of a row come from different partitions, so they
    # are sent flat: arrays of one would only be larger.
    per_row = found.repartition("row").groupBy("row").agg(F.collect_set(F.struct("key", "at")).alias("runs"))
    cut = rows.join(per_row, "row").select("did", "row", "text", F.col("runs.key").alias("keys"), F.col("runs.at").alias("places")).mapInPandas(_cut_out(pieces, width, same_row_is_sure), "did long, row long, key long, start int, n int, times int, seg binary, more binary")
    # start, n and times (up to 255: whether it is above one is all that is asked) travel as one number.
    packed = F.shiftleft(F.col("start").cast("long"), 18).bitwiseOR(F.shiftleft("n", 8)).bitwiseOR(F.least("times", F.lit(255)))
    part = lambda shift, bits: F.shiftright("at", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    sent = cut.select("did", "row", "key", packed.alias("at"), "seg", "more").repartition("key", F.when(part(0, 8) == 0, F.xxhash64("did", "row")).otherwise(F.lit(0)))
    return sent.sortWithinPartitions("key").select("did", "row", "key", part(18, 32).alias("start"), part(8, 10).alias("n"), part(0, 8).alias("times"), "seg", "more")


RANGE = ["did", "row", "start", "n"]


def shards(batches: Iterator[pd.DataFrame], size_bound: int | None = None) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(False, sure ranges) as they come, and (True, shard): segments that count, size_bound (SHARD) bytes or so, no key in two."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        sure = (b["times"] == 0).to_numpy()
        if sure.any():
            yield False, _ranges(b[sure])
        b = b[~sure]
        if not len(b):
            continue
        key, ends = b["key"].to_numpy(), np.cumsum(b["seg"].map(len).to_numpy())
        edges = np.flatnonzero(np.r_[not held or held[-1]["key"].iloc[-1] != key[0], key[1:] != key[:-1]])
        lo = 0
        for e in edges.tolist():  # a shard may end before a new key
            if size + (ends[e - 1] if e else 0) - (ends[lo - 1] if lo else 0) >= (size_bound or SHARD):
                yield True, pd.concat([*held, b[lo:e]], ignore_index=True)
                held, size, lo = [], 0, e
        held.append(b[lo:])
        size += int(ends[-1] - (ends[lo - 1] if lo else 0))
    if held:
        yield True, pd.concat(held, ignore_index=True)


def covered(length: int, ranges: list, width: int) -> np.ndarray:
    """Symbols of a text covered by the windows that start in the ranges (start, n)."""
    mark = np.zeros(length + 1, np.int32)
    for r in ranges:
        mark[r["start"]] += 1
        mark[min(length, r["start"] + r["n"] + width - 1)] -= 1
    return np.cumsum(mark[:-1]) > 0


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row with its ranges (an empty list where there are none). The join's key is that of segments, so that the
    texts are shuffled once for both."""
    per_row = ranges.repartition("row").groupBy("row").agg(F.collect_set(F.struct("did", "start", "n")).alias("ranges"))
    own = F.filter("ranges", lambda r: r["did"] == F.col("did"))
    return rows.join(per_row, "row", "left").select(F.when(F.col("did") != -(2**63), F.col("did")).alias("doc_id"), "text", "more", F.coalesce(own, F.array().cast("array<struct<did:bigint,start:int,n:int>>")).alias("ranges"))
