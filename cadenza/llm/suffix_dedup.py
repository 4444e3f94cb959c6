"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

Segments in which equal strings must meet (see windows) are gathered per task; copies have been folded. In each round
every segment inserts the symbol before its current suffix: the transform and the common prefixes of neighbouring
suffixes are read from one file and written to the next, in order. Neighbours whose common prefix reaches the length
sought are repeats.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import alone
from cadenza.llm.windows import RANGE, covered, gram_hashes, repeated_runs, rows_of, segments, shards, with_ranges

GRAM, LONGEST = 64, 256
#: Stretches of up to so many widths share a transform.
PARTS = (1.25,)
#: Bytes of segments that are taken at a time: rounds cost the same for few bytes as for some more.
SHARD = 4_000_000


def _symbols(text: str) -> np.ndarray:
    alone("suffix_dedup")
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)


def _pieces(text: str):
    raw = text.encode("utf-8", "replace")
    return (lambda lo, hi: raw[lo:hi]), len(raw)


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) of each non-empty range."""
    if not len(lo):
        return np.empty(0, x.dtype)
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[::2], pairs[1::2] = lo, hi
    return np.minimum.reduceat(np.concatenate([x, np.array([255], np.uint8)]), pairs)[::2]


def repeats_by_bwt(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, whether the window at each start also stands elsewhere in the collection (width <= 250)."""
    m, n = len(texts), np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # UTF-8 has no 0xff; 0 ends a text
    end = np.cumsum(n)

    def before(i: np.ndarray, length: int) -> np.ndarray:  # the symbol before the suffix of that length, 0 before the first
        return np.where(n[i] > length, flat[np.maximum(end[i] - 1 - length, 0)], 0).astype(np.uint8)

    size = m

    def read(f) -> np.ndarray:
        f.seek(0)
        return np.fromfile(f, np.uint8, size)

    def write(f, x: np.ndarray) -> None:  # over the old bytes: the file keeps its blocks
        f.seek(0)
        f.write(x.data)

    with ExitStack() as files:
        now, new = ([files.enter_context(tempfile.TemporaryFile(buffering=0)) for _ in range(2)] for _ in range(2))
        live = np.arange(m)
        write(now[0], before(live, 0))
        write(now[1], np.zeros(m, np.uint8))
        place = live.copy()
        counts = np.bincount(before(live, 0), minlength=256)
        for length in range(1, int(n.max(initial=0)) + 1):
            bwt, lcp = read(now[0]), read(now[1])
            stays = n[live] >= length
            live, place = live[stays], place[stays]
            # The suffixes that start with a symbol stand in the order of that symbol's places in the transform.
            order = np.argsort(bwt, kind="stable")
            ends = np.cumsum(counts)
            skip = int(ends[0])
            symbol = bwt[place]
            at = np.empty(len(live), np.int64)
            for c in np.unique(symbol):
                own = symbol == c
                lo, hi = ends[c - 1], ends[c]
                at[own] = lo + np.searchsorted(order[lo:hi], place[own])
            put = m + at - skip
            sort = np.argsort(put)
            live, place, at, put, symbol = live[sort], place[sort], at[sort], put[sort], symbol[sort]
            fresh = np.zeros(len(bwt) + len(put), bool)
            fresh[put] = True
            bwt2, lcp2 = np.empty(len(fresh), np.uint8), np.empty(len(fresh), np.uint8)
            old = ~fresh
            bwt2[old], lcp2[old] = bwt, lcp
            bwt2[put] = added = before(live, length)
            counts += np.bincount(added, minlength=256)
            lcp2[put] = 0
            has = (at > skip) & (bwt[order[np.maximum(at - 1, 0)]] == symbol)
            lcp2[put[has]] = np.minimum(_least(lcp, order[at[has] - 1] + 1, place[has] + 1), width - 1) + 1
            follows = np.minimum(at + 1, len(order) - 1)
            has = (at + 1 < len(order)) & (bwt[order[follows]] == symbol)
            lcp2[put[has] + 1] = np.minimum(_least(lcp, place[has] + 1, order[follows[has]] + 1), width - 1) + 1
            write(new[0], bwt2)
            write(new[1], lcp2)
            size = len(bwt2)
            now, new, place = new, now, put
        bwt, lcp = read(now[0]), read(now[1])
    # Walk every text from its end through the finished transform.
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt)) + m - int((bwt == 0).sum())
    twice = (lcp >= width) | np.r_[lcp[1:] >= width, False] if len(lcp) else np.zeros(0, bool)
    out = [np.zeros(max(0, k - width + 1), bool) for k in n]
    hit_flat, offset = np.zeros(int(np.maximum(n - width + 1, 0).sum()), bool), np.cumsum(np.maximum(n - width + 1, 0)) - np.maximum(n - width + 1, 0)
    live, place = np.arange(m), np.arange(m)
    for length in range(1, int(n.max(initial=0)) + 1):
        stays = n[live] >= length
        live, place = live[stays], step[place[stays]]
        if length >= width:
            hit_flat[offset[live] + n[live] - length] = twice[place]
    for i in range(m):
        out[i] = hit_flat[offset[i] : offset[i] + max(0, n[i] - width + 1)]
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _candidates(segs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last): the stretch of each segment between windows whose fingerprint occurs twice. No window
    outside it can be a repeat; whether those inside are is for the transform to say."""
    n = np.fromiter(map(len, segs), np.int64, len(segs)) - width + 1
    with np.errstate(over="ignore"):
        prints = np.concatenate([gram_hashes(np.frombuffer(s, np.uint8).astype(np.uint64), width) for s in segs])
    owner = np.repeat(np.arange(len(segs)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    hit = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    pick, first = np.unique(owner[hit], return_index=True)
    last = np.r_[first[1:], len(hit)][: len(pick)] - 1
    return pick, place[hit[first]], place[hit[last]]


def shard_repeats(b: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """The repeated ranges of a shard's segments (sorted by key)."""
    b = b.assign(digest=[blake2b(s, digest_size=16).digest() for s in b["seg"]])
    times = b.groupby(["key", "digest"], sort=False)["times"].transform("sum").to_numpy()
    yield b.loc[times > 1, RANGE]
    once = ~b.duplicated(["key", "digest"]).to_numpy()
    todo, alone = b[once], times[once] == 1
    # A segment that is alone under its key may still repeat itself.
    need = (todo["key"].map(todo["key"].value_counts()).to_numpy() > 1) | (alone & (todo["n"].to_numpy() > 1))
    todo, alone = todo[need], alone[need]
    if not len(todo):
        return
    pick, first, last = _candidates(list(todo["seg"]), width)
    todo, alone, n = todo.iloc[pick], alone[pick], last - first + width
    # Only keys with something to decide; stretches of keys that are as long share a transform, as its rounds are as
    # many as the longest has bytes and each passes over all that it holds.
    keys = pd.DataFrame({"key": todo["key"].to_numpy(), "n": n, "alone": alone}).groupby("key").transform("max")
    part = np.where(keys["alone"], np.searchsorted(np.multiply(PARTS, width), keys["n"]), -1)
    for k in range(len(PARTS) + 1):
        own = np.flatnonzero(part == k)
        if not len(own):
            continue
        segs = [x[i : i + size] for x, i, size in zip(todo["seg"].iloc[own], first[own].tolist(), n[own].tolist(), strict=True)]
        out = []
        for r, skip, mine, flags in zip(todo.iloc[own][RANGE].itertuples(index=False), first[own].tolist(), alone[own], repeats_by_bwt(segs, width), strict=True):
            if mine:
                out += [(r.did, r.row, r.start + skip + s, k) for s, k in _spans(flags)]
        yield pd.DataFrame(out, columns=RANGE)


def _shard(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for counts, b in shards(batches, SHARD):
            yield from shard_repeats(b, width) if counts else [b]

    return run


def repeated_ranges(rows: DataFrame, width: int) -> DataFrame:
    found = repeated_runs(rows, _symbols, width, GRAM, LONGEST, within=True)
    return segments(rows, found, _pieces, width, same_row_is_sure=True).mapInPandas(_shard(width), "did long, row long, start int, n int")


def _removed(width: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, ranges in zip(b["doc_id"].array, b["text"], b["ranges"], strict=True):
                raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
                gone = covered(len(raw), ranges, width)
                left = raw[~gone].tobytes()
                out.append((i, len(raw), int(gone.sum()), len(_spans(gone)), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] if texts else [])))
            new = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])]).astype({"doc_id": "Int64"})
            yield new.assign(more=b["more"].to_list()) if "more" in b else new

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, and columns to keep).

    Each UTF-8 byte covered by a string of width bytes (130 to 250) that also starts anywhere else, in the same text
    or another, is removed; strings are judged on the input. Null and empty texts have no bytes. Rows that repeat a
    text lose all of it (if it is width long). kept_text drops the bytes of characters that were cut apart. An empty
    table gives no rows; other columns are ignored.
    """
    if not 130 <= width <= 250:
        raise ValueError("width must be from 130 to 250")
    rows = rows_of(docs, id_col, text_col, keep)
    both = with_ranges(rows, repeated_ranges(rows, width))
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")
    if not keep:
        return both.drop("more").mapInPandas(_removed(width, texts), schema)
    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in keep)
    return both.mapInPandas(_removed(width, texts), f"{schema}, more struct<{inner}>").select("*", *[F.col("more")[c].alias(c) for c in keep]).drop("more")
