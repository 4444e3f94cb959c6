"""Runs of repeated words in texts, by Kruskal's order over descending common prefixes.

A run of period q and length m makes the suffixes at each of its places i and i + q share m - (i - start) - q words, and
no suffix between them shares as many. So the suffixes of a text are sorted, neighbours in that order become edges with
their common prefix as weight, and union-find unites the classes of suffixes from the longest prefix down. A class keeps
its positions in order; where a union makes two positions neighbours whose distance is within the common prefix, they
seed a run. Seeds that can not be extended to the left are the runs, each once and with its smallest period.

A run of at least EXPONENT periods and LEAST words has seeds of common prefixes of at least GRAM words. Only suffixes
whose first GRAM words occur twice in their text are therefore sorted, all texts of a batch together in numpy.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE, crc_of_id, id_and_text, sliced

#: A run has at least so many words, and at least so many periods.
LEAST, EXPONENT = 6, 4
#: Words that the suffixes of any seed share: LEAST - 1 with period 1, more with longer ones.
GRAM = 5
#: Words sorted together (a longer text is a batch of its own).
BATCH_WORDS = 400_000
#: Characters whose words are held at a time (or one text).
SLICE_CHARS = 4_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _repeated(ids: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions whose GRAM words may occur again in their text (a hash decides, so some more), in order."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = owner[:n].astype(np.uint64)
        for k in range(GRAM):
            h = (h ^ (h >> np.uint64(29))) * _M + ids[k : k + n].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _M
    at = np.flatnonzero(left[:n] >= GRAM)
    h = h[at]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    found = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return at[twice[found] == h]


def _groups(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class Suffixes:
    """The sorted suffixes (of positions whose GRAM words occur again) of many texts, and neighbours' common prefixes.

    ids: the texts' words as numbers, one after the other; owner: each word's text; left: words from it to its text's
    end. Ranks (of those suffixes; -1 elsewhere) are kept for GRAM words, twice as many, and so on, as long as some are equal: ordered prefix doubling,
    in which only positions of equal rank are sorted again.
    """

    def __init__(self, ids: np.ndarray, owner: np.ndarray, left: np.ndarray):
        self.ids, self.owner, self.left = ids, owner, left
        at = _repeated(ids, owner, left)
        # Where such grams end, others begin that break ties of order, so those are ranked too.
        at = np.union1d(at, at[left[at] > GRAM] + GRAM)
        group, most = owner[at], int(ids.max(initial=0)) + 2
        for k in range(GRAM):  # exact and in order of the words' numbers: no hash; the text's end comes first
            group = _groups(group * most + np.where(left[at] > k, ids[np.minimum(at + k, len(ids) - 1)] + 1, 0))
        order = np.argsort(group, kind="stable")
        self.order, group = at[order], group[order]
        # A position's rank at a level is the first place of its group.
        rank = np.full(len(ids) + 1, -1, np.int64)
        rank[self.order] = np.searchsorted(group, group)
        self.levels, width = [rank], GRAM
        while True:
            rank = self.levels[-1]
            r = rank[self.order]
            same = np.r_[r[1:] == r[:-1], False]
            live = np.flatnonzero(same | np.r_[False, same[:-1]])
            if not len(live):
                break
            at = self.order[live]
            end = np.minimum(width, self.left[at])
            nxt = np.where(self.left[at] > width, rank[at + end], -1)
            sub = np.lexsort((nxt, r[live]))
            self.order[live] = at = at[sub]
            head, nxt = r[live][sub], nxt[sub]
            new = np.r_[True, (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])]
            rank = rank.copy()
            rank[at] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
            self.levels.append(rank)
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b share."""
        out = np.zeros(len(a), np.int64)
        a, b = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[k], GRAM << k
            same = (rank[a] == rank[b]) & (rank[a] >= 0)
            out[same] += width
            a[same] += width
            b[same] += width
        last = len(self.ids)
        for _ in range(GRAM - 1):
            ok = (a < last) & (b < last)
            x, y = np.minimum(a, last - 1), np.minimum(b, last - 1)
            ok &= (self.ids[x] == self.ids[y]) & (self.owner[x] == self.owner[y])
            out += ok
            a, b = np.where(ok, a + 1, last), np.where(ok, b + 1, last)
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, common prefix) of neighbours that share at least GRAM words, by descending prefix."""
        first = self.levels[0][self.order]
        near = np.flatnonzero(first[1:] == first[:-1])
        a, b = self.order[near], self.order[near + 1]
        w = self.common(a, b)
        by = np.argsort(-w, kind="stable")
        return a[by], b[by], w[by]


def seeds(a: list[int], b: list[int], prefix: list[int]) -> list[tuple[int, int, int]]:
    """(position, distance, common prefix) wherever a union makes positions neighbours that are at most the prefix
    over EXPONENT - 1 apart. Edges come by descending prefix; the smaller class joins the larger."""
    of: dict[int, list[int]] = {}  # position -> its class's list of positions
    out = []
    for x, y, w in zip(a, b, prefix, strict=True):
        big, small = of.get(x), of.get(y)
        if big is None:
            big = of[x] = [x]
        if small is None:
            small = of[y] = [y]
        if big is small:
            continue
        if len(big) < len(small):
            big, small = small, big
        reach = w // (EXPONENT - 1)
        if len(small) * 8 > len(big):  # as long: one merging sort
            inside = set(small)
            size = len(big)
            big += small
            big.sort()
            last, was = big[0], big[0] in inside
            for p in big[1:]:
                now = p in inside
                if now != was and p - last <= reach:
                    out.append((last, p - last, w))
                last, was = p, now
            for p in small:
                of[p] = big
            assert len(big) == size + len(small)
            continue
        inside = set(small) if len(small) > 1 else ()
        for p in small:
            insort(big, p)
            of[p] = big
        for p in small:
            k = bisect(big, p)
            if k < len(big) and big[k] - p <= reach and big[k] not in inside:
                out.append((p, big[k] - p, w))
            if k > 1 and p - big[k - 2] <= reach and big[k - 2] not in inside:
                out.append((big[k - 2], p - big[k - 2], w))
    return out


def runs_of(ids: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows (position, length, period) of the runs of many texts, by position, then period."""
    s = Suffixes(ids, owner, left)
    found = seeds(*[x.tolist() for x in s.edges()])
    if not found:
        return np.empty((0, 3), np.int64)
    at, period, prefix = np.array(found, np.int64).T
    before = np.maximum(at - 1, 0)
    # What a word before would extend is a later part of its run.
    first = (at == 0) | (owner[before] != owner[at]) | (ids[before] != ids[before + period])
    rows = np.stack([at, prefix + period, period], 1)[first & (prefix + period >= LEAST) & (prefix >= (EXPONENT - 1) * period)]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batches(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, w in enumerate(texts):
        if size and size + len(w) > BATCH_WORDS:
            yield lo, i
            lo, size = i, 0
        size += len(w)
    if lo < len(texts):
        yield lo, len(texts)


def text_runs(texts: list[list[bytes]]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For each text (its words): the words, its runs (start, length, period) and which words are kept: those that no
    run holds after its first period."""
    for lo, hi in _batches(texts):
        part = texts[lo:hi]
        n = np.array([len(w) for w in part], np.int64)
        names = _Ids()
        ids = np.fromiter(map(names.__getitem__, chain.from_iterable(part)), np.int64, int(n.sum()))
        start = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(part)), n)
        left = np.repeat(start + n, n) - np.arange(len(ids))
        rows = runs_of(ids, owner, left)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
        np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
        keep = np.cumsum(cover)[:-1] == 0
        cuts = np.searchsorted(owner[rows[:, 0]] if len(rows) else np.empty(0, np.int64), np.arange(len(part) + 1))
        for i, w in enumerate(part):
            mine = rows[cuts[i] : cuts[i + 1]].copy()
            mine[:, 0] -= start[i]
            yield w, mine, keep[start[i] : start[i] + n[i]]


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in sliced(batches, SLICE_CHARS):
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b["text"]]
        runs, kept = [], []
        for w, rows, keep in text_runs(words):
            runs.append([{"start": int(s), "length": int(m), "period": int(p)} for s, m, p in rows])
            kept.append(b" ".join(w if keep.all() else [x for x, k in zip(w, keep.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [len(w) for w in words], "runs": runs, "collapsed": kept}).astype({"doc_id": "Int64"})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    Words are runs of anything but ASCII white space (null text: none). A run is a stretch of words of smallest period
    q, of at least max(LEAST, EXPONENT * q) words, that no neighbouring word extends. collapsed is the text's words
    joined by one blank, less those that a run holds after its first q. Rows are judged each by itself, whatever their
    ids (null and repeated ones too); empty texts have no runs; an empty table gives no rows; other columns are ignored.
    No row leaves its task: nothing is shuffled, and a lost executor costs its own rows only.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return id_and_text(docs, id_col, text_col).mapInPandas(_found, schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: in every tenth text or so (by crc32 of the id as text, h; null ids: none) the words from a on repeat
    the first p of them, where a = h // 10 modulo n words and p = 1 + (n - a) // (3 + h // 10 % 8)."""
    d = id_and_text(docs, id_col, text_col)
    h = crc_of_id(F.col("doc_id"))
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    d = d.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_g").isNotNull(), words))
    n = F.size("_w")
    a = F.col("_g") % n
    d = d.withColumn("_a", F.when(n > 0, a))
    p = F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))
    d = d.withColumn("_p", p)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    new = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("_w"), place(i)))
    return d.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """periodic_runs as doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: least start, then
    period; nulls without runs) and the digests runs_sha256 and collapsed_sha256."""
    r = periodic_runs(docs, id_col, text_col)
    top = F.get(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("m"), x["start"].alias("s"), x["period"].alias("p")))), F.lit(0))
    r = r.withColumn("_t", top)
    length = -F.col("_t.m")
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_t.s").alias("start"), length.alias("length"), F.col("_t.p").alias("period"),
        F.floor(1000 * length / F.col("_t.p")).alias("exponent_milli"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
