"""Near-duplicate groups from bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; the K least values are its sketch. Equal sets fold into a class,
   whatever the ids of its rows; a class is known by a number of its own.
2. Inverted lists: each class is listed under the rarest of its sketch values, as many as any class with which it
   could be linked must share at least one of (overlap ALPHA of K: fewer has a probability under RISK at the
   threshold; for sets of at most K * threshold the bound is exact).
3. Every list ties its members to its most central one, the member that has the fewest rarer values, so a list of n
   copies costs n pairs and not n * n.
4. The sketch of the union estimates the similarity of a pair; pairs far below the threshold go. The texts of what is
   left meet, and the full sets decide. Links are closed to components.
5. Lists that still hold more than one component: in those of at most OPEN_LIST members, sketches are compared and the
   pairs that pass go through step 4. Members of longer ones are listed anew by their full sets, exactly: a pair
   must share one of the few values by which a set may differ from one of the other's size, so sizes are banded and a
   member that has more private values than that is in no list. Steps 3 and 4 follow. What is open even then is
   compared by full sets, block against block, inside tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import alone, components, cut, drop, id_and_text, salted_min

K = 48
RISK = 1e-9
#: Up to so many members, a list's passing pairs are formed outright; members of a longer list are listed anew.
OPEN_LIST = 64
#: Sizes of one band differ by this ratio at most; so many values at most are broadcast as frequent.
BAND, OFTEN = 1.02, 50_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CACHE_ROWS = 100_000
#: Bytes of an Arrow batch of texts, sketches or sets.
BATCH_BYTES = 4 << 20


class _Words(dict):
    """word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ROWS:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_hash_of = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; with fewer words, of the whole sequence."""
    alone("words", _hash_of.clear)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(w) - width + 1)
        h = np.full(n, min(len(w), width), np.uint64)
        for i in range(min(width, len(w))):
            h = _mix(h * _M1 + w[i : i + n])
    return np.unique(h)


def least_overlap(k: int, threshold: float, risk: float = RISK) -> int:
    """The most values of k that two sets at the threshold share but for a probability of risk."""
    tail, j = 0.0, k
    while j >= 0:
        tail += math.comb(k, j) * (1 - threshold) ** j * threshold ** (k - j)
        if tail > risk:
            break
        j -= 1
    return max(1, k - j)


def _sketches(width: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, h, t in zip(b["doc_id"].array, b["text_hash"], b["text"], strict=True):
                s = shingle_set(t, width)
                d = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                out.append((i, h, len(s), int(d[0]), int(d[1]), s[:K].view(np.int64).copy()))  # a view would hold the whole set
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n", "d1", "d2", "sketch"]).astype({"doc_id": "Int64"})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"cid": b["cid"], "n": [len(x) for x in sets], "values": sets})

    return run


def _estimated(least: int, threshold: float):
    """Keeps the pairs whose union sketch does not rule a link out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y, n, m) in enumerate(zip(b["sa"], b["sb"], b["na"], b["nb"], strict=True)):
                x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
                union = np.union1d(x, y)
                if n <= K and m <= K:  # the sets are whole
                    keep[i] = n + m - len(union) >= threshold * len(union) - 1e-9
                else:
                    union = union[: min(K, len(union))]
                    keep[i] = int(np.isin(union, x).astype(int) @ np.isin(union, y)) >= least
            yield b.loc[keep, ["a", "b"]]

    return run


def _confirmed(width: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (a, x, y) in enumerate(zip(b["a"], b["ta"], b["tb"], strict=True)):
                if last[0] != (a, x):
                    last = ((a, x), shingle_set(x, width))
                s, t = last[1], shingle_set(y, width)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = den * common >= num * (len(s) + len(t) - common) and common > 0
            yield b.loc[keep, ["a", "b"]]

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (cid, n, value) with df, the classes that have the value, and at, the value's rank in its class from the
    rarest on."""
    counts = cut(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    # Values in more than one of OFTEN of the rows are fewer than OFTEN: they may be broadcast, and no other value's
    # rows make up much of a join.
    often = max(64, rows.count() // OFTEN)
    hot = F.broadcast(counts.where(F.col("df") > often).withColumnRenamed("df", "hot_df"))
    rows = rows.join(hot, "value", "left")
    cold = rows.where("hot_df IS NULL").join(counts.where(F.col("df") <= often), "value", "left").select("cid", "n", "value", F.coalesce("df", F.lit(1)).alias("df"))
    rows = cold.unionByName(rows.where("hot_df IS NOT NULL").select("cid", "n", "value", F.col("hot_df").alias("df")))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("cid").orderBy("df", "value")))


def _prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """(value, cid, n, at): each class under its rarest sketch values."""
    rows = _ranked(reps.select("cid", "n", F.explode("sketch").alias("value")))
    whole = F.col("n") <= math.floor(K * threshold)
    need = F.when(whole, F.ceil(F.col("n") * F.lit(threshold) - 1e-9)).otherwise(F.lit(least_overlap(K, threshold)))
    return rows.where((F.col("at") <= F.least(F.col("n"), F.lit(K)) - need + 1) & (F.col("df") > 1)).select("value", "cid", "n", "at")


def _banded(sets: DataFrame, threshold: float) -> DataFrame:
    """(value, band, cid, n, at, small): each full set under its rarest values, for the sizes that a partner may have.

    If the first value that two sets share is the at-th of the one with n values, they share at most n - at + 1; at the
    threshold that bounds the partner's size (reach). The larger set goes to the bands of smaller sizes within reach;
    the smaller one waits in its own band (small).
    """
    rows = _ranked(sets.select("cid", "n", F.explode("values").alias("value"))).where("df > 1")
    n, t = F.col("n"), threshold
    low = F.greatest(F.lit(1), F.ceil(n * t - 1e-6)).cast("long")
    reach = F.least(F.floor(n / t + 1e-6), F.floor((n - F.col("at") + 1) * (1 + t) / t - n + 1e-6)).cast("long")
    rows = rows.withColumn("low", low).withColumn("reach", reach).where("reach >= low")
    band = lambda m: F.floor(F.log(m) / math.log(BAND)).cast("int")
    rows = rows.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.least("n", "reach")))))
    return rows.select("value", "band", "cid", "n", "at", ((F.col("band") == band(n)) & (F.col("reach") >= n)).alias("small"))


def _fits(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.lit(threshold - 1e-9) * F.greatest(a, b)


def _texts_of(cids: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, text) of the classes cids (one column, distinct); one text for each."""
    need = reps.join(cids, "cid").select("cid", F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), "text_hash")
    return texts.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), "text_hash", "text").join(need, ["_id", "text_hash"]).dropDuplicates(["_id", "text_hash", "cid"]).select("cid", "text")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that are links: union-sketch estimate, then the full sets."""
    sk = reps.select("cid", "n", "sketch")
    near = pairs.join(sk.toDF("a", "na", "sa"), "a").join(sk.toDF("b", "nb", "sb"), "b")
    near = cut(near.mapInPandas(_estimated(least_overlap(K, threshold), threshold), "a long, b long"), BATCH_BYTES)
    ends = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    t = cut(_texts_of(ends, reps, texts))
    both = near.join(t.toDF("b", "tb"), "b").join(t.toDF("a", "ta"), "a")
    out = cut(both.mapInPandas(_confirmed(width, round(threshold * 100), 100), "a long, b long"), BATCH_BYTES)
    drop(near, t)
    return out


def _starred(lists: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b), a < b: the members of each list with its most central one (of those that are small, if lists say it)."""
    head = F.struct("at", "cid", "n")
    if "small" in lists.columns:
        head = F.when(F.col("small"), head)
    led = salted_min(lists.withColumn("head", head), keys, "head", "lead", "cid").where(F.col("lead.cid") != F.col("cid"))
    return led.where(_fits("lead.n", "n", threshold)).select(F.least("lead.cid", "cid").alias("a"), F.greatest("lead.cid", "cid").alias("b")).distinct()


def _open(lists: DataFrame, keys: list[str], comp: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with each member's component and the list's size."""
    rows = lists.join(comp.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    size = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")]
    ok = "lo < hi"
    if "small" in lists.columns:
        size.append(F.max("small").alias("any_small"))
        ok += " AND any_small"
    return cut(rows.join(rows.groupBy(*keys).agg(*size).where(ok).select(*keys, "size"), keys))


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by keys, one frame each, however the batches cut them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held)
            held = []
        for x, y in zip(starts, np.r_[starts[1:], len(b)], strict=True):
            if x and held:
                yield pd.concat(held)
                held = []
            held.append(b.iloc[x:y])
    if held:
        yield pd.concat(held)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    keep = times[column] > 1  # a value of one set alone counts nowhere
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    size = int(column.max(initial=-1)) + 1
    for lo in range(0, size, 8192):
        part = (column >= lo) & (column < lo + 8192)
        x = np.zeros((len(sets), min(8192, size - lo)), np.float32)
        x[owner[part], column[part] - lo] = 1
        out += x[left] @ x[right].T
    return out


def _short_lists(least: int, threshold: float):
    """The pairs of a list whose sketches pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _whole_groups(batches, ["value"]):
            n, c, cid = g["n"].to_numpy(), g["component"].to_numpy(), g["cid"].to_numpy()
            every = np.arange(len(g))
            common = _common([np.asarray(x) for x in g["sketch"]], every, every)
            nl, nr = n[:, None], n[None, :]
            need = np.where((nl <= K) & (nr <= K), threshold / (1 + threshold) * (nl + nr) - 1e-4, np.minimum(least, np.minimum(nl, nr) * threshold - 1e-4))
            ok = (common >= need) & (np.minimum(nl, nr) >= threshold * np.maximum(nl, nr) - 1e-9) & (c[:, None] != c[None, :])
            x, y = np.nonzero(ok & (cid[:, None] < cid[None, :]))
            yield pd.DataFrame({"a": cid[x], "b": cid[y]})

    return run


def _long_lists(num: int, den: int):
    """Compares the full sets in a list, block against block; gives links enough to join what links join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _whole_groups(batches, ["value", "band", "bi", "bj"]):
            sets = [np.asarray(x) for x in g["values"]]
            n, cid, c = g["n"].to_numpy(), g["cid"].to_numpy(), g["component"].to_numpy()
            left, right = np.flatnonzero(g["block"] == g["bi"]), np.flatnonzero(g["block"] == g["bj"])
            common = _common(sets, left, right)
            ok = (den * common >= num * (n[left][:, None] + n[right][None, :] - common)) & (c[left][:, None] != c[right][None, :])
            root = {k: k for k in np.unique(c)}

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            out = []
            for x, y in zip(*np.nonzero(ok), strict=True):
                p, q = find(c[left[x]]), find(c[right[y]])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((cid[left[x]], cid[right[y]]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


#: Members of a list that meet in one task are at most about two blocks.
BLOCK = 256


def _blocks(rows: DataFrame) -> DataFrame:
    """Each row of a list once for each pair of blocks that its block is in."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")


def _listed_anew(members: DataFrame, comp: DataFrame, links: DataFrame, reps: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links between the members (cid) of long lists by their full sets, beyond those of comp and links."""
    sets = cut(_texts_of(members, reps, texts).mapInPandas(_sets(width), "cid long, n long, values array<long>"), BATCH_BYTES)
    keys = ["value", "band"]
    lists = cut(_banded(sets, threshold))
    found = links.union(_links(_starred(lists, keys, threshold), reps, texts, width, threshold))
    still = _open(lists, keys, cut(components(found)))
    if still.isEmpty():
        return found
    # Sets travel only under the lists that are open, which hold what no bound of sizes and ranks could part.
    dealt = _blocks(still).join(sets.select("cid", "values"), "cid").repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")
    return found.union(cut(dealt.mapInPandas(_long_lists(round(threshold * 100), 100), "a long, b long"), BATCH_BYTES))


_NO_ID = -(2**63)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, text_hash: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (and stays, text_hash).

    A-Z are lower-cased; words are runs of anything but ASCII white space. Texts without words (null, empty) have an
    empty set and are linked with nothing. component_id is the least id reachable over links (Jaccard similarity of
    the full sets >= threshold; null only if no row reached has an id), kept says whether it is the row's own. Rows
    are judged each by their own text, also where ids repeat or are null. With text_hash, rows also tell the xxhash64
    of their text, and stays holds for exactly one row of each component: of those of least id (null last) one of the
    equal. An empty table gives no rows; other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    first = texts.mapInPandas(_sketches(width, threshold), "doc_id long, text_hash long, n long, d1 long, d2 long, sketch array<long>")
    first = cut(first.withColumn("uid", F.monotonically_increasing_id()), BATCH_BYTES)
    rows = cut(salted_min(first.where("n > 0").select("uid", "doc_id", "text_hash", "n", "d1", "d2"), ["d1", "d2"], "uid", "cid", "uid").drop("d1", "d2"))
    reps = cut(first.join(rows.where("uid = cid").select("uid"), "uid").select(F.col("uid").alias("cid"), "doc_id", "text_hash", "n", "sketch"))
    none = first.where("n = 0").select("uid", "doc_id", "text_hash", "n", F.col("uid").alias("cid"))
    lists = cut(_prefixes(reps, threshold))
    links = _links(_starred(lists, ["value"], threshold), reps, texts, width, threshold)
    comp = cut(components(links))
    still = _open(lists, ["value"], comp)
    drop(lists)
    short = still.where(F.col("size") <= OPEN_LIST).join(reps.select("cid", "sketch"), "cid").repartition("value").sortWithinPartitions("value")
    pairs = cut(short.mapInPandas(_short_lists(least_overlap(K, threshold), threshold), "a long, b long").distinct(), BATCH_BYTES)
    links = links.union(_links(pairs, reps, texts, width, threshold))
    members = still.where(F.col("size") > OPEN_LIST).select("cid").distinct()
    if not members.isEmpty():
        links = _listed_anew(members, comp, links, reps, texts, width, threshold)
    comp = cut(components(links))
    drop(still, pairs)
    named = rows.join(comp.toDF("cid", "component"), "cid", "left").withColumn("cid", F.coalesce("component", "cid")).drop("component").unionByName(none)
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    out = salted_min(named.withColumn("own", best), ["cid"], "own", "lead", "uid")
    stays = [(F.col("uid") == F.col("lead.uid")).alias("stays"), "text_hash"] if text_hash else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("lead.doc_id")).alias("kept"), *stays)
