"""Join of texts by the Jaccard similarity of their word shingles, from prefixes of tokens and of token combinations.

Two sets of at least threshold t share at least t of the larger one's tokens. So, whatever the order of tokens, the j-th
that they share is among the first n - ceil(t n) + j of either (n: its size). All steps below rest on that; nothing is
left to chance but the 64-bit hash of a shingle.

1. Equal sets fold into a class. A class's tokens are ordered by hash and its prefix is extended by a twentieth of its
   size: it must share as many tokens of the prefix, its quota, with a linked class. Most classes share fewer with all
   others together, and are done.
2. The shared tokens of an extended prefix are ordered anew, rare ones first. Two linked classes share the larger quota
   of them, so each class left is listed under all of them but the last quota - 1: tokens that no other class has are in
   no list, and frequent ones only where rare ones are too few. A list ties its members to its first one; lists of rare
   tokens (at most RARE members) that still hold several components give their pairs.
3. Members of longer lists that still do are ordered anew by their whole sets, rare tokens first, and listed again under
   single tokens. Where a token is frequent, the prefix is extended by one place and its list is parted by combinations
   of two tokens, then three, and so on, as long as those lists hold at most a quarter of its pairs. What no longer
   combination parts (near copies of one text that miss the threshold share nearly all tokens) is compared by full sets,
   in blocks.
4. A pair is dropped if its prefixes differ in more tokens than similar sets may; the full sets decide on the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import components, cut, drop, id_and_text, salted_min, sliced
from cadenza.llm.near_dedup import _blocks, _long_lists, shingle_set

#: Tokens of more members are frequent; so many tokens make the longest combination.
RARE, LONGEST = 64, 8
#: A prefix is extended by one token in so many.
EXTENDED = 20
#: Tokens that are common enough to be handled apart are fewer than this times the average size of a set.
OFTEN = 50_000
#: Ids of up to so many classes are broadcast (8 bytes each); more are joined by shuffle.
SMALL = 1_000_000
#: A partition's texts are held in frames of at most so many characters.
SLICE_CHARS = 4_000_000


def _spare(n: Column, threshold: float) -> Column:
    """Tokens of a set of n that a similar one may lack."""
    return n - F.ceil(n * F.lit(threshold) - 1e-9)


def _prefixes(width: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, SLICE_CHARS):
            out = []
            for i, h, t in zip(b["doc_id"].array, b["text_hash"], b["text"], strict=True):
                s = shingle_set(t, width)
                n = len(s)
                d = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                most = n - math.ceil(threshold * n - 1e-9) + 1 + n // EXTENDED
                out.append((i, h, n, int(d[0]), int(d[1]), s[:most].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n", "d1", "d2", "prefix"]).astype({"doc_id": "Int64"})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, SLICE_CHARS):
            sets = [shingle_set(t, width).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"cid": b["cid"], "n": [len(x) for x in sets], "values": sets})

    return run


def _near(threshold: float):
    """Pairs whose prefixes do not differ by more tokens than linked sets can."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y, n, m) in enumerate(zip(b["pa"], b["pb"], b["na"], b["nb"], strict=True)):
                x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
                ends = [p[-1] for p, size in ((x, n), (y, m)) if len(p) < size]
                if ends:  # beyond the shorter reach nothing is known
                    x, y = x[x <= min(ends)], y[y <= min(ends)]
                spare = n + m - 2 * math.ceil(threshold / (1 + threshold) * (n + m) - 1e-6)
                keep[i] = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= spare
            yield b.loc[keep, ["a", "b"]]

    return run


def _confirmed(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["va"], b["vb"], strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield b.loc[keep, ["a", "b"]]

    return run


def _bounded(ids: DataFrame) -> DataFrame:
    """ids as the side of a join that is broadcast, if it is small."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def _counted(rows: DataFrame) -> DataFrame:
    """rows (cid, value, ...) with df, the rows of the value; values of one row are dropped. Frequent values are joined
    apart: they are few, and no other value's rows make up much of a join."""
    counts = cut(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    often = max(RARE, rows.count() // OFTEN)
    hot = F.broadcast(counts.where(F.col("df") > often).withColumnRenamed("df", "hot"))
    marked = rows.join(hot, "value", "left")
    cold = marked.where("hot IS NULL").drop("hot").join(counts.where(F.col("df") <= often), "value")
    return cold.unionByName(marked.where("hot IS NOT NULL").withColumnRenamed("hot", "df"))


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are links."""
    p = reps.select("cid", "n", "prefix")
    near = pairs.join(p.toDF("a", "na", "pa"), "a").join(p.toDF("b", "nb", "pb"), "b").mapInPandas(_near(threshold), "a long, b long")
    v = sets.select("cid", "values")
    both = near.join(v.toDF("b", "vb"), "b").join(v.toDF("a", "va"), "a")
    return cut(both.mapInPandas(_confirmed(round(threshold * 100), 100), "a long, b long"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(a: str, b: str, threshold: float) -> Column:
    """Members (n, at, k, quota) of a list whose k-th common tokens stand there can still be linked.

    What stands behind the tokens must make up the quota or, where that is null (orders of whole sets), all that linked
    sets of such sizes share; the sizes alone must allow a link."""
    x, y = (lambda c: F.col(a.format(c))), (lambda c: F.col(b.format(c)))
    need = F.lit(threshold / (1 + threshold) - 1e-9) * (x("n") + y("n"))
    reach = x("k") + F.least(x("n") - x("at"), y("n") - y("at"))
    return (reach >= F.coalesce(F.greatest(x("quota"), y("quota")).cast("double"), need)) & (F.least(x("n"), y("n")) >= need)


def _starred(lists: DataFrame, threshold: float) -> DataFrame:
    """Each list's members with its first one."""
    led = salted_min(lists.withColumn("head", F.struct("cid", "n", "at", "quota", "k")), ["sig"], "head", "lead", "cid").where(F.col("lead.cid") != F.col("cid"))
    return led.where(_fits("lead.{}", "{}", threshold)).select(*_pair("lead.cid", "cid")).distinct()


def _open(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Lists that hold more than one component, with each member's component and the list's size."""
    rows = lists.join(comp.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    size = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("sig", "size")
    return cut(rows.join(size, "sig"))


def _pairs(short: DataFrame, threshold: float) -> DataFrame:
    """The pairs of short lists (at most RARE members each) between components."""
    one = short.select("sig", "cid", "n", "at", "k", "quota", "component")
    other = one.select("sig", *[F.col(c).alias(f"{c}_") for c in ("cid", "n", "at", "k", "quota", "component")])
    both = one.join(other, "sig").where((F.col("cid") < F.col("cid_")) & (F.col("component") != F.col("component_")))
    return both.where(_fits("{}", "{}_", threshold)).select(*_pair("cid", "cid_")).distinct()


def _merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """Components of those of comp (node, component) and the links found. The former hang on their roots already, which
    saves rounds, and so plans that the driver holds."""
    if found.isEmpty():
        return comp
    return cut(components(comp.toDF("a", "b").union(found)))


def _combined(members: DataFrame, comp: DataFrame, links: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components of comp and links, and of the links among the members (cid) of frequent tokens' lists."""
    rows = _counted(sets.join(members, "cid").select("cid", "n", F.explode("values").alias("value")))
    # Tokens that only one member has come first and are in no list; the others follow from the rarest on.
    shared = F.count("*").over(Window.partitionBy("cid"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("df", "value"))
    rows = rows.withColumn("at", (F.col("n") - shared + rank).cast("int")).where(F.col("at") <= _spare(F.col("n"), threshold) + LONGEST)
    tokens = cut(rows.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("tokens")))
    spare, no_quota = _spare(F.col("n"), threshold), F.lit(None).cast("long").alias("quota")
    lists = tokens.select("cid", "n", F.inline("tokens")).where(F.col("at") <= spare + 1).select(F.col("value").alias("sig"), "cid", "n", "at", F.lit(1).alias("k"), no_quota)
    for k in range(1, LONGEST + 1):
        lists = cut(lists)
        if lists.isEmpty():
            break
        comp = _merged(comp, links.union(_links(_starred(lists, threshold), reps, sets, threshold)))
        still = _open(lists, comp)
        drop(lists)
        if still.isEmpty():
            return comp
        links = _links(_pairs(still.where(F.col("size") <= RARE), threshold), reps, sets, threshold)
        # A frequent list goes on to longer combinations where they part it: where their lists would hold at most a
        # quarter of its pairs, and be fewer rows than that.
        after = F.filter("tokens", lambda t: (t["at"] > F.col("at")) & (t["at"] <= F.col("spare") + (k + 1)))
        wide = still.where(F.col("size") > RARE).join(tokens.drop("n"), "cid").withColumn("spare", spare).withColumn("after", after)
        total = F.sum(F.size("after").cast("long")).over(Window.partitionBy("sig"))
        wide = cut(wide.drop("tokens", "spare").withColumn("rows", total))
        pairs = F.col("size").cast("long") * F.col("size")
        some = wide.where(F.lit(k < LONGEST) & (16 * F.col("rows") <= pairs)).select("sig", "size", F.explode("after").alias("t"))
        parts = some.groupBy("sig", "size", "t.value").agg(F.count("*").alias("c")).groupBy("sig", "size").agg(F.sum(F.col("c") * F.col("c")).alias("then"))
        parted = cut(parts.where(4 * F.col("then") <= pairs).select("sig", F.lit(True).alias("goes")))
        wide = wide.join(parted, "sig", "left")
        goes = F.coalesce("goes", F.lit(False))
        left = wide.where(~goes).withColumnRenamed("sig", "value").withColumn("band", F.lit(0))
        dealt = _blocks(left.drop("after", "goes")).join(sets.select("cid", "values"), "cid")
        keys = ["value", "band", "bi", "bj"]
        dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
        links = links.union(cut(dealt.mapInPandas(_long_lists(round(threshold * 100), 100), "a long, b long")))
        lists = wide.where(goes).select("sig", "cid", "n", F.explode("after").alias("t")).select(F.xxhash64("sig", "t.value").alias("sig"), "cid", "n", "t.at", F.lit(k + 1).alias("k"), no_quota)
    return _merged(comp, links)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a row's set are its distinct shingles of
    width words (with fewer words, the whole sequence). Rows link whose sets' Jaccard similarity is at least threshold
    (in hundredths); component_id is the least id reachable over links, the row's own included (null only if no row
    reached has an id). Texts without words (null, empty) have an empty set and link with nothing. Rows are judged each
    by their own text, also where ids repeat or are null. An empty table gives no rows; other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    first = texts.mapInPandas(_prefixes(width, threshold), "doc_id long, text_hash long, n long, d1 long, d2 long, prefix array<long>")
    first = cut(first.withColumn("uid", F.monotonically_increasing_id()))
    rows = cut(salted_min(first.where("n > 0").select("uid", "doc_id", "n", "d1", "d2"), ["d1", "d2"], "uid", "cid", "uid").drop("d1", "d2"))
    classes = first.join(rows.where("uid = cid").select("uid"), "uid").select(F.col("uid").alias("cid"), "doc_id", "text_hash", "n", "prefix")
    # The first so many tokens that a class shares with a linked one lie in both extended prefixes.
    quota = (1 + F.floor(F.ceil(F.col("n") * F.lit(threshold) - 1e-9) / EXTENDED)).alias("quota")
    shared = _counted(classes.select("cid", "n", F.explode("prefix").alias("value"))).groupBy("cid")
    shared = shared.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("tokens")).select("*", F.size("tokens").alias("hits"), quota)
    shared = shared.where(F.col("hits") >= F.col("quota")).withColumn("tokens", F.slice(F.col("tokens.value"), 1, (F.col("hits") - F.col("quota") + 1).cast("int")))
    live = cut(shared)
    reps = cut(classes.join(_bounded(live.select("cid")), "cid"))
    want = reps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "cid")
    # Rows of one id and text hash have one text; a class reads any of them.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_h"))
    found = texts.join(_bounded(want), same).select("cid", "text")
    sets = cut(found.mapInPandas(_sets(width), "cid long, n long, values array<long>").dropDuplicates(["cid"]))
    # The quota counts what is left of the shared tokens; at is so put that as many places follow it.
    place = live.select("cid", "n", "hits", "quota", F.posexplode("tokens").alias("i", "sig"))
    lists = cut(place.select("sig", "cid", "n", (F.col("n") - F.col("hits") + F.col("i") + 1).alias("at"), F.lit(1).alias("k"), "quota"))
    links = _links(_starred(lists, threshold), reps, sets, threshold)
    comp = cut(components(links))
    still = _open(lists, comp)
    links = _links(_pairs(still.where(F.col("size") <= RARE), threshold), reps, sets, threshold)
    members = cut(still.where(F.col("size") > RARE).select("cid").distinct())
    comp = _merged(comp, links) if members.isEmpty() else _combined(members, comp, links, reps, sets, threshold)
    none = first.where("n = 0").select("uid", "doc_id", "n", F.col("uid").alias("cid"))
    named = rows.join(comp.toDF("cid", "component"), "cid", "left").withColumn("cid", F.coalesce("component", "cid")).drop("component").unionByName(none)
    out = salted_min(named.withColumn("own", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")), ["cid"], "own", "lead", "uid")
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id")))
    drop(first, rows, live, reps, sets, lists, still, members)
    return out
