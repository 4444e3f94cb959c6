"""Exact quantiles of a key with any number of rows, without holding its values.

An exact percentile keeps every distinct value of a group in one buffer. Beyond a bound, rounds of counting narrow each
key's bracket instead: values are counted in even buckets between its ends, and the ends move to the least and greatest
values of the buckets that hold the wanted ranks. The state of a key is one row; a round's is one row for a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import stored

#: Values of a key that a task may hold, and buckets of a round.
LIMIT, BUCKETS = 1_000_000, 1_024


def largest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def _bracketed(rows: DataFrame, keys: list[str], p: float, limit: int) -> DataFrame:
    """keys, q: the quantile p of v (no nulls)."""
    w = Window.partitionBy(*keys)
    s = rows.groupBy(*keys).agg(F.count("v").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = (F.col("size") - 1) * F.lit(float(p))
    s = stored(s.select(*keys, "size", "lo", "hi", F.floor(place).alias("r1"), F.ceil(place).alias("r2"), (place - F.floor(place)).alias("part"), (F.col("lo") == F.col("hi")).alias("done")))
    while s.where((F.col("size") > limit) & ~F.col("done")).limit(1).count():
        # Quarters: the span of the largest numbers is none.
        share = (F.col("v") / 4 - F.col("lo") / 4) / (F.col("hi") / 4 - F.col("lo") / 4)
        inside = rows.join(s.where("NOT done").select(*keys, "lo", "hi"), keys).where("v BETWEEN lo AND hi")
        counts = inside.groupBy(*keys, F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        counts = counts.withColumn("upto", F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("c"))
        j = counts.join(s.select(*keys, "r1", "r2", "part"), keys)
        one = (F.col("before") <= F.col("r1")) & (F.col("r1") < F.col("upto"))
        two = (F.col("before") <= F.col("r2")) & (F.col("r2") < F.col("upto"))
        of = lambda c, x: F.max(F.when(c, F.col(x)))
        a = j.where(one | two).groupBy(*keys, "part", "r1", "r2").agg(of(one, "b").alias("b1"), of(two, "b").alias("b2"), of(one, "c").alias("size"), of(one, "before").alias("before"), of(one, "mn").alias("mn1"), of(one, "mx").alias("mx1"), of(two, "mn").alias("mn2"))
        # Ranks in two buckets are the last value of the one and the first of the other.
        two_apart = F.col("b1") != F.col("b2")
        a = a.withColumn("lo", F.when(two_apart, F.col("mx1")).otherwise(F.col("mn1"))).withColumn("hi", F.when(two_apart, F.col("mn2")).otherwise(F.col("mx1")))
        a = a.select(*keys, "size", "lo", "hi", (F.col("r1") - F.col("before")).alias("r1"), (F.col("r2") - F.col("before")).alias("r2"), "part", (two_apart | (F.col("lo") == F.col("hi"))).alias("done"))
        s = stored(a.unionByName(s.where("done")))
    flat = s.where("done").select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))
    rest = rows.join(s.where("NOT done"), keys).where("v BETWEEN lo AND hi").groupBy(*keys, "r1", "r2", "part").agg(F.array_sort(F.collect_list("v")).alias("a"))
    x, y = F.get("a", F.col("r1").cast("int")), F.get("a", F.col("r2").cast("int"))
    return flat.unionByName(rest.select(*keys, (x + (y - x) * F.col("part")).alias("q")))


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: list[float], limit: int | None = None) -> DataFrame:
    """keys, q: array of the exact quantiles (interpolated) of a key's values that are not null; keys without any are
    left out. limit: so many values of a key may be held by a task."""
    limit = LIMIT if limit is None else limit
    rows = df.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    if largest(rows, keys) <= limit:
        return rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    out = None
    for i, p in enumerate(probs):
        one = _bracketed(rows, keys, p, limit).withColumnRenamed("q", f"_q{i}")
        out = one if out is None else out.join(one, keys)
    return out.select(*keys, F.array(*[f"_q{i}" for i in range(len(probs))]).alias("q"))
