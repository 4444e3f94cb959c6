"""Best-of, leaderboards, orders, shards, set operations and layered parameters on run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.conditioning import Keys


def best_trial(log: DataFrame, by: Keys) -> DataFrame:
    """The row of least objective per group, the earliest trial on ties; nulls last."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("objective"), "trial")
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def leaderboard(best: DataFrame) -> DataFrame:
    """rank by objective up, mae up, r down, snr down; what is missing comes last. best: one row per method (bounded)."""
    order = [F.asc_nulls_last("objective"), F.asc_nulls_last("mae"), F.desc_nulls_last("r"), F.desc_nulls_last("snr")]
    return best.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def method_order(df: DataFrame, order: DataFrame, name: str = "method") -> DataFrame:
    """df with pos, its place in the order table (method, pos), unknown names after all others."""
    n = order.agg(F.count("*").alias("_n"))
    return df.join(order, name, "left").join(F.broadcast(n)).withColumn("pos", F.coalesce("pos", "_n")).drop("_n")


def shard_assign(methods: DataFrame, shards: int) -> DataFrame:
    """methods (pos, method) with shard: bases in first-seen order, dealt in turn. The list is small by nature."""
    base = F.split_part("method", F.lit("__"), F.lit(1))
    first = methods.groupBy(base.alias("base")).agg(F.min("pos").alias("first"))
    rank = first.withColumn("shard", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("first")) - 1) % max(1, shards))
    return methods.withColumn("base", base).join(rank.select("base", "shard"), "base")


def bundle_manifest(best: DataFrame, allowed: DataFrame, by: Keys) -> DataFrame:
    """by, bundle (map of method to path) and size, for allowed methods only."""
    b = best.join(allowed, F.lower(best["method"]) == F.lower(allowed["allowed"]), "left_semi")
    return b.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "path")))).alias("bundle"), F.sum("size").alias("size"))


def sample_head(trials: DataFrame, by: Keys, order: str, n: int) -> DataFrame:
    """The first n rows per group; n <= 0 keeps all."""
    if n <= 0:
        return trials
    return trials.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def ordered_dedupe(df: DataFrame, name: str, pos: str) -> DataFrame:
    """The first of each name, upper and lower case alike."""
    w = Window.partitionBy(F.lower(name)).orderBy(pos)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def method_family(methods: DataFrame, families: dict[str, str], allowed: DataFrame | None = None) -> DataFrame:
    """methods (pos, name) that end in a known tracker suffix, with family; first of each name; allow-listed."""
    family: Column = F.lit(None).cast("string")
    for suffix, name in families.items():
        family = F.when(F.lower("name").endswith(suffix), F.lit(name)).otherwise(family)
    m = ordered_dedupe(methods.withColumn("family", family).where("family IS NOT NULL"), "name", "pos")
    return m if allowed is None else m.join(allowed, F.lower(m["name"]) == F.lower(allowed["allowed"]), "left_semi")


def run_suffix(tokens: DataFrame, by: Keys, token: str, pos: str, longest: int = 64) -> DataFrame:
    """by, suffix: distinct tokens in order, joined; too long a name becomes its count and a digest."""
    packed = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(pos, token))).alias("t"))
    names = F.array_distinct(F.transform("t", lambda x: x[token]))
    joined = F.array_join(names, "_")
    short = F.concat(F.size(names).cast("string"), F.lit("m_"), F.substring(F.sha1(joined), 1, 10))
    return packed.select(*by, F.when(F.length(joined) > longest, short).otherwise(joined).alias("suffix"))


def pending_only(manifest: DataFrame, done: DataFrame, outputs: list[str], key: str) -> DataFrame:
    """Manifest rows of which not all outputs exist. done: key, output."""
    want = manifest.select(key, F.explode(F.array(*map(F.lit, outputs))).alias("output"))
    missing = want.join(done, [key, "output"], "left_anti").select(key).distinct()
    return manifest.join(missing, key, "left_semi")


def preferred_file(files: DataFrame, by: Keys, preference: list[str], name: str = "file") -> DataFrame:
    """One file per group: the first of the preference list that is there."""
    at = F.array_position(F.array(*map(F.lit, preference)), F.col(name))
    w = Window.partitionBy(*by).orderBy("_p")
    return files.withColumn("_p", at).where("_p > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_p", "_r")


def upsert_estimates(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new, keys, "left_anti").unionByName(new)


def missing_methods(allowed: DataFrame, best: DataFrame) -> DataFrame:
    """Allowed names (method) without an entry in best, upper and lower case alike."""
    return allowed.join(best.select(F.lower("method").alias("_m")).distinct(), F.lower(allowed["method"]) == F.col("_m"), "left_anti")


def obs_cache_join(wanted: DataFrame, cache: DataFrame, keys: Keys, value: str, default: Column) -> DataFrame:
    """wanted with the cached value, else default; cached says which."""
    c = cache.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    return wanted.join(c, keys, "left").withColumn(value, F.coalesce("_v", default)).withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_v", "_hit")


def override_lookup(series: DataFrame, params: DataFrame, value: str) -> DataFrame:
    """series (dataset, method) with its own parameter, else its head's (the part after __)."""
    exact = params.select("dataset", "method", F.col(value).alias("_exact"))
    head = params.select("dataset", F.col("method").alias("_head"), F.col(value).alias("_by_head"))
    s = series.withColumn("_head", F.split_part("method", F.lit("__"), F.lit(2)))
    return s.join(exact, ["dataset", "method"], "left").join(head, ["dataset", "_head"], "left").withColumn(value, F.coalesce("_exact", "_by_head")).drop("_exact", "_by_head", "_head")


def param_overlay(params: DataFrame, paths: list[str]) -> DataFrame:
    """dataset, method and a column per dotted path: the value of greatest prio that is set."""
    p = params.where("value IS NOT NULL").groupBy("dataset", "method", "path").agg(F.max_by("value", "prio").alias("value"))
    return p.groupBy("dataset", "method").pivot("path", paths).agg(F.first("value"))


def autotune_stats(log: DataFrame) -> DataFrame:
    """Counts, sums and the greatest deviation per dataset and method."""
    return log.groupBy("dataset", "method").agg(F.count("*").alias("count"), F.sum("mad").alias("sum_mad"), F.sum("snr").alias("sum_snr"), F.sum("freq").alias("sum_freq"), F.max("mad").alias("max_sigma"))


def autotune_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored statistics brought up to date by those of new rows."""
    return old.unionByName(new).groupBy("dataset", "method").agg(*[F.sum(c).alias(c) for c in ("count", "sum_mad", "sum_snr", "sum_freq")], F.max("max_sigma").alias("max_sigma"))


def regime_map(diagnostics: DataFrame, fps: float) -> DataFrame:
    """The noise, harmonic and damping terms that a method's diagnostics call for, and the time step."""
    pick = lambda c, yes, no: F.when(c, yes).otherwise(no)
    return diagnostics.select(
        "method", pick(F.col("kurtosis") > 3, "robust", "gaussian").alias("r"), pick(F.col("thd") > 0.5, "harmonic", "single").alias("h"),
        pick(F.col("impulse") > 0.01, "damped", "plain").alias("q"), F.lit(1 / fps).alias("dt"),
    )
