"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

`text_metrics` counts in one pass of built-in functions. `scores` brings each document's rates to a scale on which
documents of all lengths compare, `adaptive_fences` summarises each (lang, source) group with percentile_approx, whose
sketches merge across partitions, and `quality_rules` joins the fences back. No cutoff is fixed: a fence lies REACH
spreads of the group beyond its quantiles.

* mean_word: distance of the mean word length from the group's median, times the root of n_words. Fences on both sides;
  the spread is the interquartile range.
* symbol_rate: symbols per character, times the root of the characters. Fence above; the spread is the interquartile
  range or, if that is less (most groups have next to no symbols), the deviation of so many independent events in the
  group: on this scale the root of its symbols over its characters.
* dup_line_rate, repeat_rate: repeats come in clumps, so the spread is that of the rows that have any: from the lower
  to the upper decile of the group's or, if that is less, of all groups' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE, SPACE_CHARS, cut

#: Sketch accuracy: the rank error of a quantile is at most 1 / ACCURACY of the group's rows.
ACCURACY = 10_000
#: A row is out when it is more than so many spreads beyond the quantiles of its group.
REACH = 3.0
#: metric -> rate
METRICS = {
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / n_words",
}
#: Metrics that most rows lack and the others have in clumps.
CLUMPED = ("dup_line_rate", "repeat_rate")
#: Up to this many (windows x repeated hashes) a linear search is cheaper than sorting.
SEARCH = 400_000


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at the given sorted starts."""
    n = F.size(starts)
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.least(F.lit(3), F.get(starts, i + 1) - F.get(starts, i)))
    return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(3)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, x: a + x))


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the grouping columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (longs).

    Windows are compared by a 64-bit hash of their three words, each hashed with the next as seed.
    """
    # A copy under private names: the caller's other columns can not clash.
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), *[docs[c].alias(c) for c in by], F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    d = d.withColumn("_trim", F.trim(F.col("_t"), F.lit(SPACE_CHARS)))
    d = d.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE + "+")))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != ""))
    d = d.withColumn("_n", F.size("_words"))
    w = F.col("_words")
    d = d.withColumn("_h", F.when(F.col("_n") < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    d = d.withColumn("_s", F.sort_array("_h"))
    s, h = F.col("_s"), F.col("_h")
    d = d.withColumn("_dups", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))
    place = F.sequence(F.lit(0), F.size(h) - 1)
    few = F.filter(place, lambda i: F.array_contains(F.col("_dups"), F.get(h, i)))
    d = d.withColumn("_pairs", F.when((F.size("_dups") > 0) & (F.size("_dups").cast("long") * F.size("_h") > SEARCH), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    p = F.col("_pairs")
    many = F.sort_array(
        F.transform(
            F.filter(p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | (F.get(p, j + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"],
        )
    )
    d = d.withColumn("_starts", F.when(F.size("_dups") == 0, F.array().cast("array<int>")).when(p.isNull(), few).otherwise(many))
    return d.select(
        "doc_id",
        *by,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_starts")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def with_rates(metrics: DataFrame) -> DataFrame:
    """The metrics as rates, null for texts without words."""
    return metrics.select("*", *[F.expr(f"CASE WHEN n_words > 0 THEN CAST({e} AS DOUBLE) END").alias(k) for k, e in METRICS.items()])


def _sketch(value: Column, *ranks: float) -> Column:
    return F.percentile_approx(value, list(ranks), ACCURACY)


def _joined(rows: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with their group's other columns; null is a group of its own."""
    named = groups.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in groups.columns if c not in by])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def scores(rates: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """rates with z_<metric>, what the fences hold for: null for texts without words."""
    rows = _joined(rates, rates.groupBy(*by).agg(F.percentile_approx("mean_word", 0.5, ACCURACY).alias("_middle")), by)
    mean, symbols = (F.col("mean_word") - F.col("_middle")) * F.sqrt("n_words"), F.col("symbol_rate") * F.sqrt("word_chars")
    return rows.select("*", mean.alias("z_mean_word"), symbols.alias("z_symbol_rate"), *[F.col(k).alias(f"z_{k}") for k in CLUMPED]).drop("_middle")


def adaptive_fences(scored: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per group: low_<metric> and high_<metric> for z_<metric>; null where nothing is beyond the fence."""
    some = {k: F.when(F.col(f"z_{k}") > 0, F.col(f"z_{k}")) for k in CLUMPED}
    deciles = [_sketch(some[k], 0.1, 0.9).alias(k) for k in CLUMPED]
    worded = F.col("n_words") > 0
    events = F.sum(F.when(worded, F.col("n_symbols"))) / F.sum(F.when(worded, F.greatest("word_chars", F.lit(1))))
    quartiles = [_sketch(F.col(f"z_{k}"), 0.25, 0.75).alias(k) for k in ("mean_word", "symbol_rate")]
    groups = scored.groupBy(*by).agg(*quartiles, *deciles, F.sqrt(events).alias("_noise"))
    pooled = scored.agg(*[_sketch(some[k], 0.1, 0.9).alias(f"_{k}") for k in CLUMPED])  # one row
    ends = lambda k: (F.get(F.col(k), F.lit(0)), F.get(F.col(k), F.lit(1)))
    (m1, m3), (s1, s3) = ends("mean_word"), ends("symbol_rate")
    out = [
        (m1 - REACH * (m3 - m1)).alias("low_mean_word"),
        (m3 + REACH * (m3 - m1)).alias("high_mean_word"),
        (s3 + REACH * F.greatest(s3 - s1, "_noise")).alias("high_symbol_rate"),
    ]
    for k in CLUMPED:
        (d1, d9), (all1, all9) = ends(k), ends(f"_{k}")
        out.append((d9 + REACH * F.greatest(d9 - d1, all9 - all1)).alias(f"high_{k}"))
    none = F.lit(None).cast("double")
    return groups.join(F.broadcast(pooled)).select(*by, *out, *[none.alias(f"low_{k}") for k in METRICS if k != "mean_word"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null or empty text has no words and fails the base rules. Null lang or source forms a group of its own. A row
    passes when it passes the base rules and every rate lies within its group's fences. In a group without a row that
    repeats lines (or words), none lies beyond that fence. Repeated rows are judged alike; an empty table gives no rows.
    """
    scored = cut(scores(with_rates(cut(text_metrics(docs, id_col, text_col, by))), by))
    inside = F.lit(True)
    for k in METRICS:
        for within in (F.col(f"z_{k}") >= F.col(f"low_{k}"), F.col(f"z_{k}") <= F.col(f"high_{k}")):
            inside = inside & F.coalesce(within, F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _joined(scored, adaptive_fences(scored, by), by).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & inside).alias("kept"),
    )
