"""The registered queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import crc_of_id, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def _held_out(mod: int, at: int):
    """Whether crc32(doc_id as text) has the held-out remainder."""
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(mod)) == at


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _held_out(5, 0), threshold=0.3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _held_out(3, 1), threshold=0.7)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), width=13)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"), _held_out(3, 1))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), width=200)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), width=3, threshold=0.9)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.periodic_runs import planted, run_digests

    return run_digests(planted(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP5 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


# The sketches are exact on groups as small as those that SQL is compared on, so discrete quartiles stand for them.
_OP9 = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS tri
      FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
dup AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(3) r(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
e AS (SELECT *, {rates} FROM m),
mid AS (SELECT lang, source, quantile_disc(mean_word, 0.5) AS middle FROM e GROUP BY lang, source),
r AS (SELECT e.*, (mean_word - middle) * sqrt(n_words) AS zm, symbol_rate * sqrt(word_chars) AS zs
      FROM e JOIN mid ON mid.lang IS NOT DISTINCT FROM e.lang AND mid.source IS NOT DISTINCT FROM e.source),
q AS (SELECT lang, source, quantile_disc(zm, 0.25) AS m1, quantile_disc(zm, 0.75) AS m3, quantile_disc(zs, 0.25) AS s1, quantile_disc(zs, 0.75) AS s3,
        sqrt(sum(n_symbols) FILTER (n_words > 0) / sum(greatest(word_chars, 1)) FILTER (n_words > 0)) AS noise, {deciles}
      FROM r GROUP BY lang, source),
p AS (SELECT {deciles} FROM r)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(zm BETWEEN m1 - {reach} * (m3 - m1) AND m3 + {reach} * (m3 - m1), true)
         AND coalesce(zs <= s3 + {reach} * greatest(s3 - s1, noise), true) AND {clumped} AS kept
FROM r JOIN q ON q.lang IS NOT DISTINCT FROM r.lang AND q.source IS NOT DISTINCT FROM r.source CROSS JOIN p
"""


_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_OP4 = (
    """
WITH RECURSIVE w AS (SELECT doc_id, """
    + _WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
)
_OP12 = _OP4.replace("85 *", "90 *").replace(", coalesce(c.c, w.doc_id) = w.doc_id AS kept", "")
_OP7 = (
    "WITH w AS (SELECT doc_id, "
    + _WORDS.format(t="coalesce(text, '')")
    + """ AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM w WHERE len(ws) > 12)),
hit AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(13) r(j)),
k AS (SELECT d.doc_id, d.i, d.word FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w) d ANTI JOIN gone USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
)


#: crc32 bit by bit (numbers from 0 up are bytes that enter, -1 is a step); 3988292384 is its fixed polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(i) + 1), lambda k: [ord(i[k]), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
# Equal words q apart, in stretches: one of m places is a run of m + q words; a run inside one of smaller period goes.
_OP13 = (
    "WITH w AS (SELECT doc_id, doc_id::VARCHAR AS i, "
    + _WORDS.format(t="coalesce(text, '')")
    + " AS ws FROM documents), h AS (SELECT doc_id, ws, len(ws) AS n, "
    + _CRC
    + """ AS h FROM w),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM h),
t AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM a),
x AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM t),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e)
      GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
        arg_max({'s': start, 'l': length, 'q': q}, {'l': length, 's': -start, 'q': -q}) AS top FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""
)


def _op9() -> str:
    from cadenza.llm.quality_rules import CLUMPED, METRICS, REACH

    rates = ", ".join(f"CASE WHEN n_words > 0 THEN {e} END AS {k}" for k, e in METRICS.items())
    deciles = ", ".join(f"quantile_disc({k}, {p}) FILTER ({k} > 0) AS {k}_{i}" for k in CLUMPED for i, p in ((1, 0.1), (9, 0.9)))
    inside = " AND ".join(f"coalesce({k} <= q.{k}_9 + {REACH} * greatest(q.{k}_9 - q.{k}_1, p.{k}_9 - p.{k}_1), true)" for k in CLUMPED)
    return _OP9.replace("{rates}", rates).replace("{deciles}", deciles).replace("{reach}", str(REACH)).replace("{clumped}", inside)


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": _OP4, "op5_exact_dedup": _OP5, "op7_substring_dedup": _OP7, "op9_quality_rules": _op9(), "op12_ngram_join": _OP12, "op13_periodic_runs": _OP13}
