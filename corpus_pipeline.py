"""The corpus pipeline: language ID, exact dedup, near dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import crc_of_id, cut, drop
from cadenza.llm.exact_dedup import exact_dedup
from cadenza.llm.language_id import language_id
from cadenza.llm.near_dedup import BATCH_BYTES, near_dedup
from cadenza.llm.packing import best_fit_packing
from cadenza.llm.queries import _tokenizer
from cadenza.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a lower mean posterior is rejected, as is one without letters.
LEAST_SCORE = 0.3


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """docs whose id and text are in keep (doc_id and text_hash; null matches null); rows that repeat both are returned
    once."""
    kept = keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without letters and those whose language is unsure. Each row goes by its own text, also
    where ids repeat or are null; rows that repeat id and text leave one. An empty table stays empty."""
    found = cut(language_id(docs, F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1, text_hash=True), BATCH_BYTES)
    return _only(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then of least id (null last). A copy goes also where
    its id was kept for another text, and null texts are equal to empty ones. An empty table stays empty."""
    return _only(docs, exact_dedup(docs, text_hash=True).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, 0.8) stays, that of least id (null last; among rows of
    one id any one). Texts without words are no copies. An empty table stays empty."""
    return _only(docs, near_dedup(docs, width=5, threshold=0.8, text_hash=True).where("stays"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without its repeated strings of 200 bytes; n_chars follows. Null text becomes empty; ids may
    repeat or be null. An empty table stays empty."""
    new = suffix_dedup(docs, width=200, texts=True, keep=("lang", "source"))
    return new.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row; a null or empty text is one piece of the end id. An empty table stays empty."""
    return best_fit_packing(docs, _tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]
#: Language ID and packing can not be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
