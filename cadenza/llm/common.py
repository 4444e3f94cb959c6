"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular-expression class and as the plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where none is set, a local master gets a new one; a
    cluster gets an error, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lost executors do not make it run again.

    batch_bytes: while df is written, Arrow batches take no more rows once they hold so many bytes. An executor holds
    such a batch outside its heap, and its Python worker as Arrow and as objects."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if batch_bytes is None:
        df.write.parquet(path)
    else:
        before = spark.conf.get(_BATCH_BYTES)
        spark.conf.set(_BATCH_BYTES, batch_bytes)
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_BATCH_BYTES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of tables from cut, once nothing reads them any more."""
    for f in frames:
        jvm = f.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(f._cut_path)
        path.getFileSystem(f.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_kept: dict = {}


def alone(owner: str, *clear: Callable[[], None]) -> None:
    """What a worker process keeps from batch to batch belongs to one operator (owner) at a time: when another's work
    comes to it, what it kept is let go first. clear: the functions that let go of the owner's."""
    if _kept.get("owner") == owner:
        return
    for f in _kept.get("clear", ()):
        f()
    _kept.update(owner=owner, clear=clear)
    pa.default_memory_pool().release_unused()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names, whatever else docs carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def crc_of_id(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pd.DataFrame], chars: int, rows: int = 1 << 30) -> Iterator[pd.DataFrame]:
    """Arrow batches as frames of at most so many characters of text (or one text) and so many rows."""
    for b in batches:
        lo = total = 0
        for i, n in enumerate(b["text"].str.len().fillna(0).astype("int64").tolist()):
            if i > lo and (total + n > chars or i - lo >= rows):
                yield b.iloc[lo:i]
                lo, total = i, 0
            total += n
        if lo < len(b):
            yield b.iloc[lo:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts(spark: SparkSession) -> int:
    """Over so many salts a group's rows are dealt: with one for each partition, a group that holds much of a table
    leaves each salt no more rows than a partition has."""
    return max(8, partitions(spark))


def salted_min(df: DataFrame, keys: list[str], value: str, out: str, by: str) -> DataFrame:
    """df with the least value of its group as column out (nulls in keys form no group and lose the row).

    Each (group, salt) is summarised map-side first, at most one row of a group and salt ever meet, and the join back
    runs per salt: a group that holds a third of the table is spread like any other rows. by: the column that salts.
    """
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts(df.sparkSession))).cast("int"))
    least = rows.groupBy(*keys, "_salt").agg(F.min(value).alias(out))
    group = Window.partitionBy(*keys)
    least = least.withColumn(out, F.min(out).over(group))
    return rows.join(least, [*keys, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the undirected links (a, b), for every node in a link.

    Alternating large-star and small-star rounds, until every node hangs on one root that hangs on nothing; each round
    is one min per node and a salted join for either star, and is written to the shared folder. Nothing is gathered.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _tangled(edges).isEmpty():
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        # Large star: each neighbour above u is tied to the least of u and its neighbours.
        m = salted_min(both.withColumn("w", F.least("u", "v")), ["u"], "w", "m", "v")
        large = m.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its neighbours below are tied to the least of them.
        m = salted_min(large, ["u"], "v", "m", "v")
        small = m.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, cut(small)
        drop(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _tangled(edges: DataFrame) -> DataFrame:
    """Nodes of the edges (u, v), v < u, that hang on several nodes, or on one while others hang on them."""
    end = lambda node, up, down: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    ends = edges.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")


def sample_of(rows: DataFrame, size: int, by: str) -> DataFrame:
    """At most size rows, those of least hash of by. A hash threshold leaves about twice as many before they are
    ordered, so that partitions do not each send size rows."""
    n = rows.count()
    share = min(1.0, 2 * size / max(1, n))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < int(share * (1 << 40)))
    return rows.orderBy(F.pmod(F.xxhash64(by), F.lit(1 << 40)), by).limit(size)
