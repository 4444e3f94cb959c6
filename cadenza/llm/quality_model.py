"""Quality as a regularised quadratic discriminant over transformed document statistics.

The class moments are summed by Spark over all labelled training rows; the driver shrinks each class covariance towards
the pooled one and that towards its diagonal, and factors it once. Tasks score with the cached Cholesky factors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import cut

#: Weight of the pooled covariance, and of its own diagonal in that.
POOLED, DIAGONAL = 0.2, 0.1
#: Least standard deviation of a statistic, so that a constant one does not decide alone.
FLOOR = 0.03
NAMES = ["log_words", "log_word_len", "upper", "digit", "symbol", "punct", "bang", "bar", "space", "newline", "high", "distinct", "twin", "top_word", "dup_line", "line_words"]
_SYMBOLS, _PUNCT = b"#*$%&<>@^~=+_{}[]\\/`", b".,;:?'\"()-"
_UPPER, _DIGIT = np.r_[65:91], np.r_[48:58]


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text: logs of sizes, square roots of rates. Empty texts give zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(c[[32, 9, 10, 11, 12, 13]].sum())
    chars = len(raw) - spaces
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    different = set(words)
    rates = np.array([
        c[_UPPER].sum() / chars, c[_DIGIT].sum() / chars, c[list(_SYMBOLS)].sum() / chars, c[list(_PUNCT)].sum() / chars,
        c[33] / chars, c[124] / chars, spaces / len(raw), c[10] / n, c[128:].sum() / chars, len(different) / n,
        sum(map(eq, words, words[1:])) / n, max(Counter(words).values()) / n, 1 - len(set(lines)) / max(1, len(lines)),
    ])
    return np.r_[np.log1p(n) / 4, np.log(chars / n) / 2, np.sqrt(rates), np.log1p(n / max(1, len(lines))) / 4]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]})


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics (array<double>, in the order of NAMES)."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInPandas(_features, "doc_id long, x array<double>")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, g in b.groupby("label"):
            x = np.c_[np.ones(len(g)), np.stack(g["x"].to_list())]
            total[int(k)] = total.get(int(k), 0) + x.T @ x
    for k, m in total.items():
        yield pd.DataFrame({"label": k, "at": np.arange(m.size), "value": m.ravel()})


class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log determinant and log prior."""

    def __init__(self, moments: dict[int, np.ndarray]):
        n = {k: m[0, 0] for k, m in moments.items()}
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        self.mean, self.factor, self.inverse, self.offset = mean, {}, {}, {}
        if len(cov) < 2:  # nothing to discriminate
            return
        pooled = sum(n[k] * cov[k] for k in cov) / sum(n.values())
        pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
        for k in cov:
            s = (1 - POOLED) * cov[k] + POOLED * pooled + FLOOR**2 * np.eye(len(pooled))
            self.factor[k] = np.linalg.cholesky(s)
            self.inverse[k] = np.linalg.inv(self.factor[k])
            self.offset[k] = np.log(n[k] / sum(n.values())) - np.log(np.diag(self.factor[k])).sum()

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.inverse[k] @ (x - self.mean[k]).T
        return self.offset[k] - 0.5 * (z * z).sum(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(x):
            return np.empty(0)
        if 1 not in self.mean or 0 not in self.mean:  # one class was seen, or none
            return np.full(len(x), 1.0 if 1 in self.mean else 0.0 if 0 in self.mean else 0.5)
        d = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -500, 500)
        return 1 / (1 + np.exp(-d))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """labels: doc_id, label (0/1; nulls are dropped)."""
    rows = stats.join(labels.where("label IS NOT NULL"), "doc_id").select("x", F.col("label").cast("int").alias("label"))
    cells = rows.mapInPandas(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    side = len(NAMES) + 1
    moments: dict[int, np.ndarray] = {}
    for r in cells:
        moments.setdefault(r["label"], np.zeros(side * side))[r["at"]] = r["value"]
    return Discriminant({k: v.reshape(side, side) for k, v in moments.items()})


def _scored(model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            if len(b):
                s = m.score(np.stack(b["x"].to_list()))
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    held_out: a condition on doc_id; only other rows' labels are learned. Null and empty texts get a score too, of the
    zero statistics. Rows that repeat an id are scored each; an empty table gives no rows; other columns are ignored.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].alias("label")).where(~held_out)
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, known))
    scored = stats.mapInPandas(_scored(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
