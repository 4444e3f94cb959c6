"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words that toxic training documents have more often is learned with counts that Spark makes; the trees and
the calibration are fitted on a sample of at most SAMPLE labelled rows (those of least id hash). All documents are
scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import cut, sample_of

#: Bound on the labelled rows that the model is fitted on, and on the lexicon.
SAMPLE, LEXICON = 20_000, 256
TREES, DEPTH, RATE, BINS, LEAF = 60, 4, 0.2, 32, 20
#: Second-person words of the languages at hand.
SECOND = {w.encode() for w in "you your yours u ur yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()}
#: Signs that stand for letters.
LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
NAMES = ["hits", "density", "weight", "top", "kinds", "near_you", "you", "capitals", "shouted", "bang", "punct", "disguised", "disguised_hits", "log_words"]
_EDGE = b".,;:!?'\"()[]{}<>*#$%&|~-_"
_CACHE_ROWS = 300_000


def plain(word: bytes) -> tuple[bytes, bool]:
    """A lower-cased word without outer punctuation, its disguise undone; and whether it had one."""
    core = word.strip(_EDGE)
    if core.isalpha() or not core:
        return core, False
    inner = core.translate(LEET)
    letters = bytes(c for c in inner if 97 <= c <= 122 or c >= 128)
    disguised = any(97 <= c <= 122 for c in core) and any(c < 97 and c != 45 and c != 39 or 122 < c < 128 for c in core)
    return (letters if disguised else core), disguised


class _Codes(dict):
    """word -> code: 1 + place in the lexicon, 0 none; + 1000 for second person; + 2000 for a disguise."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.place = {w: i + 1 for i, w in enumerate(lexicon)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ROWS:
            self.clear()
        core, disguised = plain(word)
        self[word] = c = self.place.get(core, 0) + 1000 * (core in SECOND) + 2000 * disguised
        return c


def features(text: str | None, codes: _Codes, weights: np.ndarray) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    c = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    lex, you, masked = c % 1000, (c // 1000) % 2 == 1, c >= 2000
    at = np.flatnonzero(lex)
    near = 0.0
    if len(at) and you.any():
        p = np.flatnonzero(you)
        k = np.clip(np.searchsorted(p, at), 1, len(p)) - 1
        gap = np.minimum(np.abs(at - p[k]), np.abs(at - p[np.minimum(k + 1, len(p) - 1)]))
        near = float((1 / (1 + gap)).sum())
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = b[97:123].sum() + b[65:91].sum()
    w = weights[lex[at] - 1]
    return np.array([
        len(at), len(at) / n, w.sum(), w.max(initial=0), len(np.unique(lex[at])), near, you.sum() / n, b[65:91].sum() / max(1, letters),
        sum(map(bytes.isupper, raw.split())) / n, b[33] / n, (b[33:48].sum() + b[58:65].sum()) / n, masked.sum() / n, (masked & (lex > 0)).sum(), np.log1p(n),
    ])


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()
    for b in batches:
        for t, y in zip(b["text"], b["label"], strict=True):
            (toxic if y else other).update({plain(w)[0] for w in set((t or "").encode("utf-8", "replace").lower().split())})
    words = [w for w in toxic.keys() | other.keys() if w]
    yield pd.DataFrame({"word": words, "toxic": [toxic[w] for w in words], "other": [other[w] for w in words]})


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """word -> log odds of standing in a toxic document, for words that clearly do."""
    n1 = sample.where("label = 1").count()
    n0 = sample.count() - n1
    if not n1 or not n0:
        return {}
    counts = sample.mapInPandas(_word_counts, "word binary, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n0 + 1.0))
    least = max(3, n1 // 200)
    found = counts.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") > 2.0)).orderBy(F.desc(F.col("odds") * F.col("toxic")), "word").limit(LEXICON).collect()
    return {bytes(r["word"]): float(r["odds"]) for r in found}


class Trees:
    """Histogram gradient boosting with the logistic loss. Complete binary trees as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut_, value = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1), np.zeros(2 ** (DEPTH + 1) - 1)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * LEAF:
                        continue
                    best = self._split(b[rows], g[rows], h[rows])
                    if best:
                        j, c = best
                        feature[k], cut_[k] = j, self.edges[j][c]
                        node[rows] = 2 * k + 1 + (b[rows, j] > c)
            for k in np.unique(node):
                rows = node == k
                value[k] = RATE * g[rows].sum() / (h[rows].sum() + 1.0)
            f += value[node]
            self.trees.append((feature, cut_, value))

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        best, found = 1e-3, None
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j, e in enumerate(self.edges):
            if not len(e):
                continue
            n, sg, sh = (np.cumsum(np.bincount(b[:, j], w, len(e) + 1))[:-1] for w in (None, g, h))
            gain = sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - whole
            gain[(n < LEAF) | (len(b) - n < LEAF)] = 0
            c = int(gain.argmax())
            if gain[c] > best:
                best, found = gain[c], (j, c)
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut_, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = np.minimum(node, len(feature) - 1)
                j = feature[inner]
                go = (node < len(feature)) & (j >= 0)
                right = x[np.arange(len(x)), np.maximum(j, 0)] >= cut_[inner]
                node = np.where(go, 2 * node + 1 + right, node)
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    sums, sizes = np.add.reduceat(y[order].astype(float), first), np.diff(np.r_[first, len(x)]).astype(float)
    blocks: list[list[float]] = []
    for lo, s, n in zip(xs, sums, sizes, strict=True):
        blocks.append([lo, lo, s, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, hi, s2, n2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += s2
            blocks[-1][3] += n2
    return np.array([v for b in blocks for v in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


class ToxicityModel:
    def __init__(self, lexicon: dict[bytes, float], x: np.ndarray, y: np.ndarray, part: np.ndarray):
        """part: which rows calibrate; the others grow the trees."""
        self.lexicon, self.weights = lexicon, np.array([*lexicon.values(), 0.0])
        self.constant = None if len(y) >= 50 and 0 < y.mean() < 1 else float(y.mean()) if len(y) else 0.5
        if self.constant is None:
            if not 0 < y[~part].mean() < 1 or not 0 < y[part].mean() < 1:
                part = np.zeros(len(y), bool)
            self.trees = Trees(x[~part], y[~part])
            fit = part if part.any() else ~part
            self.knots = isotonic(self.trees.margin(x[fit]), y[fit])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        # The margin breaks ties inside a step, so that the order is kept.
        return np.clip(0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m)), 0, 1)


def _rows(lexicon: dict[bytes, float]):
    weights = np.array([*lexicon.values(), 0.0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes(lexicon)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "part": b["part"], "x": [features(t, codes, weights) for t in b["text"]]})

    return run


def fit(sample: DataFrame) -> ToxicityModel:
    """sample: doc_id, text, label; bounded by the caller. A quarter of the ids, by hash, only calibrates: neither the
    lexicon nor the trees see it."""
    sample = sample.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3)
    lexicon = learn_lexicon(sample.where(~F.col("part")))
    rows = sample.mapInPandas(_rows(lexicon), "doc_id long, label int, part boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(NAMES)))
    return ToxicityModel(lexicon, x, rows["label"].to_numpy(float), rows["part"].to_numpy(bool))


def _scored(model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        codes = _Codes(m.lexicon)
        for b in batches:
            if len(b):
                s = m.score(np.stack([features(t, codes, m.weights) for t in b["text"]]))
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    held_out: a condition on doc_id; labels of at most sample other rows are learned. Null and empty texts are scored
    from zero features. Rows that repeat an id are scored each; with labels of one class only the score is constant;
    an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where(~held_out & F.col("label").isNotNull())
    known = sample_of(known, sample, "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(cut(texts.join(known, "doc_id"))))
    scored = texts.mapInPandas(_scored(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
