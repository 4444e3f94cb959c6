"""Language identification by a linear-chain conditional random field over words.

Emission scores come from hashed affix, character n-gram and whole-word (lexicon) features; transitions between labels
are learned with them by maximum likelihood on code-switched sequences, which are spliced from spans of single-language
training texts. The fit uses at most SAMPLE training rows, those of least id hash, and of their spans at most about
twice SEQUENCES, none a second time before all of its language were used. A text's words are labelled by
forward-backward, run for all texts of a batch at once in blocks of BLOCK words: block products of transfer matrices
give the messages that enter each block, so the whole text is one chain.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect
from collections.abc import Iterator
from itertools import chain
from operator import add
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import alone, sliced

SAMPLE, SEQUENCES, BUCKETS, BLOCK = 4_000, 3_000, 1 << 15, 32
SPAN, EPOCHS, RATE, DECAY = 24, 5, 0.5, 1e-5
_CACHE_ROWS, _CACHE_GRAMS = 400_000, 100_000
#: Texts of so many characters (or one text) are labelled together.
CHARS = 1 << 19
#: Numbers that are neither letters nor decimal digits, such as fractions, superscripts and Roman numerals.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
#: A word is a run of letters (Unicode category L); longer runs, as in scripts without spaces, are consecutive words.
LONGEST = 24
_LETTERS = re.compile(rf"[^\W\d_{_NUMBERS}]{{1,{LONGEST}}}")
#: That class of categories and hundreds of ranges is slow. Numbers of the basic plane, which are one look at a table for
#: each character, become a digit first, and it is only used where there are others.
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
_BASIC = re.compile("[" + "".join(c for c in _NUMBERS if c <= "\uffff") + "]")
_BEYOND, _OTHER = re.compile("[\U00010000-\U0010ffff]"), frozenset(c for c in _NUMBERS if c > "\uffff")


def words_of(text: str) -> list[str]:
    """_LETTERS.findall(text)."""
    if not text.isascii():
        text = _BASIC.sub("0", text)
        if not _OTHER.isdisjoint(_BEYOND.findall(text)):
            return _LETTERS.findall(text)
    return _WORD.findall(text)


class _Grams(dict):
    """name of an affix or n-gram -> bucket, emptied when full."""

    def __missing__(self, name: str) -> int:
        if len(self) >= _CACHE_GRAMS:
            self.clear()
        at = self[name] = crc32(name.encode("utf-8", "replace")) % BUCKETS
        return at


_bucket_of = _Grams()


def word_features(word: str) -> list[int]:
    """Buckets of the word's affixes, n-grams and identity."""
    w = word.lower()
    e, whole = f"^{w}$", "=" + w
    names = {whole, "<" + w[:1], "<" + w[:2], "<" + w[:3], ">" + w[-1:], ">" + w[-2:], ">" + w[-3:], *e}
    names.update(map(add, e, e[1:]))
    names.update([e[i : i + 3] for i in range(len(e) - 2)])
    names.discard(whole)  # the identity comes too seldom to be kept
    ordered = sorted(names)
    at = bisect(ordered, whole)
    out = list(map(_bucket_of.__getitem__, ordered))
    out.insert(at, crc32(whole.encode("utf-8", "replace")) % BUCKETS)
    return out


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded sequences (n, t, k): label posteriors, summed pair posteriors (k, k), log likelihood normalisers."""
    n, t, k = emission.shape
    a, b = np.zeros((n, t, k)), np.zeros((n, t, k))
    a[:, 0] = start + emission[:, 0]
    for i in range(1, t):
        s = a[:, i - 1, :, None] + transition
        m = s.max(1)
        a[:, i] = m + np.log(np.exp(s - m[:, None]).sum(1)) + emission[:, i]
    for i in range(t - 2, -1, -1):
        s = transition + (emission[:, i + 1] + b[:, i + 1])[:, None, :]
        m = s.max(2)
        b[:, i] = np.where((i + 1 < length)[:, None], m + np.log(np.exp(s - m[..., None]).sum(2)), 0)
    last = a[np.arange(n), length - 1]
    z = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
    post = np.exp(np.where((np.arange(t) < length[:, None])[..., None], a + b - z[:, None, None], -np.inf))
    pairs = np.zeros((k, k))
    for i in range(1, t):
        on = i < length
        if on.any():
            pairs += np.exp(a[on, i - 1, :, None] + transition + (emission[on, i] + b[on, i])[:, None, :] - z[on, None, None]).sum(0)
    return post, pairs, z


class Tagger:
    """labels, feature weights (BUCKETS, k), transitions and start scores."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.transition, self.start = labels, weights.astype(np.float32), transition, start

    def emissions(self, words: list[str]) -> np.ndarray:
        feats = [word_features(w) for w in words]
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter(chain.from_iterable(feats), np.int64, int(size.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)


def train(texts: list[str], langs: list[str], seed: int = 7, most: int = SEQUENCES) -> Tagger:
    """Texts of one language each. At most `most` sequences splice spans of different texts, so that labels switch
    inside; spans are drawn in random order, each once before any comes again."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    k, number = len(labels), {x: i for i, x in enumerate(labels)}
    if k < 2:
        return Tagger(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    by: list[list[list[str]]] = [[] for _ in labels]
    for t, x in zip(texts, langs, strict=True):
        words = words_of(t)
        by[number[x]] += [words[i : i + SPAN] for i in range(0, len(words), SPAN)]
    vocabulary: dict[str, int] = {}
    sequences = []
    for spans in by:
        rng.shuffle(spans)
    turn = [0] * k
    for _ in range(max(400, min(most, sum(map(len, by))))):
        words, ys = [], []
        for y in rng.integers(0, k, rng.integers(1, 4)):
            if by[y]:
                span = by[y][turn[y] % len(by[y])]
                turn[y] += 1
                words += [vocabulary.setdefault(w.lower(), len(vocabulary)) for w in span]
                ys += [int(y)] * len(span)
        if words:
            sequences.append((words, ys))
    feats = [word_features(w) for w in vocabulary]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.array(list(chain.from_iterable(feats)), np.int64)
    w, trans, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    sw, st, ss = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    size = 250
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), size):
            part = [sequences[i] for i in order[lo : lo + size]]
            length = np.array([len(x) for x, _ in part])
            ids, ys = np.zeros((len(part), length.max()), np.int64), np.zeros((len(part), length.max()), np.int64)
            for i, (x, y) in enumerate(part):
                ids[i, : len(x)], ys[i, : len(x)] = x, y
            scores = np.zeros((len(feats), k))
            for c in range(k):
                scores[:, c] = np.bincount(owner, w[flat, c], len(feats))
            post, pairs, _z = forward_backward(scores[ids], trans, start, length)
            on = np.arange(length.max()) < length[:, None]
            truth = np.eye(k)[ys] * on[..., None]
            diff = (truth - post)[on]
            per_word = np.stack([np.bincount(ids[on], diff[:, c], len(feats)) for c in range(k)], 1)
            gw = np.stack([np.bincount(flat, per_word[owner, c], BUCKETS) for c in range(k)], 1) / len(part) - DECAY * w
            seen = np.zeros((k, k))
            np.add.at(seen, (ys[:, :-1][on[:, 1:]], ys[:, 1:][on[:, 1:]]), 1)
            gt, gs = (seen - pairs) / len(part), (truth[:, 0] - post[:, 0]).mean(0)
            for value, square, g in ((w, sw, gw), (trans, st, gt), (start, ss, gs)):  # Adagrad
                square += g * g
                value += RATE * g / np.sqrt(square)
    return Tagger(labels, w, trans, start)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def posteriors(scores: np.ndarray, owner: np.ndarray, tagger: Tagger) -> np.ndarray:
    """Label posteriors of every word of many texts; scores (words, k) in order, owner: the words' texts, ascending.

    Exact forward-backward in probabilities, scaled per block. Texts are laid out in blocks of BLOCK words.
    """
    n, k = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True))
    tr = np.exp(tagger.transition - tagger.transition.max())
    length = np.bincount(owner)
    length = length[length > 0]
    text_at = np.cumsum(length) - length
    blocks = -(-length // BLOCK)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(n) - np.repeat(text_at, length)
    row, col = np.repeat(first, length) + inside // BLOCK, inside % BLOCK
    x = np.ones((blocks.sum(), BLOCK, k))  # what lies beyond a text's end is flat and is never read
    x[row, col] = e
    on = np.zeros((len(x), BLOCK), bool)
    on[row, col] = True
    head = np.zeros(len(x), bool)
    head[first] = True
    step = tr[None] * np.ones((len(x), 1, 1))
    # Transfer matrix of each block: message before its first word (after transition) to message after its last.
    m = np.where(head[:, None, None], np.eye(k), step) * x[:, 0][:, None, :]
    m /= m.sum((1, 2), keepdims=True)
    for i in range(1, BLOCK):
        new = (m.reshape(-1, k) @ tr).reshape(m.shape) * x[:, i][:, None, :]
        new /= new.sum((1, 2), keepdims=True)
        m = np.where(on[:, i][:, None, None], new, m)
    enter, leave = np.ones((len(x), k)), np.ones((len(x), k))
    begin = np.exp(tagger.start - tagger.start.max())
    state, back = np.tile(begin, (len(length), 1)), np.ones((len(length), k))
    for j in range(int(blocks.max(initial=0))):  # texts side by side, block after block
        on_ = np.flatnonzero(blocks > j)
        at = first[on_] + j
        enter[at] = state[on_]
        s = np.einsum("nk,nkl->nl", state[on_], m[at])
        state[on_] = s / s.sum(1, keepdims=True)
        at = first[on_] + blocks[on_] - 1 - j
        leave[at] = back[on_]
        s = np.einsum("nkl,nl->nk", m[at], back[on_])
        back[on_] = s / s.sum(1, keepdims=True)
    a = np.empty_like(x)
    f = np.where(head[:, None], enter, enter @ tr) * x[:, 0]
    a[:, 0] = f / f.sum(1, keepdims=True)
    for i in range(1, BLOCK):
        f = (a[:, i - 1] @ tr) * x[:, i]
        a[:, i] = f / f.sum(1, keepdims=True)
    b = leave
    out = np.empty_like(x)
    for i in range(BLOCK - 1, -1, -1):
        p = a[:, i] * b
        out[:, i] = p / p.sum(1, keepdims=True)
        new = (b * x[:, i]) @ tr.T
        b = np.where(on[:, i][:, None], new / new.sum(1, keepdims=True), b)
    return out[row, col]


class _Rows(dict):
    """word -> row of its emission scores in table."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger, self.table, self.new = tagger, np.zeros((1024, len(tagger.labels)), np.float32), []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def scored(self) -> np.ndarray:
        """The table, with the words that came since the last time."""
        while len(self) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.new:
            self.table[len(self) - len(self.new) : len(self)] = self.tagger.emissions(self.new)
            self.new = []
        return self.table


_state: dict = {}


def _labelled(model, words_out: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alone("language_id", _state.clear, _bucket_of.clear)
        tagger = model.value
        if _state.get("tagger") is not tagger:
            _state.update(tagger=tagger, rows=_Rows(tagger))
        labels = np.array([*tagger.labels, "und"], dtype=object)
        k = len(tagger.labels)
        for b in batches:
            for part in sliced([b], CHARS, 400):
                rows = _state["rows"]
                if len(rows) > _CACHE_ROWS:
                    rows = _state["rows"] = _Rows(tagger)
                found = [[] if t is None else words_of(t.lower()) for t in part["text"]]
                ids = np.fromiter(map(rows.__getitem__, chain.from_iterable(found)), np.int64)
                owner = np.repeat(np.arange(len(part)), [len(ws) for ws in found])
                mean = np.zeros((len(part), k))
                post = posteriors(rows.scored()[ids].astype(float), owner, tagger) if len(ids) and k else np.zeros((0, k))
                for c in range(k):
                    mean[:, c] = np.bincount(owner, post[:, c], len(part))
                n = np.bincount(owner, minlength=len(part))
                best = np.where((n > 0) & (k > 0), mean.argmax(1) if k else 0, k)
                score = np.where(n > 0, mean.max(1, initial=0) / np.maximum(n, 1), 0)
                out = {"doc_id": part["doc_id"], "lang_pred": labels[best], "score": np.clip(score, 0, 1)}
                if "text_hash" in part:
                    out["text_hash"] = part["text_hash"]
                if words_out:
                    word = labels[:k][post.argmax(1)] if len(post) else np.empty(0, object)
                    ends = np.cumsum(n)
                    out["words"] = found
                    out["langs"] = [word[e - c : e].tolist() for e, c in zip(ends, n, strict=True)]
                yield pd.DataFrame(out)

    return run


def fit(docs: DataFrame, held_out: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sequences: int = SEQUENCES) -> Tagger:
    """Learns from at most sample rows, an equal share for each language, where held_out (on doc_id) does not hold.

    The table is read twice: once for the counts, once for the rows under a threshold of the hash for each language
    that leaves about twice the share, which are then ordered.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Tagger([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    share, scale = max(1, sample // len(counts)), 1 << 40
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * share / n) * scale))])
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(scale))).where(F.col("at") < limit[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text"))
    got = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share).select("doc_id", "lang", "text").toPandas()
    got = got.sort_values(["doc_id", "lang", "text"], kind="stable")
    return train(got["text"].tolist(), got["lang"].tolist(), most=sequences)


def language_id(docs: DataFrame, held_out: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: bool = False, text_hash: bool = False, sequences: int = SEQUENCES) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (and words, langs: the label of every word; and
    text_hash, xxhash64 of the text).

    held_out: a condition on doc_id; other rows' text and lang are learned, from at most sample rows and sequences
    training sequences. lang_pred is the label of the greatest mean posterior over the text's words (runs of letters,
    in pieces of LONGEST) and score is that mean; a null text or one without letters is und with score 0, as is every
    text when nothing could be learned. Rows that repeat an id are labelled each; an empty table gives no rows; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, held_out, sample, id_col, text_col, lang_col, sequences))
    more = ["text_hash"] if text_hash else []
    schema = "doc_id long, " + "text_hash long, " * text_hash + "lang_pred string, score double" + (", words array<string>, langs array<string>" if words else "")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).select("doc_id", "text", *([F.xxhash64("text").alias("text_hash")] if text_hash else []))
    found = texts.mapInPandas(_labelled(model, words), schema)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", *(["words", "langs"] if words else []), *more)
