"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent words (counted by Spark over all texts) are compiled into an acyclic automaton whose equal suffixes are
shared; the numbers on its arcs add up to a word's place in a table of id sequences. The arrays are broadcast, written
to an unlinked scratch file by each worker and memory-mapped. Words that the lexicon lacks are merged exactly, many at
a time: in every round each word merges its leftmost pair of least rank.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import mmap
import os
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import alone, cut, id_and_text

#: Words in the lexicon (the most frequent ones), and the longest in bytes.
LEXICON, LONGEST = 32_768, 32
#: The published splitting pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
_SPLIT = regex.compile(PATTERN)
_BREAK = regex.compile(r" (?=\s|$)")
_CACHE_ROWS = 600_000
#: Words of more bytes are merged one by one, from a heap of pairs.
_LONG = 512
_state: dict = {}


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks by pair of ids, and the bytes of each id, from a tokenizers file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        of, vocab = _byte_of_char(), d["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in d["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in d["added_tokens"] if t["special"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.first = np.array([vocab[next(c for c, b in of.items() if b == x)] for x in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of: dict[int, int] = {}
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], len(self.merged))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes, by exact merging."""
        out: list[bytes] = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > _LONG:
                out[i] = self._merge_long(w)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= _LONG), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            hi = lo
            while hi < len(order) and (hi == lo or len(words[order[hi]]) <= 2 + len(words[order[lo]]) * 5 // 4) and hi - lo < 20_000:
                hi += 1
            for i, ids in zip(order[lo:hi], self._merge([words[i] for i in order[lo:hi]]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """One word, n log n: the heap gives the leftmost pair of least rank; parts are linked both ways."""
        self.rank_of = self.rank_of or dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        first = self.first[np.frombuffer(word, np.uint8)]
        end, none = len(first), len(self.merged)
        ids, before, after = first.tolist(), list(range(-1, end - 1)), list(range(1, end + 1))
        rank = [*self.rank(first[:-1], first[1:]).tolist(), none]
        heap = [r << 32 | i for i, r in enumerate(rank) if r < none]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank[i] != r:  # one of its parts has been merged since
                continue
            gone = after[i]
            ids[i], rank[gone], ids[gone] = int(self.merged[r]), none, -1
            after[i] = after[gone]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = after[a]
                    rank[a] = self.rank_of.get(ids[a] << 20 | ids[b], none) if b < end else none
                    if rank[a] < none:
                        heapq.heappush(heap, rank[a] << 32 | a)
        left = np.array(ids, np.int64)
        return left[left >= 0].astype("<u4").tobytes()

    def _merge(self, words: list[bytes]) -> list[bytes]:
        n, width, none = len(words), max(map(len, words)), len(self.merged)
        x = np.full((n, width + 1), -1, np.int64)
        for i, w in enumerate(words):
            x[i, : len(w)] = self.first[np.frombuffer(w, np.uint8)]
        r = self.rank(x[:, :-1], x[:, 1:])
        final: list[bytes] = [b""] * n
        rows = np.arange(n)
        while len(rows):
            at = r.argmin(1)
            best = r[np.arange(len(rows)), at]
            done = best == none
            for i in np.flatnonzero(done):
                ids = x[i]
                final[rows[i]] = ids[ids >= 0].astype("<u4").tobytes()
            live = ~done
            rows, x, r, at, best = rows[live], x[live], r[live], at[live], best[live]
            if not len(rows):
                break
            k = np.arange(len(rows))
            x[k, at] = self.merged[best]
            shift = np.arange(x.shape[1])[None, :] > at[:, None]
            x = np.where(shift, np.c_[x[:, 1:], np.full(len(rows), -1)], x)
            shift = np.arange(r.shape[1])[None, :] > at[:, None]
            r = np.where(shift, np.c_[r[:, 1:], np.full(len(rows), none)], r)
            r[k, at] = self.rank(x[k, at], x[k, at + 1])
            before = at > 0
            r[k[before], at[before] - 1] = self.rank(x[k[before], at[before] - 1], x[k[before], at[before]])
        return final


def compile_lexicon(words: dict[bytes, bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words (incremental construction from sorted words) and their id sequences.

    Arc outputs number the words in sorted order: the outputs along a word's path add up to its number.
    """
    names = sorted(words)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]

    def freeze(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            arcs[path[-1]][word[len(path) - 1]] = register.setdefault(key, child)

    last = b""
    for w in names:
        shared = len(os.path.commonprefix([last, w]))
        freeze(shared, last)
        for c in w[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = w
    freeze(0, last)
    below: dict[int, int] = {}

    def count(s: int) -> int:  # words below a state; depth is bounded by LONGEST
        if s not in below:
            below[s] = final[s] + sum(count(t) for t in arcs[s].values())
        return below[s]

    count(0)
    number = {s: i for i, s in enumerate(below)}
    rows = []
    for s in below:
        out = int(final[s])
        for c, t in sorted(arcs[s].items()):
            rows.append((number[s] << 8 | c, number[t], out))
            out += below[t]
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    ids = [words[w] for w in names]
    ends = np.cumsum([0, *map(len, ids)])
    return {
        "arc": a[:, 0].copy(), "target": a[:, 1].copy(), "output": a[:, 2].copy(),
        "final": np.array([final[s] for s in below], np.bool_), "root": np.array([number[0]]),
        "ids": np.frombuffer(b"".join(ids), np.uint8), "ends": ends,
    }


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    for k, v in arrays.items():
        out.write(f"{k} {v.dtype.str} {len(v)}\n".encode().ljust(64))
        out.write(v.tobytes())
        out.write(b"\0" * (-out.tell() % 64))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, memory-mapped from a scratch file that has no name any more."""

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, self.a = 0, {}
        while at < len(self.map):
            name, kind, n = self.map[at : at + 64].split()
            dtype = np.dtype(kind.decode())
            self.a[name.decode()] = np.frombuffer(self.map, dtype, int(n), at + 64)
            at += 64 + dtype.itemsize * int(n)
            at += -at % 64

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where the automaton rejects it; all words step together."""
        a = self.a
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(n) - n
        state, total = np.full(len(words), a["root"][0]), np.zeros(len(words), np.int64)
        live = np.flatnonzero((n <= LONGEST) & (n > 0))
        state[(n > LONGEST) | (n == 0)] = -1
        for depth in range(LONGEST):
            live = live[n[live] > depth]
            if not len(live) or not len(a["arc"]):
                break
            key = state[live] << 8 | flat[start[live] + depth]
            at = np.minimum(np.searchsorted(a["arc"], key), len(a["arc"]) - 1)
            ok = a["arc"][at] == key
            state[live] = np.where(ok, a["target"][at], -1)
            total[live] += a["output"][at]
            live = live[ok]
        hit = state >= 0
        hit[hit] = a["final"][state[hit]]
        return np.where(hit, total, -1) if len(a["arc"]) else np.full(len(words), -1)

    def ids(self, number: int) -> bytes:
        return self.a["ids"][self.a["ends"][number] : self.a["ends"][number + 1]].tobytes()


def chunks(text: str) -> list[str]:
    """Parts of a text (in order, together the text) between which no token of the pattern reaches: a blank before
    anything but white space always begins one."""
    parts = text.split(" ")
    if _BREAK.search(text):
        joined = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace():
                joined[-1] += " " + p
            else:
                joined.append(p)
        parts = joined
    return parts


class Codec:
    """Encodes with a cache of chunks, the lexicon and exact merges; decodes by table."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.v, self.lexicon = vocabulary, lexicon
        self.cache: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None

    def segments(self, text: str) -> list[list[str]]:
        """Chunk lists between special tokens, each special token as a list of its own. A chunk that follows another
        in its list has lost the blank before it."""
        if not self.special or not self.special.search(text):
            return [chunks(text)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out.append(chunks(text[at : m.start()]))
            out.append([m[0]])
            at = m.end()
        return out + ([chunks(text[at:])] if at < len(text) else [])

    def fill(self, wanted: set[str]) -> None:
        """wanted: chunks in full, with the blank they begin with."""
        new = wanted.difference(self.cache)
        if len(self.cache) + len(new) > _CACHE_ROWS:
            self.cache.clear()
            new = wanted
        names = list(new)
        words = [[w.encode() for w in _SPLIT.findall(c)] if c not in self.v.special else [] for c in names]
        some = list(set().union(*words))
        got: dict[bytes, bytes] = {}
        if some and self.lexicon:
            for w, k in zip(some, self.lexicon.numbers(some).tolist(), strict=True):
                if k >= 0:
                    got[w] = self.lexicon.ids(k)
        rare = [w for w in some if w not in got]
        got.update(zip(rare, self.v.merge(rare), strict=True))
        for c, ws in zip(names, words, strict=True):
            self.cache[c] = array("I", [self.v.special[c]]).tobytes() if c in self.v.special else b"".join([got[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [[[s[0], *[" " + c for c in s[1:]]] for s in self.segments(t)] for t in texts]
        self.fill(set().union(*[s for t in parts for s in t]))
        return [b"".join([b"".join(map(self.cache.__getitem__, s)) for s in t]) for t in parts]

    def decode(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, "<u4").astype(np.int64)
        n = self.v.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.v.starts[ids] - ends + n, n)
        return self.v.flat[at].tobytes().decode("utf-8", "replace")


def _codec(spec: str, lexicon: bytes | None) -> Codec:
    alone("bpe", _state.clear)
    key = hash((spec, lexicon))
    if _state.get("key") != key:
        _state.update(key=key, codec=Codec(Vocabulary(spec), Lexicon(lexicon) if lexicon else None))
    return _state["codec"]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each batch and their numbers; a word inside a line is counted with its blank."""
    for b in batches:
        seen: Counter[str] = Counter()
        for t in b["text"]:
            if t:
                head, *rest = t.split(" ")
                seen.update(rest)
        rows = [(" " + w, n) for w, n in seen.items() if n > 1 and w and len(w) <= LONGEST]
        yield pd.DataFrame(rows, columns=["chunk", "n"])


def frequent_words(texts: DataFrame, vocabulary: Vocabulary, size: int = LEXICON) -> dict[bytes, bytes]:
    """The words of the most frequent chunks of all texts, at most size chunks, with their ids. Words met once in a
    batch of rows are left out of the count, which changes which words are looked up and never an id.

    A histogram of the counts on a logarithmic scale gives the least count to take, so the driver gets no more than
    that many chunks however many partitions there are.
    """
    counts = cut(texts.select("text").mapInPandas(_counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > size:
            break
        least = r["step"]
    top = counts.where(step >= least).collect() if least is not None else []
    words = sorted({w for r in top for x in _SPLIT.findall(r["chunk"]) if len(w := x.encode()) <= LONGEST})
    return dict(zip(words, vocabulary.merge(words), strict=True)) if words else {}


def _round_trip(spec, lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value, lexicon.value)
        for b in batches:
            rows = []
            for lo in range(0, len(b), 256):
                texts = ["" if t is None else t for t in b["text"].iloc[lo : lo + 256]]
                for i, raw in zip(b["doc_id"].iloc[lo : lo + 256].array, codec.encode(texts), strict=True):
                    rows.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(raw).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(spec, lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value, lexicon.value)
        for b in batches:
            raw = codec.encode(["" if t is None else t for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]})

    return run


def _decoded(spec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value, None)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [codec.decode(np.asarray([] if x is None else x).astype("<u4").tobytes()) for x in b["ids"]]})

    return run


def _sent(texts: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    raw = pack_arrays(compile_lexicon(frequent_words(texts, Vocabulary(spec))))
    send = texts.sparkSession.sparkContext.broadcast
    return send(spec), send(raw)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>); null text is empty; special tokens in a text become their ids."""
    texts = id_and_text(docs, id_col, text_col)
    return texts.mapInPandas(_encoded(*_sent(texts, path)), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; bytes that are no UTF-8 become U+FFFD; null ids are an empty text."""
    with open(path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInPandas(_decoded(spec), "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and again decoded text.

    Null text is empty (no ids). Repeated rows give repeated rows; an empty table none; other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    return texts.mapInPandas(_round_trip(*_sent(texts, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
