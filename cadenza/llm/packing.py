"""Packing of tokenised documents into fixed-length sequences by linear grouping.

Spark tokenises once and counts pieces per (length, salt): one number for a length or for RANKED pieces at most. On
these the driver plans: large lengths, in descending order, are cut into groups of equal cardinality and rounded up to
their group's largest; configurations of the few rounded sizes are optimised by exact subset sums; the actual pieces
take the rounded places; small lengths go best-fit into what is left. The plan is a table of rank intervals of bounded
size. Spark then ranks the pieces of each (length, salt) and looks up their places; no document reaches the driver.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.bpe import _byte_of_char
from cadenza.llm.common import alone, cut, id_and_text

#: Groups of large lengths. More groups waste less by rounding; the plan's work grows with them, not with the input.
GROUPS = 2048
#: Lengths of at least CAPACITY / LARGE count as large.
LARGE = 8
_CACHE_ROWS = 700_000
#: ASCII marks that end a word, and the letters (below U+0250, of one lower-case letter each) that a tokenizer may join to one piece.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
_CHAR_OF_BYTE = {b: c for c, b in _byte_of_char().items()}
_state: dict = {}


class _Words:
    """Encodes words as the tokenizer does, with less work for common kinds of them.

    Marks after a letter or digit are a piece of their own, so a word's ids are those of what stands before its last
    marks and those of the marks. Words of plain letters are one piece, which goes to the model in lower case without
    the search for pieces; whether the tokenizer does so with these letters is tried first.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.piece_of = {ord(c): "".join(_CHAR_OF_BYTE[b] for b in c.lower().encode()) for c in _LETTERS}
        text = tokenizer.normalizer.normalize_str(_LETTERS) if tokenizer.normalizer else ""
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(f"{text}.,7;") if tokenizer.pre_tokenizer else []
        tried = [p for p, _ in pieces] == [_LETTERS.translate(self.piece_of), ".,", "7", ";"]
        self.letters = set(_LETTERS) if tried else set()
        self.ends = self.letters | set("0123456789") if tried else set()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as bytes."""
        got: dict[str, bytes] = {}
        parts, rest = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            core = text.rstrip(_MARKS)
            split = len(core) < len(text) and core and core[-1] in self.ends and "<|" not in text
            part = (core, text[len(core) :]) if split else (text,)
            parts.append(part)
            for x in part:
                if x not in got:
                    if self.letters.issuperset(x):
                        got[x] = array("I", [t.id for t in self.model.tokenize(x.translate(self.piece_of))]).tobytes()
                    else:
                        got[x] = b""
                        rest.append(x)
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                got[x] = array("I", e.ids).tobytes()
        return [b"".join([got[x] for x in p]) for p in parts]


class _Ids(dict):
    """word -> its ids as bytes. When full, only words that more than one block of texts had stay."""

    def __init__(self):
        super().__init__()
        self.again: set[bytes] = set()

    def fill(self, words: set[bytes], tokenizer: _Words) -> None:
        new = words.difference(self)
        self.again |= words - new
        if len(self) + len(new) > _CACHE_ROWS:
            if len(self.again) > _CACHE_ROWS // 2:
                self.again = set(words)
            kept = {w: self[w] for w in self.again if w in self}
            self.clear()
            self.update(kept)
            self.again = set()
            new = words.difference(self)
        new = list(new)
        self.update(zip(new, tokenizer.encode(new), strict=True))


def _tokenizer(spec: str):
    """The tokenizer and the worker's cache for it."""
    alone("packing", _state.clear)
    key = hash(spec)
    if _state.get("key") != key:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec)
        t.no_truncation()
        t.no_padding()
        _state.update(key=key, tokenizer=_Words(t), ids=_Ids())
    return _state["tokenizer"], _state["ids"]


def _split(text: str | None) -> list[bytes]:
    """The words; lower-cased already (the tokenizer would) unless the text may hold a special token."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw if b"<|" in raw else raw.lower()).split()


def _pieces(spec, capacity: int, end_id: int):
    """spec: a broadcast tokenizer file that lower-cases and never joins across ASCII white space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, ids = _tokenizer(spec.value)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for lo in range(0, len(b), 512):
                words = [_split(t) for t in b["text"].iloc[lo : lo + 512]]
                ids.fill(set().union(*words), tokenizer)
                for i, ws in zip(b["doc_id"].iloc[lo : lo + 512].array, words, strict=True):
                    raw = b"".join(map(ids.__getitem__, ws)) + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)})

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut into pieces of capacity."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return id_and_text(docs, id_col, text_col).mapInPandas(_pieces(spec, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Runs of bins that are filled alike."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.rows = capacity, 0, []
        self.left: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
        self.rooms: list[int] = []  # sorted keys of left

    def keep(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.left:
                insort(self.rooms, room)
                self.left[room] = []
            self.left[room].append((first, n))

    def place(self, length: int, lo: int, n: int, first: int, offset: int) -> None:
        self.rows.append((length, lo, lo + n, first, offset))

    def best_fit(self, length: int, lo: int, hi: int) -> None:
        """Pieces lo..hi of one length, each into the tightest room."""
        while lo < hi:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, n = self.left[room].pop()
                if not self.left[room]:
                    del self.left[room], self.rooms[at]
            else:
                room, first = self.capacity, self.count
                n = -(-(hi - lo) // (room // length))
                self.count += n
            each = room // length
            full = min(n, (hi - lo) // each)
            for j in range(each if full else 0):
                self.place(length, lo + j * full, full, first, self.capacity - room + j * length)
            self.keep(room - each * length, first, full)
            lo += each * full
            if full < n:
                rest = hi - lo if hi - lo < each else 0
                for j in range(rest):
                    self.place(length, lo + j, 1, first + full, self.capacity - room + j * length)
                lo += rest
                self.keep(room - rest * length, first + full, 1 if rest else 0)
                self.keep(room, first + full + bool(rest), n - full - bool(rest))


def _best_pattern(sizes: list[int], demand: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of sizes (as (index, times)) that fills room best, by subset sums over bit sets."""
    mask, seen = (1 << (room + 1)) - 1, [1]
    open_ = [i for i, d in enumerate(demand) if d and sizes[i] <= room]
    for i in open_:
        bits = seen[-1]
        for _ in range(min(demand[i], room // sizes[i])):
            bits |= (bits << sizes[i]) & mask
        seen.append(bits)
        if bits >> room & 1:
            break
    at, out = seen[-1].bit_length() - 1, []
    for k in range(len(seen) - 1, 0, -1):
        i, times = open_[k - 1], 0
        while not seen[k - 1] >> at & 1:
            at -= sizes[i]
            times += 1
        if times:
            out.append((i, times))
    return out


def packing_plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(length, rank from, rank to, first sequence, offset) rows and the number of sequences.

    The pieces of one length are ranked from 0; the i-th of an interval lies in sequence first + i at offset.
    """
    bins = _Bins(capacity)
    if counts.get(capacity):
        bins.place(capacity, 0, counts[capacity], 0, 0)
        bins.count = counts[capacity]
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if capacity > x >= capacity / LARGE]
    total = sum(n for _, n in large)
    sizes, demand, stock = [], [], []
    each = -(-total // groups) if total else 0
    room = 0
    for x, n in large:  # groups of equal cardinality, rounded up to their first and largest length
        lo = 0
        while lo < n:
            if not room:
                sizes.append(x)
                demand.append(0)
                stock.append([])
                room = each
            k = min(room, n - lo)
            stock[-1].append([x, lo, lo + k])
            demand[-1] += k
            room -= k
            lo += k
    for s in stock:
        s.reverse()
    for g in range(len(sizes)):
        while demand[g]:
            demand[g] -= 1
            pattern = dict(_best_pattern(sizes, demand, capacity - sizes[g]))
            demand[g] += 1
            pattern[g] = pattern.get(g, 0) + 1
            times = min(demand[i] // k for i, k in pattern.items())
            runs = [(bins.count, times, 0)]  # first bin, bins, filled
            bins.count += times
            for i, k in sorted(pattern.items()):
                demand[i] -= k * times
                for _ in range(k):
                    after = []
                    for first, n, filled in runs:
                        while n:
                            x, lo, hi = top = stock[i][-1]
                            m = min(n, hi - lo)
                            bins.place(x, lo, m, first, filled)
                            after.append((first, m, filled + x))
                            top[1] += m
                            if top[1] == hi:
                                stock[i].pop()
                            first, n = first + m, n - m
                    runs = after
            for first, n, filled in runs:
                bins.keep(capacity - filled, first, n)
    for x in sorted((x for x in counts if x < capacity / LARGE), reverse=True):
        bins.best_fit(x, 0, counts[x])
    return np.array(sorted(bins.rows), np.int64).reshape(-1, 5), bins.count


def _placed(plan, offsets):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = plan.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length = b["length"].to_numpy()
            rank = offsets.value[length, b["salt"].to_numpy()] + b["rank"].to_numpy() - 1
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            b["sequence_id"] = rows[at, 3] + rank - rows[at, 1]
            b["offset"] = rows[at, 4]
            yield b.drop(columns=["salt", "rank"])

    return run


#: Pieces of one length that one task ranks, about.
RANKED = 500_000


def pack(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (any columns, with keys and length 1..capacity) with sequence_id and offset. An empty table stays empty.

    Pieces of the full capacity are sequences of their own (numbered below 0) and are neither counted nor ranked. The
    others are ranked per (length, salt), with as many salts as the commonest length asks for.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    most = short.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // RANKED) or 1
    short = short.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    cells = short.groupBy("length", "salt").count().collect()  # at most capacity x salts, one number for RANKED pieces or length
    table = np.zeros((capacity + 1, salts), np.int64)
    for r in cells:
        table[r["length"], r["salt"]] = r["count"]
    plan, _ = packing_plan({int(x): int(table[x].sum()) for x in np.flatnonzero(table.sum(1))}, capacity)
    if not len(plan):
        plan = np.zeros((1, 5), np.int64)
    send = spark.sparkContext.broadcast
    place = _placed(send(plan), send(np.cumsum(table, 1) - table))
    order = Window.partitionBy("length", "salt").orderBy(*keys)
    schema = ", ".join(f"`{n}` {t}" for n, t in short.drop("salt").dtypes) + ", sequence_id long, offset long"
    return short.withColumn("rank", F.row_number().over(order)).mapInPandas(place, schema).unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids are followed by end_id; only what is longer than capacity is cut. Null or empty texts are the end_id
    alone. Rows that repeat an id are packed each. Sequences are filled from 0 without gaps; an empty table gives no
    rows; other columns are ignored. The tokenizer must lower-case and must not join across white space: texts are
    encoded word by word, and a tokenizer that does otherwise gets other ids than its own library gives.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
