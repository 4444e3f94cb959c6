"""Two tokenizers' tokens of a text, aligned by byte ranges, and how often the corpus links each pair of ids.

1. Texts are cut into chunks where both tokenizers begin anew: before a blank that follows anything but white space (no
   word of A's pattern and no piece of B spans one). A chunk is encoded once for each worker and its groups and links
   are kept.
2. A batch of texts gives pair-document records (B id, A id, document, links), sorted, and split by the low digits of
   the B id into runs. A run is two zstd frames: its pairs with their links in the batch (head), and the documents of
   each pair (body).
3. Heads of one radix are merged by a k-way heap merge that adds up each pair's links, first those of a bounded number
   of batches, then the sums. Pairs come in order of their B id, so the greatest count of a B id is known when its last
   pair has passed.
4. The counts go back to the batches' heads and meet the bodies, batch by batch, where documents add up what their
   links contribute. No record leaves its batch but in a head, which holds a pair once.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import Vocabulary
from cadenza.llm.common import alone, cut, drop, id_and_text, sliced

#: A batch has at most so many characters (or one text) and so many documents; ids are below 1 << BITS.
BATCH_CHARS, BATCH_DOCS, BITS = 4_000_000, 8_192, 20
#: Runs are parted by so many low bits of the B id; heads of so many batches are merged in one task.
RADIX_BITS, FAN_IN = 9, 1_024
#: Pairs in a frame of counts.
FRAME = 8_192
#: Chunks that a worker remembers.
_CHUNKS = 300_000
_META = -1
_CLOSE = re.compile(r"(?<=\S) ")
_AWKWARD = re.compile(r"^ |\s ")
_state: dict = {}


def chunks(text: str) -> list[str]:
    """text cut before each blank that follows anything but white space; every part has lost the blank that it begins
    with (the first the one that is put before the text)."""
    return _CLOSE.split(text) if _AWKWARD.search(text) else text.split(" ")


class Encoders:
    """Both tokenizers on chunks, and the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = Vocabulary(spec).bytes
        self.blank = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # Every id as text with each sign that may follow it: A's ids, then B's, four times.
        self.texts = [f"{i}{sign}" for sign in SIGNS for size in (len(self.a_bytes), len(self.b_bytes)) for i in range(size)]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of blank + part."""
        ours = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return ours, [y if p else [self.blank] for p, y in zip(parts, self.b.encode(parts, num_threads=1), strict=True)]

    def whole(self, part: str, a: list[int], b: list[int]) -> bool:
        """Whether both give the chunk's bytes back."""
        return b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == (" " + part).encode()


#: What follows an id in the text of groups: another of its side, B's part, the next group, the next chunk.
SIGNS = ",|;\n"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Chunks(dict):
    """part -> number; what belongs to each number is in arrays."""

    def __init__(self, encoders: Encoders):
        super().__init__()
        self.encoders = encoders
        self.new: list[str] = []
        self.text: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.good = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)  # the chunks' links, one after the other
        self.ends = np.zeros(0, np.int64)

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n

    def fill(self) -> None:
        """Encodes and aligns what has been asked for, all of it side by side: where both tokenizers give a chunk back,
        its tokens cover the same bytes, so the chunks' tokens one after the other have common offsets."""
        if not self.new:
            return
        e = self.encoders
        a, b = e.encode(self.new)
        (flat_a, na), (flat_b, nb) = _flat(a), _flat(b)
        good = np.ones(len(a), bool)
        length = [np.add.reduceat(size[flat], np.cumsum(n) - n) for size, flat, n in ((e.a_size, flat_a, na), (e.b_size, flat_b, nb))]
        raw = [b"".join(map(of.__getitem__, flat.tolist())) for of, flat in ((e.a_bytes, flat_a), (e.b_bytes, flat_b))]
        if (length[0] != length[1]).any() or not raw[0] == raw[1] == "".join([" " + p for p in self.new]).encode():
            good = np.array([e.whole(p, x, y) for p, x, y in zip(self.new, a, b, strict=True)])
            (flat_a, na), (flat_b, nb) = (_flat([x if g else [] for x, g in zip(y, good.tolist(), strict=True)]) for y in (a, b))
        texts, counts, pairs = _aligned(e, flat_a, na, flat_b, nb)
        self.text += texts
        self.sizes = np.concatenate([self.sizes, counts])
        self.good = np.r_[self.good, good]
        self.ends = np.r_[self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(counts[:, 3])]
        self.pairs = np.r_[self.pairs, pairs]
        self.new.clear()


def _aligned(e: Encoders, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of chunks whose tokens (a, na for each; b, nb) cover the same bytes: the groups between offsets where tokens of
    both end, as text; the numbers of A tokens, B tokens, groups and links; the links (tokens that overlap), by chunk."""
    end_a, end_b = np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b])
    stop_a, stop_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
    group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
    owner_a, owner_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    first = np.searchsorted(end_a, end_b - e.b_size[b], "right")
    links = np.searchsorted(end_a - e.a_size[a], end_b, "left") - first
    which = np.repeat(first - (np.cumsum(links) - links), links) + np.arange(int(links.sum()))
    pairs = pair_key(a[which], np.repeat(b, links))
    counts = np.stack([na, nb, np.bincount(owner_b[stop_b], minlength=len(nb)), np.bincount(owner_b, weights=links, minlength=len(nb)).astype(np.int64)], 1)
    last = np.r_[owner_b[1:] != owner_b[:-1], [True] * min(1, len(b))].astype(bool)
    sign = np.r_[np.where(stop_a, 1, 0), np.where(last, 3, np.where(stop_b, 2, 0))]
    names = np.r_[a, b + len(e.a_bytes)] + sign * (len(e.a_bytes) + len(e.b_bytes))
    order = np.lexsort((np.r_[np.zeros(len(a), bool), np.ones(len(b), bool)], np.r_[group_a, group_b]))
    lines = iter("".join(map(e.texts.__getitem__, names[order].tolist())).split("\n"))
    return [next(lines) if n else "" for n in nb.tolist()], counts, pairs


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs in order of their radix, then B id, then A id."""
    return (b & ((1 << RADIX_BITS) - 1)) << (2 * BITS) | b << BITS | a


def _pack(*columns: np.ndarray) -> bytes:
    out = b"".join(np.int64(x.nbytes).tobytes() + x.tobytes() for x in columns)
    return _zstd().compress(out)


def _zstd():
    if "zstd" not in _state:
        _state["zstd"] = zstandard.ZstdCompressor(level=3)
    return _state["zstd"]


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A frame of pairs in order and their counts."""
    return _pack(np.diff(keys, prepend=0).astype("<i8"), counts.astype("<i8"))


def unpack_counts(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, counts = _unpack(frame, "<i8", "<i8")
    return np.cumsum(step), counts


def merged(runs: list[Iterable[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of sorted runs of frames, in order, counts of equal pairs added up.

    The heap has each run's current frame by its last pair: up to the least of these, no frame that is still to come
    holds anything, so all runs' pairs up to it are merged and the frame that it ends is followed by its run's next.
    """
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []
    rest = [iter(r) for r in runs]

    def advance(k: int) -> None:
        for frame in rest[k]:
            keys, counts = unpack_counts(frame)
            if len(keys):
                heads[k] = keys, counts
                heapq.heappush(heap, (int(keys[-1]), k))
                return
        heads.pop(k, None)

    for k in range(len(runs)):
        advance(k)
    while heap:
        bound, done = heap[0][0], []
        while heap and heap[0][0] == bound:
            done.append(heapq.heappop(heap)[1])
        keys, counts = [], []
        for k, (x, c) in heads.items():
            if x[0] <= bound:
                to = len(x) if x[-1] <= bound else int(np.searchsorted(x, bound, "right"))
                keys.append(x[:to])
                counts.append(c[:to])
                heads[k] = x[to:], c[to:]
        for k in done:
            advance(k)
        heads = {k: v for k, v in heads.items() if len(v[0])}
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        yield found, total


def _frames(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
    """Blocks of any size as frames of at most FRAME pairs."""
    keys, counts, size = [], [], 0
    for k, c in blocks:
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size >= FRAME:
            k, c = np.concatenate(keys), np.concatenate(counts)
            for at in range(0, size - size % FRAME, FRAME):
                yield pack_counts(k[at : at + FRAME], c[at : at + FRAME])
            keys, counts, size = [k[size - size % FRAME :]], [c[size - size % FRAME :]], size % FRAME
    if size:
        yield pack_counts(np.concatenate(keys), np.concatenate(counts))


def best_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair has its B id's greatest count; keys in order, each B id's pairs together."""
    if not len(keys):
        return np.zeros(0, bool)
    b = keys >> BITS
    first = np.r_[True, b[1:] != b[:-1]]
    top = np.maximum.reduceat(counts, np.flatnonzero(first))
    return counts == top[np.cumsum(first) - 1]


# ---- a batch of texts ----------------------------------------------------------------------------------------------


def _chunks_of(spec, model) -> Chunks:
    """The worker's chunks."""
    alone("alignment", _state.clear)
    c = _state.get("chunks")
    if c is None or len(c) > _CHUNKS:
        _state["encoders"] = _state.get("encoders") or Encoders(spec.value, model.value)
        c = _state["chunks"] = Chunks(_state["encoders"])
    return c


def _numbered(texts: Iterable[str | None], cache: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """The chunk numbers of the texts, one after the other, and how many each has. Null and empty texts, and such as
    hold the piece model's own sign for a blank, have none."""
    parts = [chunks(t) if t and "▁" not in t else [] for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    ids = np.fromiter(map(cache.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
    cache.fill()
    return ids, n


def _records(spec, model):
    """Rows (batch, radix, head, body): the runs of each batch and, under the radix _META, its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for b in sliced(batches, BATCH_CHARS, BATCH_DOCS):
            cache = _chunks_of(spec, model)
            ids, n = _numbered(b["text"], cache)
            used, at = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(b)), n)
            good = cache.good[used]
            bad = np.bincount(owner[~good[at]], minlength=len(b)) > 0
            live = ~bad[owner]
            size = cache.sizes[used]
            totals = np.zeros((len(b), 4), np.int64)
            np.add.at(totals, owner[live], size[at[live]])
            texts, start = [cache.text[c] for c in used.tolist()], np.cumsum(n) - n
            place = at.tolist()
            sha = [hashlib.sha256(";".join(map(texts.__getitem__, place[s : s + m])).encode()).hexdigest() if m and not x else "" for s, m, x in zip(start.tolist(), n.tolist(), bad, strict=True)]
            meta = pa.table({"doc_id": pa.array(b["doc_id"], pa.int64(), from_pandas=True), **{c: totals[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": sha})
            raw = io.BytesIO()
            with pa.ipc.new_stream(raw, meta.schema) as w:
                w.write_table(meta)
            rows = [(number, _META, b"", _zstd().compress(raw.getvalue()))]
            # Documents' distinct chunks, then their distinct pairs.
            both, times = np.unique(owner[live] * max(1, len(used)) + at[live], return_counts=True)
            doc, chunk = both // max(1, len(used)), both % max(1, len(used))
            count = size[:, 3]
            base = cache.ends[used] - count
            names, local = np.unique(cache.pairs, return_inverse=True)
            spread = count[chunk]
            where = np.repeat(base[chunk] - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
            key, back = np.unique(local[where] * len(b) + np.repeat(doc, spread), return_inverse=True)
            links = np.bincount(back, weights=np.repeat(times, spread), minlength=len(key)).astype(np.int64)
            pair, doc = key // len(b), key % len(b)
            present, docs_of = np.unique(pair, return_counts=True)
            ends = np.cumsum(docs_of)
            total = np.add.reduceat(links, ends - docs_of) if len(present) else links
            radix = names[present] >> (2 * BITS)
            cuts = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1]]) if len(radix) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(radix)], strict=True):
                x, y = int(ends[lo] - docs_of[lo]), int(ends[hi - 1])
                body = _pack(docs_of[lo:hi].astype("<u4"), doc[x:y].astype("<u2"), links[x:y].astype("<u4"))
                rows.append((number, int(radix[lo]), pack_counts(names[present[lo:hi]], total[lo:hi]), body))
            number += 1
            yield pd.DataFrame(rows, columns=["batch", "radix", "head", "body"])

    return run


# ---- counting ------------------------------------------------------------------------------------------------------


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key values, rows) of each group of a partition that is sorted by the keys; rows are read as they are used."""
    from itertools import groupby

    rows = (r for b in batches for r in b.itertuples(index=False))
    yield from groupby(rows, lambda r: tuple(getattr(r, k) for k in keys))


def _summed(by: list[str]):
    """One run of frames for each group of runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, rows in _grouped(batches, by):
            runs: dict[int, list[bytes]] = {}
            for r in rows:
                runs.setdefault(r.batch, []).append(r.head)
            out = [(*group, i, f) for i, f in enumerate(_frames(merged(list(runs.values()))))]
            yield pd.DataFrame(out, columns=[*by, "seq", "head"])

    return run


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each head, its pairs' counts in the corpus and whether they are their B ids' best. A group's totals (seq >= 0)
    come before its heads; they are bounded by the vocabularies' pairs of a radix."""
    for (radix, _), rows in _grouped(batches, ["radix", "salt"]):
        frames, out, keys = [], [], None
        for r in rows:
            if r.seq >= 0:
                frames.append(unpack_counts(r.head))
                continue
            if keys is None:
                keys, counts = (np.concatenate(x) for x in zip(*frames, strict=True))
                best = best_of(keys, counts)
            at = np.searchsorted(keys, unpack_counts(r.head)[0])
            out.append((r.batch, radix, _pack(counts[at].astype("<i8"), best[at].astype("u1"))))
        yield pd.DataFrame(out, columns=["batch", "radix", "answer"])


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of each batch, with what their links contribute."""
    for _, rows in _grouped(batches, ["batch"]):
        meta = best = total = body = answer = None
        for r in rows:  # by radix: the documents first, then each radix's body and answer
            if r.radix == _META:
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(r.body)) as f:
                    meta = f.read_all().to_pandas(integer_object_nulls=True)
                best, total = np.zeros(len(meta), np.int64), np.zeros(len(meta), np.int64)
                continue
            body, answer = (r.body, answer) if r.body is not None else (body, r.answer)
            if body is not None and answer is not None:
                docs_of, doc, links = _unpack(body, "<u4", "<u2", "<u4")
                counts, top = _unpack(answer, "<i8", "u1")
                pair = np.repeat(np.arange(len(docs_of)), docs_of)
                np.add.at(total, doc, links * counts[pair])
                np.add.at(best, doc, links.astype(np.int64) * top[pair])
                body = answer = None
        yield meta.assign(n_best=best, count_sum=total)[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]].astype({"doc_id": "Int64"})


def _broadcast(docs: DataFrame, a_path: str, b_path: str):
    """Both tokenizers' files: of the size of their vocabularies."""
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return context.broadcast(f.read()), context.broadcast(g.read())


def _salted_heads(runs: DataFrame) -> DataFrame:
    """The heads, as many batches under a salt as one task merges."""
    batches = runs.where(F.col("radix") == _META).count()
    salts = max(1, -(-batches // FAN_IN))
    return runs.where("radix >= 0").select("radix", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt"), F.lit(-1).alias("seq"), "batch", "head")


def _totals(heads: DataFrame) -> DataFrame:
    """(radix, seq, head): the corpus's counts of pairs, as frames."""
    some = heads.repartition("radix", "salt").sortWithinPartitions("radix", "salt", "batch").mapInPandas(_summed(["radix", "salt"]), "radix int, salt int, seq int, head binary")
    some = some.withColumnRenamed("salt", "batch").repartition("radix").sortWithinPartitions("radix", "batch", "seq")
    return some.mapInPandas(_summed(["radix"]), "radix int, seq int, head binary")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n_links, best: how many links of the corpus hold each pair of ids, and whether no other pair of its
    B id has more."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in _grouped(batches, ["radix"]):
            keys, counts = (np.concatenate(x) for x in zip(*[unpack_counts(r.head) for r in group], strict=True))
            low = (1 << BITS) - 1
            yield pd.DataFrame({"a_id": keys & low, "b_id": keys >> BITS & low, "n_links": counts, "best": best_of(keys, counts)})

    spec, model = _broadcast(docs, a_path, b_path)
    runs = cut(id_and_text(docs, id_col, text_col).mapInPandas(_records(spec, model), "batch long, radix int, head binary, body binary"))
    totals = _totals(_salted_heads(runs)).repartition("radix").sortWithinPartitions("radix", "seq")
    return totals.mapInPandas(rows, "a_id long, b_id long, n_links long, best boolean")


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups: the text's groups as text, `a1,a2|b1;a3|b2,b3` of decimal ids; empty where a text has no tokens
    (null, empty, or not given back by both tokenizers)."""
    spec, model = _broadcast(docs, a_path, b_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, BATCH_CHARS, BATCH_DOCS):
            cache = _chunks_of(spec, model)
            ids, n = _numbered(b["text"], cache)
            ends, place = np.cumsum(n), ids.tolist()
            parts = [place[e - m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "groups": [";".join(map(cache.text.__getitem__, p)) if cache.good[p].all() else "" for p in parts]})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, groups string")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is its B id's
    greatest), count_sum (of the counts over the links), groups_sha256 (of token_groups' text; '' without tokens).

    a_path: a byte-level BPE of the tokenizers library; b_path: a sentencepiece model with byte fallback and without
    normalisation. Texts are encoded with a blank before them; special tokens' strings are plain text. Texts that are
    null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros. Rows are counted each,
    whatever their ids (null and repeated ones too); an empty table gives no rows; other columns are ignored.
    """
    spec, model = _broadcast(docs, a_path, b_path)
    runs = cut(id_and_text(docs, id_col, text_col).mapInPandas(_records(spec, model), "batch long, radix int, head binary, body binary"))
    heads = _salted_heads(runs)
    totals = cut(_totals(heads))
    back = totals.join(heads.select("radix", "salt").distinct(), "radix").select("radix", "salt", "seq", F.lit(None).cast("long").alias("batch"), "head")
    asked = back.unionByName(heads).withColumn("late", F.col("seq") < 0)
    answers = asked.repartition("radix", "salt").sortWithinPartitions("radix", "salt", "late", "seq").drop("late").mapInPandas(_answers, "batch long, radix int, answer binary")
    both = runs.select("batch", "radix", "body", F.lit(None).cast("binary").alias("answer")).unionByName(answers.select("batch", "radix", F.lit(None).cast("binary").alias("body"), "answer"))
    done = both.repartition("batch").sortWithinPartitions("batch", "radix").mapInPandas(_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    out = cut(done)
    drop(runs, totals)
    return out
