"""Removal of word windows that an earlier document has, by suffix automata of reference shards.

The windows are routed to shards in which equal windows meet (see windows); that only selects what a shard holds and
decides nothing. Each shard compiles all of its segments, equal ones too, into one suffix automaton whose states know
the least document id among their occurrences, and streams the segments through it: where the matching statistic
reaches the window's length in a state of a smaller id, the window is a repeat. Segments lose what lies outside
windows whose fingerprint occurs twice in the shard. Only copies within one batch of texts fold before, by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadenza.llm.common import alone
from cadenza.llm.suffix_dedup import _spans
from cadenza.llm.windows import RANGE, covered, gram_hashes, mix, repeated_runs, rows_of, segments, shards, with_ranges

GRAM, LONGEST = 4, 64
#: Bytes of a word's hash that travel in a segment.
WORD = 5
#: More than any owner.
NOBODY = 2**63 - 1


#: Bytes whose words are hashed at a time; a longer word is hashed by its digest.
BLOCK = 1 << 14
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_STEP = 0xD6E8FEB86659FD93
_POWER, _INVERSE = (np.r_[np.uint64(1), np.multiply.accumulate(np.full(BLOCK - 1, c, np.uint64))] for c in (_STEP, pow(_STEP, -1, 2**64)))
with np.errstate(over="ignore"):
    _OF_BYTE = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)))


def _symbols(text: str) -> np.ndarray:
    """A 64-bit hash of each word: the mixed value of a polynomial in its bytes, all words of a block at once.

    Of a block's bytes, times the powers of their places, sums are taken up to each place; what a word adds to them is
    divided by the power of its start, so that it is the same at all places.
    """
    alone("substring_dedup")
    raw = b" %b " % text.encode("utf-8", "replace")
    x = np.frombuffer(raw, np.uint8)
    blank = _BLANK[x]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(out):
        base = start[lo]
        hi = int(np.searchsorted(end, base + BLOCK, "right")) if len(x) > BLOCK else len(out)
        if hi == lo:  # a word beyond a block
            hi = lo + 1
            out[lo] = int.from_bytes(blake2b(raw[base : end[lo]], digest_size=8).digest(), "little")
        else:
            n = end[hi - 1] - base
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_OF_BYTE[x[base : base + n]] * _POWER[:n], out=total[1:])
            at = start[lo:hi] - base
            out[lo:hi] = mix((total[end[lo:hi] - base] - total[at]) * _INVERSE[at])
        lo = hi
    return out


def _pieces(text: str):
    x = _symbols(text)
    x = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :WORD].copy()  # little-endian: the low bytes
    return (lambda lo, hi: x[lo:hi].tobytes()), len(x)


def _words(seg: bytes) -> list[int]:
    x = np.zeros((len(seg) // WORD, 8), np.uint8)
    x[:, :WORD] = np.frombuffer(seg, np.uint8).reshape(-1, WORD)
    return x.view(np.uint64).ravel().tolist()


class SuffixAutomaton:
    """Of several sequences; least[state] is the smallest owner among the sequences that hold the state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [NOBODY]

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:  # another sequence was here
                last = q
            else:
                p, new = last, -1
                if q is None:
                    new = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    least.append(NOBODY)
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = new
                        p = link[p]
                    q = nxt[p][c] if p >= 0 else None
                if q is not None:
                    if length[q] == length[p] + 1:
                        clone = q
                    else:
                        clone = len(nxt)
                        nxt.append(nxt[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        least.append(NOBODY)
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = clone
                    if new >= 0:
                        link[new] = clone
                    else:
                        new = clone
                last = new
            if owner < least[last]:
                least[last] = owner

    def close(self) -> None:
        """Carries the least owners up the suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def earliest(self, sequence: list[int], width: int) -> np.ndarray:
        """The least owner of each window of the sequence. Matching statistics, one step per symbol."""
        out = np.full(len(sequence) - width + 1, NOBODY)
        state, matched = 0, 0
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            while self.length[self.link[state]] >= width if state else False:
                state = self.link[state]
                matched = self.length[state]
            if matched >= width:
                out[i - width + 1] = self.least[state]
        return out

    def earlier(self, sequence: list[int], owner: int, width: int) -> np.ndarray:
        """For each window of the sequence: does a smaller owner have it?"""
        return self.earliest(sequence, width) < owner


def _candidates(segs: list[bytes], did: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last, late): the stretch of each segment between windows whose fingerprint occurs twice, and
    whether a smaller id has one of these fingerprints. No window outside it can be a repeat, nor one of a segment that
    is not late; whether the others are is for the automaton to say."""
    n = np.fromiter(map(len, segs), np.int64, len(segs)) // WORD
    x = np.zeros((int(n.sum()), 8), np.uint8)
    x[:, :WORD] = np.frombuffer(b"".join(segs), np.uint8).reshape(-1, WORD)
    with np.errstate(over="ignore"):
        prints = gram_hashes(x.view(np.uint64).ravel(), width)
    owner = np.repeat(np.arange(len(segs)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    inside = owner[: len(prints)] == owner[width - 1 :]  # not across two segments
    prints, owner, place = prints[inside], owner[: len(inside)][inside], place[: len(inside)][inside]
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    new, mine = np.r_[True, ~same], did[owner[order]]
    behind = np.minimum.reduceat(mine, np.flatnonzero(new))[np.cumsum(new) - 1] < mine
    late = np.zeros(len(segs), bool)
    late[owner[order[behind]]] = True
    hit = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    pick, first = np.unique(owner[hit], return_index=True)
    last = np.r_[first[1:], len(hit)][: len(pick)] - 1
    return pick, place[hit[first]], place[hit[last]], late[pick]


def shard_repeats(b: pd.DataFrame, width: int) -> pd.DataFrame:
    """The ranges of a shard's segments (sorted by key) whose windows a smaller id has: one automaton for all. Equal
    stretches (byte by byte) are compiled and streamed once, and what is found holds for each of them."""
    pick, first, last, late = _candidates(b["seg"].tolist(), b["did"].to_numpy(np.int64), width)
    b = b.iloc[pick]
    parts = [s[x * WORD : (y + width) * WORD] for s, x, y in zip(b["seg"], first.tolist(), last.tolist(), strict=True)]
    did, row, start, more = (b[c].tolist() for c in ("did", "row", "start", "more"))
    # One that is in the automaton with a smaller owner would add nothing, and equal ones take the same path through it.
    owners: dict[bytes, int] = {}
    for x, o in zip(parts, did, strict=True):
        owners[x] = min(o, owners.get(x, o))
    automaton = SuffixAutomaton()
    for x, o in owners.items():
        automaton.add(_words(x), o)
    automaton.close()
    earliest: dict[bytes, np.ndarray] = {}
    out = []
    for k, x in enumerate(parts):
        if late[k]:
            if x not in earliest:
                earliest[x] = automaton.earliest(_words(x), width)
            spans = _spans(earliest[x] < did[k])
            if spans:
                skip = int(first[k])
                starts = [start[k], *np.frombuffer(more[k] or b"", np.int32).tolist()]
                out += [(did[k], row[k], s + skip + at, n) for at, n in spans for s in starts]
    return pd.DataFrame(out, columns=RANGE)


def _shard(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for counts, b in shards(batches):
            yield shard_repeats(b, width) if counts else b

    return run


def repeated_ranges(rows: DataFrame, width: int) -> DataFrame:
    found = repeated_runs(rows, _symbols, width, GRAM, LONGEST, within=False)
    return segments(rows, found, _pieces, width, same_row_is_sure=False).mapInPandas(_shard(width), "did long, row long, start int, n int")


def _removed(width: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, ranges in zip(b["doc_id"].array, b["text"], b["ranges"], strict=True):
                words = t.encode("utf-8", "replace").split()
                if len(ranges):
                    gone = covered(len(words), ranges, width)
                    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    n = int(gone.sum())
                else:
                    left, n = b" ".join(words), 0
                out.append((i, len(words), n, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if texts else [])))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]).astype({"doc_id": "Int64"})

    return run


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Words are runs of anything but ASCII white space. A word is removed when a window of width (8 to 250) consecutive
    words that covers it also starts in a document of a smaller id; windows are judged on the input. Null text has no words; a
    null id counts as smaller than any. Rows that share an id do not remove each other's words. An empty table gives
    no rows; other columns are ignored.
    """
    if not 2 * GRAM <= width <= 250:
        raise ValueError(f"width must be from {2 * GRAM} to 250 words")
    rows = rows_of(docs, id_col, text_col)
    both = with_ranges(rows, repeated_ranges(rows, width))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return both.drop("more").mapInPandas(_removed(width, texts), schema)
