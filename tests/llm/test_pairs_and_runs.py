"""Operators 11 to 13 against brute-force versions on awkward rows, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


# ---- 11 ------------------------------------------------------------------------------------------------------------


def aligned(texts):
    """Per text: n_a, n_b, groups as text, links; whole texts, no chunks."""
    import sentencepiece
    import tokenizers

    from cadenza.llm.bpe import Vocabulary

    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    a, b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    raw = Vocabulary(open(a_path).read()).bytes
    out = []
    for t in texts:
        if not t:
            out.append((0, 0, "", []))
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bx = [raw[i] for i in x]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        ex, ey = np.cumsum([len(p) for p in bx]), np.cumsum([len(p) for p in by])
        links = []
        for j, e in enumerate(ey):
            lo = e - len(by[j])
            i = int(np.searchsorted(ex, lo, "right"))
            while i < len(x) and ex[i] - len(bx[i]) < e:
                links.append((x[i], y[j]))
                i += 1
        common = sorted(set(ex.tolist()) & set(ey.tolist()))
        groups, i, j = [], 0, 0
        for c in common:
            p, q = int(np.searchsorted(ex, c)) + 1, int(np.searchsorted(ey, c)) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        out.append((len(x), len(y), ";".join(groups), links))
    return out


def test_alignment(docs, empty, sample, monkeypatch):
    from cadenza.llm import alignment as A

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [r[1] for r in sample]
    want = aligned(texts)
    count = Counter(p for *_, links in want for p in links)
    top = defaultdict(int)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    rows = Counter((r[0], n, m, g.count(";") + 1 if g else 0, len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), sha(g) if g else "") for r, (n, m, g, k) in zip(sample, want, strict=True))
    for fan_in, limit in ((A.FAN_IN, A.BATCH_CHARS), (2, 2_000)):
        monkeypatch.setattr(A, "FAN_IN", fan_in)  # 2: heads under several salts
        monkeypatch.setattr(A, "BATCH_CHARS", limit)
        got = A.alignment(docs, *paths).collect()
        assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == rows
    pairs = A.pair_counts(docs, *paths).collect()
    assert {(r.a_id, r.b_id): r.n_links for r in pairs} == count
    assert all(r.best == (r.n_links == top[r.b_id]) for r in pairs)
    assert Counter((r.doc_id, r.groups) for r in A.token_groups(docs, *paths).collect()) == Counter((r[0], w[2]) for r, w in zip(sample, want, strict=True))
    assert A.alignment(empty, *paths).collect() == [] and A.pair_counts(empty, *paths).collect() == []


def test_alignment_odd_blanks(spark):
    from cadenza.llm import alignment as A

    parts = [" ", "  ", "\n", "\t", " \n ", "a", "b c", "é", " ", "　", "\x1c", "​", "don't", "12", "!?", "▁", "<s>", "<|endoftext|>", "<0x41>", "你好", "\U0001f600", "\r\n", "x" * 40]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in A.token_groups(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in range(len(texts))] == [w[2] for w in aligned(texts)]


def test_merged_runs():
    from cadenza.llm import alignment as A

    rng = np.random.default_rng(1)
    for _ in range(30):
        runs, want = [], Counter()
        for _ in range(rng.integers(0, 9)):
            keys = np.unique(rng.integers(0, 300, rng.integers(0, 80)))
            counts = rng.integers(1, 9, len(keys))
            want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            step = int(rng.integers(1, 20))
            runs.append([A.pack_counts(keys[i : i + step], counts[i : i + step]) for i in range(0, len(keys), step)])
        blocks = list(A.merged(runs))
        keys = [k for x, _ in blocks for k in x.tolist()]
        assert keys == sorted(want) and [c for _, x in blocks for c in x.tolist()] == [want[k] for k in keys]


# ---- 12 ------------------------------------------------------------------------------------------------------------


def brute_components(rows, width, num):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= num * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= num * (len(x) + len(y) - c):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append((r[0] is None, r[0] or 0, r[0]))
    return Counter((r[0], len(sets[i]), min(least[find(i)])[2]) for i, r in enumerate(rows))


def edited(rng, base, edits, vocabulary):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(vocabulary)}"
    return " ".join(w)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, sample, width, num):
    from cadenza.llm.ngram_join import ngram_join

    got = Counter(map(tuple, ngram_join(docs, width=width, threshold=num / 100).collect()))
    assert got == brute_components([r[:2] for r in sample], width, num)
    assert ngram_join(empty, width=width, threshold=num / 100).collect() == []


def test_ngram_join_frequent_tokens(spark, monkeypatch):
    """Chains of near copies, one passage in many texts and texts of one template: lists stay open, are parted by
    combinations and at last compared in blocks."""
    from cadenza.llm import ngram_join as J

    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    chain, texts = list(base), []
    for i in range(40):
        chain[rng.randrange(len(chain))] = f"c{i}"
        texts.append(" ".join(chain))
    texts += [edited(rng, base, rng.randrange(5), 9) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(90))
    texts += [passage + " " + " ".join(f"q{rng.randrange(300)}" for _ in range(12)) for _ in range(50)]
    texts += [" ".join(f"v{k}{rng.randrange(3)}" if k % 12 == 0 else f"t{k}" for k in range(90)) for _ in range(160)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "RARE", 6)
    want = brute_components(rows, 3, 90)
    monkeypatch.setattr(J, "LONGEST", 2)
    assert Counter(map(tuple, J.ngram_join(d, width=3, threshold=0.9).collect())) == want


# ---- 13 ------------------------------------------------------------------------------------------------------------


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        if len(w) > 3000 and not any(w[i] == w[i + q] == w[i + 2 * q] for i in range(0, len(w) - 2 * q, q)):
            continue  # a run of four periods holds such places
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found))


def collapse(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_brute_force(monkeypatch):
    from cadenza.llm import periodic_runs as P

    rng = random.Random(2)
    texts = []
    for _ in range(1500):
        n, a = rng.randrange(70), rng.choice([1, 2, 3, 6])
        w = [b"%d" % rng.randrange(a) for _ in range(n)]
        if n and rng.random() < 0.5:
            s, p = rng.randrange(n), rng.randrange(1, 9)
            w = [w[min(n - 1, s + (i - s) % p)] if i >= s else x for i, x in enumerate(w)]
        texts.append(w)
    for size in (P.BATCH_WORDS, 50):
        monkeypatch.setattr(P, "BATCH_WORDS", size)
        for w, rows, keep in P.text_runs(texts):
            want = brute_runs(w)
            assert [tuple(r) for r in rows.tolist()] == want, w
            assert b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode() == collapse([x.decode() for x in w], want)


def test_periodic_runs(docs, empty, sample):
    from cadenza.llm import periodic_runs as P

    want, digests = Counter(), Counter()
    for i, t, *_ in sample:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 3000 else []
        want[(i, len(w), tuple(runs), collapse(w, runs))] += 1
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            runs = brute_runs(w)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digests[(i, len(runs), s, m, q, runs and 1000 * m // q or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(w, runs)))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in P.periodic_runs(docs).collect()) == want
    assert Counter(map(tuple, P.run_digests(P.planted(docs)).collect())) == digests
    assert P.run_digests(P.planted(empty)).collect() == []


def test_long_period_one(spark):
    from cadenza.llm import periodic_runs as P

    d = spark.createDataFrame([(1, "a " * 200_000), (2, "a b c " * 50_000 + "a b"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(d).collect()}
    assert got == {1: ([(0, 200_000, 1)], "a"), 2: ([(0, 150_002, 3)], "a b c"), 3: ([], "x")}
