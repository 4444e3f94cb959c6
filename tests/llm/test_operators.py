"""Each operator against a brute-force version on a fixture of awkward rows, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SPACE = " \t\n\x0b\x0c\r"


def strip(t):
    return "".join(c for c in (t or "") if c not in SPACE)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(i):
    return (i is None, i or 0)


def test_exact_dedup(docs, empty, sample):
    from cadenza.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for i, t, *_ in sample:
        groups[strip(t)].append((-len(t or ""), order(i), i))
    got = exact_dedup(docs).collect()
    assert len(got) == len(sample)
    want = Counter((i, min(groups[strip(t)])[2], len(groups[strip(t)]), sha(strip(t))) for i, t, *_ in sample)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty).collect() == []


def test_quality_rules(docs, empty, sample):
    from cadenza.llm.quality_rules import quality_rules

    got = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    for i, t, *_ in sample:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if strip(x)]
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(strip(t)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in got.values())
    assert quality_rules(empty).collect() == []


def test_quality_rules_fences(spark):
    """The fences follow each group, and judge short and long texts by what chance allows them."""
    from cadenza.llm.quality_rules import quality_rules, text_metrics, with_rates

    r = np.random.default_rng(3)
    letters = np.array(list("abcdefghij"))

    def text(n, least, most, symbols=0.0, lines=1, repeated=0):
        words = ["".join(r.choice(letters, k)) for k in r.integers(least, most + 1, n)]
        words = [w + "#" if r.random() < symbols else w for w in words]
        rows = [" ".join(w) for w in np.array_split(np.array(words, object), lines)]
        return "\n".join(rows + rows[:1] * repeated)

    rows = []
    for g, (least, most, symbols) in enumerate([(2, 6, 0.0), (5, 12, 0.3)]):
        rows += [(1000 * g + i, text(int(r.integers(60, 900)), least, most, symbols, 20, i % 5 == 0), "en", f"s{g}") for i in range(200)]
    odd = [text(300, 5, 12), text(300, 2, 6, 0.3), text(300, 2, 6, 0.0), text(300, 5, 12, 0.3), text(120, 2, 6, 0.0, 20, 19)]
    rows += [(5000 + i, t, "en", s) for i, (t, s) in enumerate(zip(odd, ["s0", "s0", "s1", "s1", "s0"], strict=True))]
    rows += [(6000, text(90, 2, 6), None, None), (6001, "a b", None, None), (6002, None, "en", "none")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules(d).collect()}
    rates = {x.doc_id: x for x in with_rates(text_metrics(d)).collect()}

    def disc(values, p):
        v = sorted(values)
        return v[max(0, math.ceil(p * len(v)) - 1)]

    group = defaultdict(list)
    for x in rates.values():
        if x.n_words:
            group[x.lang, x.source].append(x)
    clumps = {k: [x[k] for xs in group.values() for x in xs if x[k] > 0] for k in ("dup_line_rate", "repeat_rate")}
    for xs in group.values():
        mid = disc([x.mean_word for x in xs], 0.5)
        z = {x.doc_id: (x.mean_word - mid) * math.sqrt(x.n_words) for x in xs}
        y = {x.doc_id: x.symbol_rate * math.sqrt(x.word_chars) for x in xs}
        m1, m3, s1, s3 = disc(z.values(), 0.25), disc(z.values(), 0.75), disc(y.values(), 0.25), disc(y.values(), 0.75)
        noise = math.sqrt(sum(x.n_symbols for x in xs) / sum(x.word_chars for x in xs))
        for x in xs:
            ok = m1 - 3 * (m3 - m1) <= z[x.doc_id] <= m3 + 3 * (m3 - m1) and y[x.doc_id] <= s3 + 3 * max(s3 - s1, noise)
            for k, every in clumps.items():
                some = [o[k] for o in xs if o[k] > 0]
                if some:
                    ok &= x[k] <= disc(some, 0.9) + 3 * max(disc(some, 0.9) - disc(some, 0.1), disc(every, 0.9) - disc(every, 0.1))
            assert got[x.doc_id].kept == (ok and not got[x.doc_id].base_failed), x
    assert [got[5000 + i].kept for i in range(5)] == [False, False, False, True, False]
    assert all(got[i].kept for i in range(200)) and all(got[1000 + i].kept for i in range(200)) and got[6000].kept


def test_quality_rules_long_repeats(spark):
    from cadenza.llm import quality_rules as q

    text = " ".join(f"w{i % 700}" for i in range(1400)) + " tail one two"
    d = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    old, q.SEARCH = q.SEARCH, 10
    try:
        assert q.text_metrics(d).first().n_repeat_words == 1400
    finally:
        q.SEARCH = old


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_dedup(docs, empty, sample, width, num):
    from cadenza.llm.near_dedup import near_dedup

    # Row -8 repeats id 3; ids are unique by text here.
    items = [(i, shingles(t, width)) for i, t, *_ in sample if i is not None]
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = near_dedup(docs, width=width, threshold=num / 100).collect()
    assert len(got) == len(sample)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id), r
            assert r.n_shingles == len(dict(items)[r.doc_id])
    assert near_dedup(empty).collect() == []


def test_near_dedup_open_lists(spark, monkeypatch):
    """Many near copies without a common centre: lists stay open and are compared in blocks."""
    import random

    from cadenza.llm import near_dedup as nd

    monkeypatch.setattr(nd, "OPEN_LIST", 8)
    monkeypatch.setattr(nd, "BLOCK", 16)
    compared = []
    monkeypatch.setattr(nd, "_blocks", lambda rows, f=nd._blocks: compared.append(rows.count()) or f(rows))
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 3) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, threshold=0.85).collect()}
    assert got == {i: find(i) for i in sets}


def test_near_dedup_long_list(spark, monkeypatch):
    """Thousands of form letters that share most of a base and are no links: hardly any is compared in blocks."""
    import random

    from cadenza.llm import near_dedup as nd

    compared = []
    monkeypatch.setattr(nd, "_blocks", lambda rows, f=nd._blocks: compared.append(rows.count()) or f(rows))
    rng = random.Random(6)
    base, rows, want = [f"b{i}" for i in range(120)], [], {}
    for i in range(2500):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(7, 14)):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
        want[i] = i
        if i % 10 == 0:  # a copy that differs in one more word
            w[rng.randrange(120)] = f"m{i}"
            rows.append((10_000 + i, " ".join(w)))
            want[10_000 + i] = i
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, threshold=0.85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert sum(compared) < 1000


def test_near_dedup_rows(spark):
    """Rows that share an id, or have none, are judged by their own text."""
    import random

    from cadenza.llm.near_dedup import near_dedup

    a, b, c = (" ".join(f"{x}{random.Random(x).random()}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (3, a + " more"), (3, b), (None, b + " more"), (None, c), (None, c), (None, None), (None, "")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), text_hash=True).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(1, 1, True), (3, 1, False), (3, 3, True), (None, 3, False), (None, None, True), (None, None, True), (None, None, True), (None, None, True)])
    assert sum(r.stays for r in got) == 5  # a, b, c, null and empty


def test_components(spark):
    from cadenza.llm.common import components

    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_random_links(spark):
    """Chains, cycles, hubs, trees, repeated and turned links, a link to itself and null ends, against union-find."""
    import random

    from cadenza.llm.common import components

    rnd = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 140 - k) for k in range(39)] + [(200 + k, 200 + (k + 1) % 7) for k in range(7)]
    links += [(299, 300 + k) for k in range(30)] + [(330, 300 + k) for k in range(30)] + [(400, 400), (401, 400), (400, 401), (401, 400), (None, 5), (6, None)]
    links += [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(140)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len(root)
    assert {r["node"]: r["component"] for r in rows} == {x: top(x) for x in root}


def test_substring_dedup(docs, empty, sample):
    from cadenza.llm.substring_dedup import substring_dedup

    seen = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in sample]
    low = -(2**63)
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            seen[key] = min(seen.get(key, 1 << 62), low if i is None else i)
    want = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < (low if i is None else i):
                gone |= set(range(k, k + 13))
        want[(i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    got = substring_dedup(docs, 13).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
    assert substring_dedup(empty).collect() == []


def test_suffix_dedup(docs, empty, sample):
    from cadenza.llm.suffix_dedup import suffix_dedup

    raw = [(i, (t or "").encode()) for i, t, *_ in sample]
    c = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if c[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))] += 1
    got = suffix_dedup(docs, 200).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
    assert suffix_dedup(empty).collect() == []


@pytest.mark.parametrize("name", ["substring", "suffix"])
def test_shared_passage_in_many_contexts(spark, monkeypatch, name):
    """A hot minimiser's segments do not meet in one group, and the results are those of brute force."""
    import random

    from cadenza.llm import substring_dedup, suffix_dedup, windows

    monkeypatch.setattr(windows, "HOT", 150)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, near = [word() for _ in range(60)], [word() for _ in range(12)]
    texts = []
    for i in range(1600):
        after = near[: rng.randrange(12)] if i % 5 == 0 else []
        texts.append(" ".join([*(word() for _ in range(20)), *passage, *after, *(word() for _ in range(20))]))
    texts += texts[:40]
    line = " ".join(word() for _ in range(14))
    texts += [f"{word()} {' '.join([line] * 30)} {word()}" for _ in range(20)]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    module, width = {"substring": (substring_dedup, 13), "suffix": (suffix_dedup, 200)}[name]
    rows = windows.rows_of(docs, "doc_id", "text")
    within = name == "suffix"
    found = windows.repeated_runs(rows, module._symbols, width, module.GRAM, module.LONGEST, within)
    sent = windows.segments(rows, found, module._pieces, width, within).where("times > 0")
    assert max(r["count"] for r in sent.groupBy("key").count().collect()) < 450  # 1477 and 1600 where no key is hot
    items = [(-(2**63) if i % 50 == 0 else i, t.encode().split() if name == "substring" else t.encode()) for i, t in enumerate(texts)]
    seen = defaultdict(list)
    for i, x in items:
        for k in range(len(x) - width + 1):
            seen[tuple(x[k : k + width]) if name == "substring" else x[k : k + width]].append(i)
    least = {k: min(v) for k, v in seen.items()}
    want = Counter()
    for i, x in items:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - width + 1):
            w = tuple(x[k : k + width]) if name == "substring" else x[k : k + width]
            if least[w] < i if name == "substring" else len(seen[w]) > 1:
                gone[k : k + width] = True
        left = b" ".join(w for w, g in zip(x, gone) if not g) if name == "substring" else bytes(c for c, g in zip(x, gone) if not g)
        want[(None if i < 0 else i, int(gone.sum()), sha(left))] += 1
    run = substring_dedup.substring_dedup if name == "substring" else suffix_dedup.suffix_dedup
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in run(docs, width).collect()) == want


def test_automata_decide(spark):
    """Where copies meet in no batch, every removal is an automaton's."""
    import random

    import pandas as pd

    from cadenza.llm import substring_dedup as sd
    from cadenza.llm import windows

    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    texts = [*base, *base, *(x[:200] + " new " + x[200:] for x in base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = windows.rows_of(docs, "doc_id", "text")
        found = windows.repeated_runs(rows, sd._symbols, 13, sd.GRAM, sd.LONGEST, False)
        sent = windows.segments(rows, found, sd._pieces, 13, False).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (sent["times"] == 1).all()  # nothing was folded
    ranges = sd.shard_repeats(sent.sort_values("key", ignore_index=True), 13)
    got = {(r.did, r.start + k) for r in ranges.itertuples() for k in range(r.n)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        w = t.split()
        own = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        want |= {(i, k) for k, x in enumerate(own) if x in seen}
        seen |= set(own)
    assert got == want and len(want) > 4000
    sure = pd.DataFrame([[7, 8, 0, 0, 0, 0, None, np.array([3, 4, 9, 1], np.int32).tobytes()]], columns=windows.COLUMNS)
    (counts, ranges), (_, shard) = windows.shards(iter([sure, sent]))
    assert not counts and ranges.to_numpy().tolist() == [[7, 8, 3, 4], [7, 8, 9, 1]] and len(shard) == len(sent)


@pytest.mark.parametrize("width", [7, 251])
def test_widths(docs, width):
    from cadenza.llm.substring_dedup import substring_dedup
    from cadenza.llm.suffix_dedup import suffix_dedup

    for f in (substring_dedup, suffix_dedup):
        with pytest.raises(ValueError):
            f(docs, width)


def test_collection_transform():
    import random

    from cadenza.llm.suffix_dedup import repeats_by_bwt

    rng = random.Random(3)
    for trial in range(60):
        letters, width = (b"ab", b"abcdef")[trial % 2], rng.choice([2, 3, 5])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        c = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
        for t, flags in zip(texts, repeats_by_bwt(texts, width)):
            assert flags.tolist() == [c[t[i : i + width]] > 1 for i in range(len(t) - width + 1)]


def test_suffix_automaton():
    import random

    from cadenza.llm.substring_dedup import SuffixAutomaton

    rng = random.Random(4)
    for _ in range(60):
        width = rng.choice([2, 3])
        seqs = [[rng.randrange(3) for _ in range(rng.randint(width, 20))] for _ in range(rng.randint(1, 8))]
        own = [rng.randrange(5) for _ in seqs]
        a = SuffixAutomaton()
        for s, o in zip(seqs, own):
            a.add(s, o)
        a.close()
        for s, o in zip(seqs, own):
            least = [min(p for z, p in zip(seqs, own) if any(z[j : j + width] == s[i : i + width] for j in range(len(z)))) for i in range(len(s) - width + 1)]
            assert a.earlier(s, o, width).tolist() == [x < o for x in least]


def test_packing(docs, empty, sample):
    from tokenizers import Tokenizer

    from cadenza.llm.packing import best_fit_packing, packing_plan

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x, *_ in sample:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = best_fit_packing(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
        assert sum(n for _, n in v) <= 2048
    assert best_fit_packing(empty, path).collect() == []
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 2049, 20_000), return_counts=True))}
    plan, bins = packing_plan(counts, 2048)
    assert bins <= math.ceil(sum(k * n for k, n in counts.items()) / 2048) * 1.01
    for k, n in counts.items():
        spans = sorted((a, b) for x, a, b, *_ in plan.tolist() if x == k)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    assert packing_plan({}, 2048)[1] == 0


def test_bpe(docs, empty, sample):
    from tokenizers import Tokenizer

    from cadenza.llm.bpe import bpe_decode, bpe_digests, bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for i, x, *_ in sample:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, bpe_digests(docs, path).collect())) == want
    assert bpe_digests(empty, path).collect() == []
    back = bpe_decode(bpe_encode(docs, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, x or "") for i, x, *_ in sample)


def test_bpe_long_words():
    """Long unbroken words against the library; the time grows no faster than n log n."""
    import random
    import time

    from tokenizers import Tokenizer

    from cadenza.llm.bpe import Vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    with open(path, encoding="utf-8") as f:
        v = Vocabulary(f.read())
    rng = random.Random(8)
    words = ["x" * 5_000, "ab" * 700, "".join(rng.choice("aeinorst") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(2_000))]
    words += ["".join(rng.choice("aeht") for _ in range(n)) for n in (1, 2, 511, 512, 513, 514)]
    for w, got in zip(words, v.merge([w.encode() for w in words]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(w, add_special_tokens=False).ids
    took = []
    for n in (50_000, 1_000_000):
        w = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=n))
        start = time.monotonic()
        v.merge([w])
        took.append(time.monotonic() - start)
    assert took[1] < 60 * took[0]


def test_transducer():
    from cadenza.llm.bpe import Lexicon, compile_lexicon, pack_arrays

    words = {w.encode(): bytes([i, 0, 0, 0]) for i, w in enumerate(["a", "ab", "tap", "taps", "top", "tops", "é", "stop"])}
    lex = Lexicon(pack_arrays(compile_lexicon(words)))
    names = [*words, b"", b"t", b"tapss", b"zz", b"x" * 90]
    assert [lex.ids(k) if k >= 0 else None for k in lex.numbers(names).tolist()] == [*words.values(), None, None, None, None, None]
    assert len(lex.a["arc"]) < sum(map(len, words))  # suffixes are shared
    assert Lexicon(pack_arrays(compile_lexicon({}))).numbers([b"a"]).tolist() == [-1]


def held(mod, at):
    from cadenza.llm.common import crc_of_id

    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(mod)) == at


def labelled(spark):
    import random

    from tests.llm.conftest import words

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        toxic, bad = i % 5 == 0, i % 3 == 0
        w = words(rng, 60).split()
        if toxic:
            for k in range(0, 60, 11):
                w[k] = rng.choice(["nasty", "rotten", "vile"])
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (1000, None, None)], "doc_id long, quality int, toxic int")


def test_quality_model(spark, docs, empty):
    from cadenza.llm.quality_model import quality_scores

    d, labels = labelled(spark)
    got = quality_scores(d, labels, held(5, 0)).join(labels, "doc_id", "left").collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.quality is not None]
    assert len(out) > 30 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality_scores(docs, labels, held(5, 0)).count() == docs.count()
    assert quality_scores(empty, labels, held(5, 0)).collect() == []


def test_toxicity(spark, docs, empty):
    from cadenza.llm.toxicity import toxicity_scores

    d, labels = labelled(spark)
    got = toxicity_scores(d, labels, held(3, 1)).join(labels, "doc_id", "left").collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.toxic is not None]
    assert len(out) > 60 and sum(r.predicted == r.toxic for r in out) >= 0.95 * len(out)
    assert toxicity_scores(docs, labels, held(3, 1)).count() == docs.count()
    assert toxicity_scores(empty, labels, held(3, 1)).collect() == []


def scores_by_text(got, sample):
    """The scores of each text; a null text counts as empty."""
    texts, out = {}, {}
    for i, t, *_ in sample:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        (t,) = texts[r.doc_id]
        out.setdefault(t, set()).add(r.score)
    return out


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scores_of_awkward_rows(spark, docs, sample, name):
    from cadenza.llm.quality_model import quality_scores
    from cadenza.llm.toxicity import toxicity_scores

    score, mod = (quality_scores, (5, 0)) if name == "quality" else (toxicity_scores, (3, 1))
    got = score(docs, labelled(spark)[1], held(*mod)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in sample)
    by = scores_by_text(got, sample)
    # Null, empty and repeated texts get one score each, whatever their row.
    assert all(len(x) == 1 and 0 <= min(x) <= 1 for x in by.values()) and "" in by
    assert all(r.held_out is False for r in got if r.doc_id is None)


def test_discriminant_brute_force(spark):
    from cadenza.llm import quality_model as Q

    d, labels = labelled(spark)
    got = {r.doc_id: r.score for r in Q.quality_scores(d, labels, held(5, 0)).collect()}
    texts, known = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    x = {i: Q.statistics(t) for i, t in texts.items()}
    of = {k: np.stack([x[i] for i, q in known.items() if q == k and zlib.crc32(str(i).encode()) % 5]) for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in of.items()}
    n = {k: len(v) for k, v in of.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    pooled = pooled * np.where(np.eye(len(pooled), dtype=bool), 1, 1 - Q.DIAGONAL)
    full = {k: (1 - Q.POOLED) * cov[k] + Q.POOLED * pooled + Q.FLOOR**2 * np.eye(len(pooled)) for k in cov}

    def density(v, k):
        away = v - of[k].mean(0)
        return np.log(n[k] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(full[k])[1] - 0.5 * away @ np.linalg.solve(full[k], away)

    for i, v in x.items():
        odds = np.clip(density(v, 1) - density(v, 0), -500, 500)
        assert abs(got[i] - 1 / (1 + np.exp(-odds))) < 1e-6


def test_trees_brute_force(monkeypatch):
    from cadenza.llm import toxicity as T

    monkeypatch.setattr(T, "TREES", 4)
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(400, 3)), rng.integers(0, 3, 400), np.zeros(400)]
    y = (x[:, 0] + (x[:, 3] == 2) + rng.normal(0, 0.5, 400) > 0.5).astype(float)
    model = T.Trees(x, y)

    def leaf(g, h):
        return g.sum() ** 2 / (h.sum() + 1)

    def grow(rows, g, h, depth):
        """Step of each row: every threshold of every feature is tried on the values themselves."""
        best, side = 1e-3, None
        for j, edges in enumerate(model.edges if depth < T.DEPTH else []):
            for e in edges:
                right = x[rows, j] >= e
                if min(right.sum(), (~right).sum()) >= T.LEAF:
                    gain = leaf(g[rows][right], h[rows][right]) + leaf(g[rows][~right], h[rows][~right]) - leaf(g[rows], h[rows])
                    if gain > best + 1e-12:
                        best, side = gain, right
        if side is None:
            return [(rows, T.RATE * g[rows].sum() / (h[rows].sum() + 1))]
        return grow(rows[~side], g, h, depth + 1) + grow(rows[side], g, h, depth + 1)

    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(4):
        p = 1 / (1 + np.exp(-f))
        for rows, step in grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-6), 0):
            f[rows] += step
    assert np.abs(model.margin(x) - f).max() < 1e-9


def test_isotonic_and_disguise():
    from cadenza.llm.toxicity import isotonic, plain

    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]
    assert plain(b"l0ser!") == (b"loser", True)
    assert plain(b"word,") == (b"word", False)


def test_language_id(spark, docs, empty):
    import random

    from cadenza.llm.language_id import language_id

    rng = random.Random(1)
    parts = {"aa": ["ka", "ko", "ki", "tu"], "bb": ["sche", "bren", "stal", "gor"], "cc": ["ção", "nho", "lhe", "vez"]}
    rows = []
    for i in range(150):
        x = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(50)), x))
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "", None), (903, "\u00bd \u00b2 \u2163 \u2460", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(d, held(3, 1), words=True).collect()}
    out = [i for i, _, _ in rows if got[i].held_out]
    assert len(out) > 30 and sum(got[i].lang_pred == rows[i][2] for i in out) >= 0.98 * len(out)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (900, 901, 902, 903))
    mixed = spark.createDataFrame([(i, t, x) for i, t, x in rows if i % 3 != 0] + [(5000, rows[1][1] + " " + rows[2][1], None)], "doc_id long, text string, lang string")
    r = language_id(mixed, held(3, 1), words=True).where("doc_id = 5000").first()
    assert r.langs[:45].count("bb") >= 43 and r.langs[55:].count("cc") >= 43
    assert language_id(docs, held(3, 1)).count() == docs.count()
    assert language_id(empty, held(3, 1)).collect() == []


def test_long_runs_of_letters():
    from cadenza.llm.language_id import _LETTERS, LONGEST

    assert _LETTERS.findall("\u4e00" * 60) == ["\u4e00" * LONGEST, "\u4e00" * LONGEST, "\u4e00" * (60 - 2 * LONGEST)]
    assert _LETTERS.findall("ab\u00bdc1d_e \u2163") == ["ab", "c", "d", "e"]


def test_words_and_features_of_language_id():
    import time
    from zlib import crc32

    from cadenza.llm.language_id import _LETTERS, BUCKETS, word_features, words_of

    for t in ("", "ab\u00bdc1d_e \u2163 \u00b2x \U0001f600y", "a\U00010107b \u4e00\u4e8c\U0001f600", "\u00e9t\u00e9 na\u00efve \u0660x \U0001d7d8z\U0001f100q", "x" * 60):
        assert words_of(t) == _LETTERS.findall(t)
    for w in ("a", "ab", "na\u00efve", "\u0130i", "aaaaaa", "\u4e00" * 24):
        e = f"^{w.lower()}$"
        names = {"=" + w.lower(), *(f"<{w.lower()[:k]}" for k in (1, 2, 3)), *(f">{w.lower()[-k:]}" for k in (1, 2, 3)), *(e[i : i + n] for n in (1, 2, 3) for i in range(len(e) - n + 1))}
        assert list(word_features(w)) == [crc32(x.encode()) % BUCKETS for x in sorted(names)]

    def took(find, text):
        began = time.process_time()
        find(text)
        return time.process_time() - began

    for text in ("the quick brown fox " * 20_000, "l'\u00e9t\u00e9 \U0001f600 \u00bd na\u00efve " * 20_000):
        assert min(took(words_of, text) for _ in range(3)) < min(took(_LETTERS.findall, text) for _ in range(3)) / 3



def test_pipeline_rows(spark):
    """A row goes by its id and text: copies under a kept id go, and null ids do not protect each other."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *r: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in r], schema)
    got = cp.drop_copies(spark, rows((1, "x y"), (3, "other text"), (3, "x y"), (None, "x y"), (None, "third"), (None, "third")), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "x y"), (3, "other text"), (None, "third")])
    long = " ".join(f"word{i}" for i in range(80))
    got = cp.drop_near_copies(spark, rows((1, long), (3, "other text"), (3, long + " more"), (None, long + " x"), (None, "third")), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, long), (3, "other text"), (None, "third")])


def test_forward_backward():
    import itertools

    from cadenza.llm.language_id import BUCKETS, Tagger, forward_backward, posteriors

    rng = np.random.default_rng(0)
    k, lengths = 3, [1, 5, 32, 33, 70]
    t = Tagger(list("abc"), np.zeros((BUCKETS, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(sum(lengths), k)) * 2
    got, at = posteriors(scores, np.repeat(np.arange(len(lengths)), lengths), t), 0
    for n in lengths:
        post, _, _ = forward_backward(scores[None, at : at + n], t.transition, t.start, np.array([n]))
        assert np.allclose(post[0], got[at : at + n], atol=1e-8)
        at += n
    x, total = scores[:4], np.zeros((4, k))
    for ys in itertools.product(range(k), repeat=4):
        v = np.exp(t.start[ys[0]] + sum(x[i, ys[i]] for i in range(4)) + sum(t.transition[ys[i], ys[i + 1]] for i in range(3)))
        for i in range(4):
            total[i, ys[i]] += v
    assert np.allclose(forward_backward(x[None], t.transition, t.start, np.array([4]))[0][0], total / total.sum(1, keepdims=True))


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as cp
    from cadenza.llm.common import cut
    from cadenza.llm.exact_dedup import exact_dedup
    from cadenza.llm.near_dedup import near_dedup
    from cadenza.llm.suffix_dedup import suffix_dedup

    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    now = docs
    for i, (_, stage) in enumerate(cp.STAGES):
        before, now = now, cut(stage(spark, now, ""))
        if i < 4:
            assert now.columns == cp.COLUMNS
        if i == 0:
            gone = {r.text for r in before.collect()} - {r.text for r in now.collect()}
            assert gone <= {None, "", "  \n\t", "..."} and None in gone
        if i == 1:
            assert sorted((r.doc_id or -9) for r in now.collect()) == sorted((r.doc_id or -9) for r in exact_dedup(before).where("kept").collect())
        if i == 2:
            assert Counter(r.doc_id for r in now.collect()) == Counter(r.doc_id for r in near_dedup(before, text_hash=True).where("stays").collect())
        if i == 3:
            want = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup(before).collect()}
            assert {r.doc_id: len(r.text.encode()) for r in now.collect()} == want
            assert {(r.doc_id, r.lang, r.source) for r in now.collect()} == {(r.doc_id, r.lang, r.source) for r in before.collect()}
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
    now = empty
    for _, stage in cp.STAGES:
        now = cut(stage(spark, now, ""))
    assert now.count() == 0


def test_a_worker_keeps_one_operators_caches():
    import pandas as pd

    from cadenza.llm import language_id as L
    from cadenza.llm import near_dedup as N
    from cadenza.llm import suffix_dedup as S

    class Model:
        value = L.train(["ab ba abba"] * 3, ["x", "y", "x"])

    rows = pd.DataFrame({"doc_id": [1], "text": ["ab zz"], "text_hash": [0]})
    found = [list(L._labelled(Model, False)(iter([rows]))) for _ in range(2)]
    assert found[0][0].equals(found[1][0]) and len(L._state["rows"]) == 2 and L._bucket_of
    N.shingle_set("ab zz ab", 2)
    assert not L._state and not L._bucket_of and len(N._hash_of) == 2
    assert list(N._sketches(2, 0.8)(iter([rows])))[0]["sketch"][0].base is None
    S._symbols("ab")
    assert not N._hash_of
    assert list(L._labelled(Model, False)(iter([rows])))[0].equals(found[0][0])


def test_packing_encodes_words_by_their_parts():
    """Ids of odd words are the library's; common words do not go through its whole path, nor once for each mark."""
    import random

    from tokenizers import Tokenizer

    from cadenza.llm.packing import _LETTERS, _Ids, _Words

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sent = []

    class Counted:
        normalizer, pre_tokenizer, model = plain.normalizer, plain.pre_tokenizer, plain.model

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **kw)

    rng = random.Random(11)
    some = [*_LETTERS[::9], *"abcst'.,<|>!7_-", *"İ̸́Kς一 ​\x1cͅ\U0001f600"]
    odd = ["".join(rng.choices(some, k=rng.randrange(1, 9))) for _ in range(20_000)] + ["<|endoftext|>", "a<|endoftext|>,", "\u0130,", "don't.", "x's!'s"]
    words = [w.encode() for w in odd]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(odd, add_special_tokens=False)]
    assert _Words(plain).encode(words) == want
    ids = _Ids()
    ids.fill({f"{w}{m}".encode() for w in ("house", "señor", "Über", "straße") for m in ("", ".", ",", "!!", ".$$$")}, _Words(Counted()))
    assert sorted(sent) == sorted([".", ",", "!!", ".$$$"])
    assert len(ids) == 20


def test_word_hashes_of_substring_dedup(monkeypatch):
    """A word's hash is the same at all places of all blocks and another word's differs; no word is hashed by itself
    but one beyond a block, and a worker keeps none."""
    import random

    from cadenza.llm import near_dedup as N
    from cadenza.llm import substring_dedup as D

    rng = random.Random(4)
    known = [*map(chr, range(33, 127)), "ab", "ba", "aab", "aba", "é", "é", "a\xa0b", "a\x1cb", "\x00", "\x00\x00", *("".join(rng.choices("abé", k=rng.randrange(3, 30))) for _ in range(200))]
    alone = {w: int(D._symbols(w)[0]) for w in known}
    assert len(set(alone.values())) == len(alone) and len({h & (1 << 40) - 1 for h in alone.values()}) == len(alone)
    text = "".join(rng.choice(["", " "]) + w + rng.choice([" ", "\n", "\t \v", "\f\r"]) for w in rng.choices(known, k=20_000))
    words = [w.decode() for w in text.encode().split()]
    assert len(text.encode()) > 3 * D.BLOCK
    digests = []
    monkeypatch.setattr(D, "blake2b", lambda *a, **kw: digests.append(a) or hashlib.blake2b(*a, **kw))
    N._hash_of.clear()
    assert D._symbols(text).tolist() == [alone[w] for w in words]
    assert not digests and not N._hash_of
    long = "x" * D.BLOCK
    got = D._symbols(f"{long}y ab {long} {long}y{'z' * 40} ba {long}y").tolist()
    assert got[1::3] == [alone["ab"], alone["ba"]] and got[0] == got[5] and len(set(got)) == 5 and len(digests) == 3
    assert D._symbols("").tolist() == D._symbols(" \n").tolist() == []


def test_near_dedup_and_the_pipeline_take_batches_of_bounded_bytes(spark, monkeypatch):
    """An Arrow batch of 10,000 texts, or of pairs of texts, is held by the executor beside its heap."""
    import corpus_pipeline as cp
    from cadenza.llm import language_id as L
    from cadenza.llm import near_dedup as N

    def bounded(make):
        def made(*args):
            run = make(*args)

            def checked(batches):
                for b in batches:
                    if b["text"].str.len().sum() > 5 << 20:
                        raise ValueError("a batch of too many bytes")
                    yield from run(iter([b]))

            return checked

        return made

    monkeypatch.setattr(N, "_sketches", bounded(N._sketches))
    monkeypatch.setattr(L, "_labelled", bounded(L._labelled))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    made = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(translate(id, '0123456789', 'abcdefghij'), 'x y '), 6000)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    assert N.near_dedup(made).where("kept").count() == 300
    assert cp.identify_language(spark, made, "").count() == 300
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_language_id_labels_long_texts_few_at_a_time(monkeypatch):
    import pandas as pd

    from cadenza.llm import language_id as L

    class Model:
        value = L.train(["ab ba abba"] * 3 + ["cd dc cddc"] * 3, ["x"] * 3 + ["y"] * 3)

    rows = pd.DataFrame({"doc_id": range(42), "text": [("ab cd ba "[i % 3 :]) * 20_000 for i in range(40)] + [None, "cd"]})
    plain, most = L.posteriors, []
    monkeypatch.setattr(L, "posteriors", lambda scores, *more: most.append(len(scores)) or plain(scores, *more))
    got = pd.concat(L._labelled(Model, False)(iter([rows])))
    assert max(most) <= L.CHARS // 2
    alone = pd.concat(L._labelled(Model, False)(rows.iloc[[i]] for i in range(len(rows))))
    assert got["doc_id"].tolist() == list(range(42)) and got["lang_pred"].tolist() == alone["lang_pred"].tolist() and np.allclose(got["score"], alone["score"])
