import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, component_id string, did long, row string, key string, rank int, salt int, more int"
ODD = ("x", "y", "z", 1, "r", "k", 2, 3, 4)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows():
    """Copies, near copies, shared passages, repeats inside a text, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, 60 + i) for i in range(12)]
    shared = words(rng, 45)
    texts = [*base, base[0], base[0], base[1] + "  ", " " + base[1].replace(" ", "\n"), "A B. c"]
    for i in range(8):  # near copies of one text
        w = base[2].split()
        w[rng.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 30)} {shared} {words(rng, 20)}" for _ in range(4)]
    texts += ["ab " * 150, words(rng, 15) * 12, None, None, "", "", "  \n\t", "...", "one", "one two", "Ünïcödé \U0001f600 ñandú " * 15, words(rng, 25_000, 5_000), "x" * 5_000, "<|endoftext|> a  b", "l1 a b c\nl1 a b c\nl1 a b c\n" * 8]
    out = [(i, t, ("en", "de", None)[i % 3], (None, "s1")[i % 2], None if t is None else len(t), *ODD) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base[4], "en", "s1", 5, *ODD), (-7, base[5], None, None, None, *ODD)]


@pytest.fixture(scope="session")
def sample():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
