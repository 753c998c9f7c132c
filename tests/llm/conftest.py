import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture
def words():
    """Random words from a seed."""

    def make(n, seed, size=2000):
        draw = random.Random(seed)
        vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 9))) for _ in range(size)]
        return [draw.choice(vocabulary) for _ in range(n)]

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and white texts, ties, repeated rows, a very long text, and one of every plane."""
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000))
    return docs((1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, None, None, None), (None, "null key text here now"), (5, "same text of several words."), (6, "same text of several words."),
                (7, long), (8, "naïve 日本語 😀 x\x00y"), (9, "!!! ... ###"), (10, "a b", None, None))
