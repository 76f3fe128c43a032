import random

import pytest

WORDS = "the of and green stone river café naïve straße 日本 42 x".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with further columns, some of whose names operators use
    themselves."""
    def make(texts, first=0, ids=None):
        ids = ids if ids is not None else range(first, first + len(texts))
        rows = [(i, t, "en", f"s{k % 3}", len(t or ""), k, "x", None)
                for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, row long, copy string, "
                  "rest string")
    return make


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [None, "", " ", "a", "A b\tC\nd", "ab" * 40_000, "word " * 5_000, "Ünï çødé 😀 ▁x  ", "\x00\x1f ", "x" * 99, "y" * 100]
