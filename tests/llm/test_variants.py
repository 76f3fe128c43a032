"""Spelling variants against comparison of all words, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwork.llm import queries, variants

from .conftest import ODD, prose


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i:] == b[i + 1:] if len(b) > len(a) else a[i + 1:] == b[i + 1:]


def plain(counts):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(others), form, counts[form] if form else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return sorted((w, *v, root(w)) for w, v in out.items())


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def words_of(rng, n, letters):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize("letters", ["ab", "abcé", "ab😀"])
def test_searches_equal_comparison(letters):
    rng = random.Random(len(letters))
    for _ in range(40):
        known, asked = sorted(words_of(rng, 50, letters)), sorted(words_of(rng, 50, letters + "z"))
        exact = np.array([(len(w) + 1) // 2 for w in asked])
        got = sorted(zip(*(x.tolist() for x in variants.WordIndex(known).one_error(asked, exact)), strict=True))
        assert got == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(known)
                             if near(a, b) and b.endswith(a[len(a) // 2:]))


@pytest.mark.parametrize("shard_rows", [variants.SHARD_ROWS, 40])
def test_variants_equal_comparison(spark, shard_rows):
    """Whole shards, and halves dealt as tiles."""
    rng = random.Random(5)
    counts = words_of(rng, 250, "ab") | words_of(rng, 100, "abcdé") | {
        "x" * 3000: 9, "x" * 3001: 2, "xy" * 700: 5, "xy" * 700 + "x": 11, "naïve": 8, "naive": 3, "naivee": 1}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, half string, row int")
    assert rows_of(variants.variants(df, shard_rows=shard_rows)) == plain(counts)


def test_odd_vocabularies(spark):
    odd = [(None, 3), ("", 4), ("a", None), ("green", 2), ("green", 3), ("greem", 1), ("b", 5), ("ab", 5), ("bc", 5)]
    got = rows_of(variants.variants(spark.createDataFrame(odd, "word string, n long")))
    assert got == plain({"green": 5, "greem": 1, "b": 5, "ab": 5, "bc": 5})
    assert rows_of(variants.variants(spark.createDataFrame([], "word string, n long"))) == []


def test_chain_of_forms(spark):
    chain = {"a" * (5 + i): 3 ** i for i in range(12)}
    got = {r.word: r.root for r in variants.variants(
        spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 16}


def test_query_equals_plain_python(spark, docs_of, tmp_path):
    rng = random.Random(9)
    words = "Green STONE rivér castle stones ÀÉbcde bridges×÷ over".split()
    texts = ODD + [prose(rng, 300, words) for _ in range(40)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            at = h % len(run)
            counts[run if h % 97 else run[:at] + run[at + 1:]] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert len(want) > 8 and rows_of(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == want
