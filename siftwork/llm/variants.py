"""Spelling variants: words one inserted, deleted or replaced code point apart.

Two words that are one edit apart agree on a whole half of either: the first
``len // 2`` code points, or the rest.  So each word is searched twice, in a search
scheme that matches one half exactly, from its end of the word, and extends across
the other half allowing one error.  The index of a search is an FM-index over the
delimited vocabulary: suffix ranks of ``word$word$...``, whose intervals are
extended code point by code point.  One runs right to left and one, over the
reversed words, left to right; a half is anchored at a delimiter, so a search never
changes its direction and needs the interval of its own direction only.

The vocabulary may be of any size.  Words meet in shards by their exact half: a
word is put where it can be found (under the halves that words one shorter, as
long, and one longer would ask for) and where it asks.  A shard has a bounded
number of words; a half that more words share is dealt as tiles, each word into a
row of tiles where it asks and a column where it is found.  What leaves a shard is
one row per asking word, not pairs.

Defined results: null texts have no words; a null or empty word, and a word with a
null count, is left out; a repeated word's counts are added; ties of count go to the
smallest word in code-point order; an empty table gives an empty result.  Only the
columns named are read, so further ones may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import UPPER, saved, small_enough

#: Rows of a shard, on average; also the most words that ask, or are found, in a tile.
SHARD_ROWS = 1 << 16
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it hands them on.
_HELD = 1 << 18
_LOWER = str.maketrans(UPPER, UPPER.lower())

_ANSWER = "word string, n_near long, best struct<less:long,form:string>"


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None, least: int = 1) -> DataFrame:
    """(word, n) of the letter runs of ``least`` or more code points, lower-cased (A-Z).  ``change`` makes
    the word of a document's id and a run."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches):
        totals = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for run, n in Counter(pattern.findall(text or "")).items():
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    totals[change(doc_id, run) if change else run] += n
                if len(totals) > _HELD:
                    yield _counts(totals)
                    totals = Counter()
        if totals:
            yield _counts(totals)

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(totals: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(totals.keys(), pa.string()), "n": pa.array(totals.values(), pa.int64())})


class WordIndex:
    """FM-index over delimited words, searched from the words' ends leftwards."""

    def __init__(self, words: list[str]):
        self.letters, text = np.unique(_codes(words), return_inverse=True)  # the delimiter is 0
        self.size, longest = len(text), max(map(len, words))
        order, rank, span = np.argsort(text, kind="stable"), text.astype(np.int64), 1
        while span < longest + 2:  # ranks by the first 2, 4, 8, ... symbols of each rotation
            pair = rank * self.size + np.roll(rank, -span)
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            rank = np.empty(self.size, np.int64)
            rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
            span *= 2
        self.before = text[order - 1].astype(np.int64)
        self.places = np.sort(self.before * self.size + np.arange(self.size))
        # Rotations that start with a delimiter come first, one for each word behind it.
        starts = np.append(0, np.cumsum([len(w) + 1 for w in words])[:-1])
        self.count = len(words)
        self.word_at = np.searchsorted(starts, (order[:self.count] + 1) % self.size)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of code points; one that no word has gets a number past all."""
        at = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == codes
        return np.where(known, at, len(self.letters)).astype(np.int64)

    def extend(self, lo, hi, symbol):
        """Rank intervals of symbol + pattern, from those of the pattern."""
        base = symbol * self.size
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def extensions(self, lo, hi):
        """All symbols before the rows of each interval: (interval number, symbol, lo, hi).  Equal
        intervals are listed once and others are apart, so this reads no row twice."""
        firsts, at, back = np.unique(lo, return_index=True, return_inverse=True)
        width = hi[at] - firsts
        owner = np.repeat(np.arange(len(firsts)), width)
        rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + firsts[owner]
        base = len(self.letters) + 1
        kinds = np.unique(owner * base + self.before[rows])
        owner, symbol = kinds // base, kinds % base
        lows, highs = self.extend(firsts[owner], hi[at][owner], symbol)
        n = np.bincount(owner, minlength=len(firsts))
        pick, who = _ranges((np.cumsum(n) - n)[back], n[back])
        return who, symbol[pick], lows[pick], highs[pick]

    def one_error(self, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of an asked word, number of an indexed word) for all that differ by exactly one code
        point, none of it in the last ``exact`` code points.  A change that several edits give is made
        by the leftmost deletion of a run of equals, and by an insertion before a different one."""
        text = self.symbols(_codes(asked))
        size = np.array([len(w) for w in asked])
        last = np.cumsum(size + 1) - 2

        def want(who, t):
            return text[last[who] - t]  # the delimiter (of the word before) at t = size

        who = np.arange(len(asked))
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), self.count)
        spent = [np.zeros(0, np.int64)] * 3
        found = []
        for t in range(int(size.max()) + 1):
            ahead = []
            split = np.flatnonzero(t >= exact[who])
            if len(split):
                w, left = who[split], size[who[split]] > t
                i, symbol, low, high = self.extensions(lo[split], hi[split])
                other = (symbol != 0) & (symbol != want(w[i], t))
                i, low, high = i[other], low[other], high[other]
                spent = [np.append(a, b) for a, b in zip(spent, (w[i], low, high), strict=True)]
                sub = left[i]
                ahead.append((w[i][sub], low[sub], high[sub]))
                cut = np.flatnonzero(left)
                cut = cut[want(w[cut], t) != want(w[cut], t + 1)]
                ahead.append((w[cut], lo[split][cut], hi[split][cut]))
            if len(spent[0]):
                low, high = self.extend(spent[1], spent[2], want(spent[0], t))
                alive = low < high
                w, low, high = spent[0][alive], low[alive], high[alive]
                whole = size[w] == t
                found.append((w[whole], self.word_at[low[whole]]))
                ahead.append((w[~whole], low[~whole], high[~whole]))
            spent = [np.concatenate(c) for c in zip(*ahead, strict=True)] if ahead else spent
            on = size[who] > t
            who, lo, hi = who[on], lo[on], hi[on]
            lo, hi = self.extend(lo, hi, want(who, t))
            on = lo < hi
            who, lo, hi = who[on], lo[on], hi[on]
            if not len(who) and not len(spent[0]):
                break
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _codes(words: list[str]) -> np.ndarray:
    """Code points of word + delimiter, for all words."""
    return np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of first .. first + size, and whose they are."""
    whose = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[whose], whose


def _searched(shard: pa.Table) -> pa.Table:
    """Near words of all that ask in a shard: their number, and the one of largest n."""
    backwards = shard["backwards"][0].as_py()
    rows = zip(shard["word"].to_pylist(), shard["n"].to_pylist(), shard["asks"].to_pylist(),
               shard["found"].to_pylist(), strict=True)
    asking, known = set(), {}
    for word, n, asks, found in rows:
        if asks:
            asking.add(word)
        if found:
            known[word] = n
    asked, words = sorted(asking), sorted(known)
    out = {"word": [], "n_near": [], "best": []}
    if asked and words:
        counts = np.array([known[w] for w in words])
        # Anchored at the end as it stands, or, reversed, at the start.
        turned = (lambda ws: ws) if backwards else (lambda ws: [w[::-1] for w in ws])
        exact = np.array([len(w) - len(w) // 2 if backwards else len(w) // 2 for w in asked])
        who, other = WordIndex(turned(words)).one_error(turned(asked), exact)
        if backwards and len(who):  # found from the start as well
            twice = np.array([words[b].startswith(asked[a][:len(asked[a]) // 2]) for a, b in zip(who, other, strict=True)])
            who, other = who[~twice], other[~twice]
        order = np.lexsort((other, -counts[other], who))
        who, other = who[order], other[order]
        each, first, near = np.unique(who, return_index=True, return_counts=True)
        out = {"word": [asked[a] for a in each], "n_near": near.tolist(),
               "best": [{"less": -int(counts[b]), "form": words[b]} for b in other[first]]}
    return pa.table(out, pa.schema([("word", pa.string()), ("n_near", pa.int64()),
                                    ("best", pa.struct([("less", pa.int64()), ("form", pa.string())]))]))


def _placed(words: DataFrame) -> DataFrame:
    """(backwards, half, word, n, asks): a row for each half under which a word asks or is found."""
    halves = []
    for backwards in (False, True):
        def half(n: Column, longer=backwards) -> Column:
            return (F.ceil(n / 2) if longer else F.floor(n / 2)).cast("int")
        size = F.length("word")
        of = F.array_distinct(F.array(half(size), half(size - 1), half(size + 1)))
        halves.append(words.select(F.lit(backwards).alias("backwards"), "word", "n", half(size).alias("own"),
                                   F.explode(of).alias("of")))
    rows = halves[0].unionByName(halves[1])
    text = F.when(F.col("backwards"), F.expr("right(word, of)")).otherwise(F.expr("left(word, of)"))
    # The half with its length, in 64 bits: a clash only lets more words meet.
    return rows.select("backwards", F.xxhash64("backwards", "of", text).alias("half"), "word", "n",
                       (F.col("own") == F.col("of")).alias("asks"))


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n_near, best) of the words that have near words; ``words`` is (word, n), each once."""
    rows = words.count()
    shards = max(1, math.ceil(4 * rows / shard_rows))
    placed = _placed(words)
    hot = saved(placed.groupBy("half").count().where(F.col("count") > shard_rows).select(
        "half", F.ceil(F.col("count") / shard_rows).cast("int").alias("tiles")))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if small_enough(n_hot, 32) else hot
        placed = placed.join(hot, "half", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    else:
        placed = placed.withColumn("tiles", F.lit(1))
    mine = F.pmod(F.xxhash64("word", F.lit(1)), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    found = placed.withColumns({"row": F.explode(every), "column": mine, "found": F.lit(True)})
    asks = placed.where("asks").withColumns({"row": mine, "column": F.explode(every), "found": F.lit(False)})
    whole = placed.where("tiles = 1").withColumns({"row": F.lit(0), "column": F.lit(0), "found": F.lit(True)})
    if n_hot:
        whole = whole.unionByName(found.where("tiles > 1").withColumn("asks", F.lit(False))).unionByName(
            asks.where("tiles > 1"))
    # A tile of a hot half is a shard of its own.
    shard = F.when(F.col("tiles") > 1, F.xxhash64("half", "row", "column")).otherwise(
        F.pmod(F.xxhash64("half"), F.lit(shards)))
    dealt = whole.select("backwards", shard.alias("shard"), "word", "n", "asks", "found")
    answers = dealt.groupBy("backwards", "shard").applyInArrow(_searched, _ANSWER)
    return answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of a vocabulary (word, n).

    ``form`` is the near word of largest n if that is ``ratio`` times the word's own or more; ``root``
    is where the forms lead."""
    words = saved(words.where((F.length("word") > 0) & F.col("n").isNotNull()).groupBy("word").agg(
        F.sum("n").cast("long").alias("n")))
    near = near_words(words, shard_rows)
    big = -F.col("best.less") >= ratio * F.col("n")
    known = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(big, F.col("best.form")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")))
    ends = _ends(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _ends(links: DataFrame) -> DataFrame:
    """Last word of each chain.  Counts grow along a chain by a factor, so it is short and without a
    circle; each round doubles the reach."""
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = saved(links.join(beyond, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.drop("moved")
