"""Token counts of byte-level BPE by dynamic programming over prefixes.

For every prefix of a word the table holds the last token of the prefix's own
encoding and the number of its tokens.  A token ``t`` ends the encoding of a
prefix exactly if the encoding before it ends in a token that stands next to
``t`` stably, that is, if their two byte strings joined encode to just the two.
So each prefix needs one look at its possible last tokens and no merge loop, and
all prefixes' counts come from one pass.  Words (the pieces that the pattern
cuts) repeat, so their tables and the verdicts on pairs are kept, within bounds.

Defined results: null is the empty text, with 0 tokens; strings of added tokens
count one each, as the tokenizer's default has it; nothing is truncated, and
rows are independent, so repeats and further columns don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import tokenizer_file

MODEL = "byte_bpe_50k.json"
LIMIT = 512
#: White space, as the tokenizer's pattern has it (fixed values).
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           rf"| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words, and half the pairs, kept by a worker.
KEPT = 400_000
_NONE = 1 << 60
#: Characters of text whose words are held at once.
AT_ONCE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary; ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        of = lambda token: bytes(letters[c] for c in token)
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        skip = set(self.added)
        vocab = sorted((v, of(k)) for k, v in spec["model"]["vocab"].items() if k not in skip)
        self.tokens = [b"", *(t for _, t in vocab)]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(of(a), of(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.stops = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding by its definition: the lowest merge first, leftmost first."""
        get = self.rank.get
        parts = [word[i:i + 1] for i in range(len(word))]
        ranks = [get(p, _NONE) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NONE)
        return parts

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, or the second alone, encode to themselves."""
        a, b = self.tokens[left] if left else b"", self.tokens[right]
        kept = self.merged(a + b) == ([a, b] if left else [b])
        if len(self.pairs) >= 2 * KEPT:
            self.pairs.clear()
        self.pairs[left << 32 | right] = kept
        return kept

    def _extend(self, word: bytes, last: list[int], counts: list[int]) -> None:
        """Carries the tables on from the prefix they hold to the whole word."""
        ids, pairs, most = self.ids, self.pairs, self.longest
        for i in range(len(last), len(word) + 1):
            for j in range(i - 1, max(0, i - most) - 1, -1):
                token = ids.get(word[j:i])
                if token is None:
                    continue
                stable = pairs.get(last[j] << 32 | token)
                if self._stable(last[j], token) if stable is None else stable:
                    last.append(token)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {i}")

    def prefix_counts(self, word: bytes) -> list[int]:
        """Entry i: tokens in the encoding of the first i bytes."""
        counts = [0]
        self._extend(word, [0], counts)
        return counts

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of new words, in order, so that each goes on from the table of
        the prefix that it shares with the one before."""
        found, before, last, counts = {}, b"", [0], [0]
        for word, raw in sorted((w.encode("utf-8", "replace"), w) for w in words):
            n = min(len(word), len(before))
            at = next((i for i in range(n) if word[i] != before[i]), n)
            del last[at + 1:], counts[at + 1:]
            self._extend(word, last, counts)
            found[raw], before = counts[-1], word
        return found

    def _stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between added tokens, and these."""
        at = 0
        for m in self.stops.finditer(text) if self.stops else ():
            if m.start() > at:
                yield text[at:m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Token counts of some texts, together of moderate size."""
        split, totals, new = [], [], set()
        for i, text in enumerate(texts):
            totals.append(0)
            for part, added in self._stretches(text or ""):
                if added:
                    totals[i] += 1
                else:
                    words = self.pattern.findall(part)
                    split.append((i, words))
                    new |= set(words).difference(self.words)
        older = self.older
        fresh = {w: older[w] for w in new if w in older}
        fresh |= self._learn(new - fresh.keys())
        self.words |= fresh
        for i, words in split:
            totals[i] += sum(map(self.words.__getitem__, words))
        if len(self.words) >= KEPT:  # what was used lately stays one round longer
            self.older, self.words = self.words, {}
        return totals

    def table(self, text: str | None) -> tuple[list[int], list[int]]:
        """Bytes and tokens of the whole text up to each byte position where a
        token ends (both ascending): what a budget of n tokens keeps is
        ``ends[n - 1]`` bytes, with no encoding again."""
        ends, base, tokens = [], 0, 0
        for part, added in self._stretches(text or ""):
            pieces = [part] if added else self.pattern.findall(part)
            for piece in pieces:
                raw = piece.encode("utf-8", "replace")
                if added:
                    ends.append(base + len(raw))
                else:
                    ends.extend(base + e for e in self.token_ends(raw))
                base += len(raw)
        return ends, list(range(1, len(ends) + 1))

    def token_ends(self, word: bytes) -> list[int]:
        """Where the word's tokens end, by walking the table backwards."""
        last = [0]
        self._extend(word, last, [0])
        ends, i = [], len(word)
        while i:
            ends.append(i)
            i -= len(self.tokens[last[i]])
        return ends[::-1]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One per Python worker; it outlives a task, as the worker does."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    path = tokenizer_file(model)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        of, out, some, size = counter(path).count_all, [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= AT_ONCE:
                out += of(some)
                some, size = [], 0
        return pd.Series(out + of(some), dtype="int64")

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                       count(text).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)


def within_budget(docs: DataFrame, budget: int, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, kept_bytes): how many bytes of each text its first
    ``budget`` tokens hold."""
    path = tokenizer_file(model)

    @F.pandas_udf("n_tokens long, kept_bytes long")
    def cut(texts: pd.Series) -> pd.DataFrame:
        of = counter(path).table
        ends = [of(t)[0] for t in texts]
        return pd.DataFrame({"n_tokens": [len(e) for e in ends],
                             "kept_bytes": [e[min(budget, len(e)) - 1] if e and budget > 0 else 0 for e in ends]})

    return docs.select("doc_id", cut("text").alias("c")).select("doc_id", "c.n_tokens", "c.kept_bytes")
