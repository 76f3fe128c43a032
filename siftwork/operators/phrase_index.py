"""Phrases of many queries held by a task; captions run past them, batch by batch.

The phrases are a trie over numbered tokens, kept as sorted arrays.  All positions of a
batch walk it at once, so the work of a batch is its tokens times the longest phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tokens, and candidates, that are looked at together.
STEP = 1 << 20


@dataclass(frozen=True)
class Trie:
    """Numbered phrases; ``forms`` are the words that stand for a token (of a stem, several)."""

    forms: pa.Array
    token: np.ndarray   # token of each form
    tokens: int
    keys: np.ndarray    # node * tokens + token, sorted
    after: np.ndarray   # the node that each key leads to
    ends: np.ndarray    # phrase that ends in a node, or -1
    inner: np.ndarray   # whether a node has children
    phrases: int

    @staticmethod
    def of(phrases: list[str], forms: list[tuple[str, str]] | None = None) -> Trie:
        """``forms``: (word, token) for each word that counts as a token; by default each as itself."""
        number: dict[str, int] = {}
        steps: dict[tuple[int, int], int] = {}
        ends = [-1]
        for k, phrase in enumerate(phrases):
            node = 0
            for part in phrase.split(" "):
                step = (node, number.setdefault(part, len(number)))
                if step not in steps:
                    steps[step] = len(ends)
                    ends.append(-1)
                node = steps[step]
            ends[node] = k
        if forms is None:
            words, token = list(number), list(number.values())
        else:
            known = [(w, number[t]) for w, t in forms if t in number]
            words, token = [w for w, _ in known], [t for _, t in known]
        wide = max(1, len(number))
        keys = np.array([n * wide + t for n, t in steps], np.int64)
        order = np.argsort(keys)
        inner = np.zeros(len(ends), bool)
        inner[[n for n, _ in steps]] = True
        return Trie(pa.array(words, pa.string()), np.array(token, np.int64), wide, keys[order],
                    np.array(list(steps.values()), np.int64)[order], np.array(ends, np.int64), inner, len(phrases))

    def found(self, lists: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, phrase, times`` of the phrases in token lists, by row and phrase."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not lengths.sum():
            return none, none, none
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.forms), -1).to_numpy(zero_copy_only=False)
        token = np.where(at >= 0, self.token[at] if len(self.token) else -1, -1)
        row = np.repeat(np.arange(len(lengths)), lengths)
        start = pos = np.flatnonzero(token >= 0)
        node, met = np.zeros(len(pos), np.int64), [none]
        while len(pos):
            key = node * self.tokens + token[pos]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            start, pos, node = start[ok], pos[ok], self.after[i[ok]]
            done = self.ends[node] >= 0
            met.append(row[start[done]] * self.phrases + self.ends[node[done]])
            more = self.inner[node] & (pos + 1 < len(token))
            start, pos, node = start[more], pos[more] + 1, node[more]
            same = (row[pos] == row[start]) & (token[pos] >= 0)
            start, pos, node = start[same], pos[same], node[same]
        key, times = np.unique(np.concatenate(met), return_counts=True)
        return key // self.phrases, key % self.phrases, times


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with about ``STEP`` tokens in column ``tokens``, and the lengths of their lists."""
    lengths = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from ((batch.slice(lo, hi - lo), lengths[lo:hi]) for lo, hi in _cuts(lengths))


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    part = np.cumsum(sizes) // STEP
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)) if len(sizes) else []
    lo = 0
    for hi in ends:
        yield lo, int(hi)
        lo = int(hi)


@dataclass(frozen=True)
class Asked:
    """Queries as conjunctions of phrases, each from its rarest on."""

    trie: Trie
    queries: np.ndarray   # ids
    first: np.ndarray     # where the terms of each query begin, and the end
    phrase: np.ndarray    # of each term, rarest first in its query
    gain: np.ndarray      # weight of each term
    starts: np.ndarray    # queries by their rarest phrase
    starts_at: np.ndarray  # where those of each phrase begin in it, and the end

    @staticmethod
    def of(table: pa.Table, forms: list[tuple[str, str]] | None = None) -> Asked:
        """From ``query, phrase, df, gain``, a row for each term."""
        coded = table["phrase"].combine_chunks().dictionary_encode()
        phrase = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        query, df, gain = (table[c].to_numpy() for c in ("query", "df", "gain"))
        order = np.lexsort((phrase, df, query))
        queries, first = np.unique(query[order], return_index=True)
        phrase = phrase[order]
        rarest = phrase[first] if len(first) else phrase
        names = coded.dictionary.to_pylist()
        return Asked(Trie.of(names, forms), queries, np.append(first, len(order)), phrase, gain[order],
                     np.argsort(rarest, kind="stable"),
                     np.searchsorted(np.sort(rarest), np.arange(len(names) + 1)))

    def met(self, lists: pa.Array, lengths: np.ndarray, saturation) -> Iterator[tuple]:
        """``row, query (its place), score`` of the token lists that hold all of a query's phrases."""
        row, phrase, times = self.trie.found(lists, lengths)
        key = row * self.trie.phrases + phrase
        asking = self.starts_at[phrase + 1] - self.starts_at[phrase]
        some = np.flatnonzero(asking)
        for lo, hi in _cuts(asking[some]):
            at = some[lo:hi]
            n = asking[at]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query = self.starts[np.repeat(self.starts_at[phrase[at]], n) + inside]
            rows, score, j = np.repeat(row[at], n), np.zeros(n.sum()), 0
            while len(query):
                term = self.first[query] + j
                want = rows * self.trie.phrases + self.phrase[term]
                i = np.minimum(np.searchsorted(key, want), len(key) - 1)
                ok = key[i] == want
                rows, query, term, i = rows[ok], query[ok], term[ok], i[ok]
                score = score[ok] + self.gain[term] * saturation(times[i], lengths[rows])
                j += 1
                whole = self.first[query] + j == self.first[query + 1]
                # Rounded, so that copies of one text tie whatever the order of the sum.
                yield rows[whole], query[whole], np.round(score[whole], 9)
                rows, query, score = rows[~whole], query[~whole], score[~whole]


class Best:
    """The best samples of each query that a task has seen: what cannot be among the first
    ``depth`` of all is left out.  Past ``most`` rows they are handed on and it starts anew."""

    def __init__(self, depth: int, most: int = 1 << 21):
        self.depth, self.most, self.parts, self.rows, self.due = depth, most, [], 0, most

    def add(self, query, sample, caption, score) -> Iterator[tuple]:
        self.parts.append((query, sample, caption, score))
        self.rows += len(query)
        if self.rows > self.due:
            self._cut()
            self.due = self.most
            if 2 * self.rows > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        if self.rows:
            self._cut()
            yield self.parts[0]
        self.parts, self.rows = [], 0

    def _cut(self) -> None:
        query, sample, caption, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((caption, -score, sample, query))
        q, s = query[order], sample[order]
        order = order[np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1]))[:len(order)]]
        order = order[np.lexsort((sample[order], -score[order], query[order]))]
        q = query[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < self.depth]
        self.parts = [(query[order], sample[order], caption[order], score[order])]
        self.rows = len(order)
