"""Language-model scores by a weighted backoff automaton.

*States* are the contexts seen in training: the last two tokens, the last one, or
none.  A state has an *arc* for each token seen after it, weighted by the smoothed
probability

    P(w | h) = (c(h w) + k * P(w | h')) / (c(h) + k),        h' = h less its first token,

and a *failure arc* to h' with weight k / (c(h) + k), taken when the token has no
arc; at the root every token has its additive estimate.  Both together are one
normalised distribution.  Texts are walked left to right; the state carried to a
position is the longest seen context there, and log weights add up along the walk.

The n-grams are never in one place.  Documents are grouped by a hash of their id.
A group sends each distinct n-gram key once to the shard that owns its range of
hashes, with its training count, and the shard answers in the same order with the
corpus count (and its own token totals).  From these the group builds the part of
the automaton that its texts walk through (``Automaton``), and walks it.  Keys
travel as sorted differences, so a common n-gram costs a shard one row per group,
and the text is shuffled once.

Defined results: null is the empty text (only the end token); a null doc_id is
held out or not by the empty string's checksum; repeated rows each count and keep
their rows; with nothing to learn from every token has the uniform root estimate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import buckets_of

#: Added to every count at the root, and the k of the two longer contexts.
ADDED, STRENGTH = 0.1, (500.0, 4.0)
FOLDS = 10
#: Tokens of a text that are walked at one go.
PIECE = 128
_END, _BEGIN = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_KEPT = 400_000
_ASKED = "shard int, bucket int, packed binary"
_TEXTS = "bucket int, packed binary"
_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


class _Ids(dict):
    """Hashes of words; a worker keeps those it has met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_IDS = _Ids()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Walk:
    """A group of texts as token positions, with the n-gram that ends at each.

    ``keys[o]`` holds, sorted, the distinct keys of n-grams of o + 1 tokens, and
    ``at[o]`` the index of each position's n-gram among them (-1: none)."""

    def __init__(self, texts: list[str | None]):
        words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        get = _IDS.__getitem__
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        token = np.empty(int(self.lengths.sum()), np.uint64)
        for at, some in zip(self.begins.tolist(), words, strict=True):
            token[at:at + len(some)] = np.fromiter(map(get, some), np.uint64, len(some))
        token[self.begins + self.lengths - 1] = _END
        before = np.append(_BEGIN, token[:-1])
        before[self.begins] = _BEGIN
        pair = _mix(before * np.uint64(0x9FB21C651E98DF25) + token)
        triple = np.zeros(len(token), np.uint64)
        triple[1:] = _mix(pair[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + token[1:])
        longer = np.ones(len(token), bool)
        longer[self.begins] = False
        self.keys, self.at = [], []
        for order, key in enumerate((_mix(token), pair, triple)):
            if order:  # 56 bits are enough beside the words' own 64
                key = key & ~np.uint64(255)
            if order < 2:
                keys, at = np.unique(key, return_inverse=True)
            else:
                keys, some = np.unique(key[longer], return_inverse=True)
                at = np.full(len(token), -1, np.int64)
                at[longer] = some
            self.keys.append(keys)
            self.at.append(at)
        self.end = int(np.searchsorted(self.keys[0], _mix(np.array([_END]))[0]))

    def counts(self, learned: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each key in the texts to learn from."""
        weight = np.repeat(learned, self.lengths)
        return [np.bincount(at[weight & (at >= 0)], minlength=len(k)) for k, at in zip(self.keys, self.at, strict=True)]

    def places(self, order: int) -> np.ndarray:
        """A position where each n-gram of order + 1 tokens ends."""
        place, at = np.empty(len(self.keys[order]), np.int64), self.at[order]
        there = np.flatnonzero(at >= 0)
        place[at[there]] = there
        return place


class Automaton:
    """The states that a group's texts can reach, with their arcs.

    State 0 is the root.  Then come a state for each word, one for the beginning of
    a text and one for each pair of tokens; a context unseen in training keeps its
    number, but no arc leads to it.  ``arcs`` holds state * words + token, sorted;
    ``weight`` and ``to`` are an arc's log10 probability and the state after it,
    ``fail_weight`` and ``fail_to`` those of a state's failure arc."""

    def __init__(self, walk: Walk, counts: list[np.ndarray], tokens: int, kinds: int, strength: tuple[float, float]):
        words, token, pair = len(counts[0]), walk.at[0], walk.at[1]
        self.words, self.begin = words, 1 + words if counts[0][walk.end] else 0
        seen = np.concatenate([[0], counts[0], counts[0][walk.end:walk.end + 1], counts[1]])  # as many begin as end
        self.root = np.log10(counts[0] + ADDED) - np.log10(tokens + ADDED * (kinds + 1))

        ends, two, three = walk.places(1), counts[1] > 0, counts[2] > 0
        before = np.append(words, token[:-1])
        before[walk.begins] = words
        k = np.repeat(np.array((1.0, *strength)), [1, words + 1, len(ends)])
        self.fail_weight = np.log10(k) - np.log10(seen + k)
        self.fail_to = np.zeros(len(seen), np.int64)
        self.fail_to[words + 2:] = np.where(counts[0][token[ends]] > 0, 1 + token[ends], 0)

        def weights(state: np.ndarray, count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            return np.log10(count + k[state] * 10.0 ** shorter) - np.log10(seen[state] + k[state])

        # the root has an arc for every token; each longer context for those seen after it
        of_pair = np.zeros(len(ends))
        one, last = 1 + before[ends[two]], token[ends[two]]
        of_pair[two] = weights(one, counts[1][two], self.root[last])
        at = walk.places(2)[three]
        state = words + 2 + pair[at - 1]
        arcs = np.concatenate([np.arange(words), one * words + last, state * words + token[at]])
        weight = np.concatenate([self.root, of_pair[two], weights(state, counts[2][three], of_pair[pair[at]])])
        to = np.concatenate([np.where(counts[0] > 0, 1 + np.arange(words), 0), words + 2 + np.flatnonzero(two),
                             words + 2 + pair[at]])
        order = np.argsort(arcs)
        self.arcs, self.weight, self.to = arcs[order], weight[order], to[order]

    def traverse(self, token: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability added at each position of texts walked from left to right.

        Texts are walked side by side, long ones as pieces of ``PIECE`` tokens.  A state
        remembers two tokens, so a piece that starts at the root two tokens early has
        reached the state of the whole walk where its own tokens begin."""
        pieces = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        early = np.minimum(offset, 2)
        size = np.minimum(PIECE, lengths[text] - offset) + early
        start = begins[text] + offset - early
        state = np.where(offset > 2, 0, self.begin)
        longest = np.argsort(-size, kind="stable")
        early, size, start, state = (x[longest] for x in (early, size, start, state))
        out = np.empty(len(token))
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step))
            at = start[:live] + step
            want, log, left = token[at], np.zeros(live), np.arange(live)
            while len(left):
                here = state[left]
                key = here * self.words + want[left]
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                met = self.arcs[arc] == key
                taken, found, failed = left[met], arc[met], left[~met]
                log[taken] += self.weight[found]
                state[taken] = self.to[found]
                log[failed] += self.fail_weight[here[~met]]
                state[failed] = self.fail_to[here[~met]]
                left = failed
            own = early[:live] <= step
            out[at[own]] = log[own]
        return out


def scores(walk: Walk, counts: list[np.ndarray], tokens: int, kinds: int,
           strength: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, model score) of each text."""
    known = (counts[0] > 0).astype(np.int64)
    model = Automaton(walk, counts, tokens, kinds, strength)
    log = model.traverse(walk.at[0], walk.begins, walk.lengths)
    return tuple(np.add.reduceat(x, walk.begins) for x in (known[walk.at[0]], model.root[walk.at[0]], log))


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins among the sorted keys."""
    return np.append(np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32),
                                     np.arange(shards, dtype=np.uint64)), len(keys))


def _narrow(keys: np.ndarray, low: int) -> tuple[int, int, list[bytes]]:
    """Sorted keys as byte planes of their differences, the lowest first and
    without the high ones that are all zero.  The first difference, from zero,
    is a whole key, so it stands beside them."""
    steps = np.diff(keys >> np.uint64(low), prepend=keys[:1] >> np.uint64(low)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8)
    used = -(-int(steps.max(initial=0)).bit_length() // 8)
    return low, int(keys[0]) if len(keys) else 0, [planes[:, i].tobytes() for i in range(used)]


def _widen(narrow: tuple[int, int, list[bytes]], n: int) -> np.ndarray:
    low, first, planes = narrow
    steps = np.zeros((n, 8), np.uint8)
    for i, plane in enumerate(planes):
        steps[:, i] = np.frombuffer(plane, np.uint8)
    return (np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64) << np.uint64(low)) + np.uint64(first)


def _small(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint64)


def _pack(value: object) -> bytes:
    """Counts and key differences leave little once they are entropy-coded, so
    that the shuffle moves less than its own compression would."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, 5))


def _unpack(packed: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each group in a batch as one packed row."""
    for batch in batches:
        rows: dict[int, list[tuple]] = {}
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in (
                "bucket", "doc_id", "text", "held_out")), strict=True):
            rows.setdefault(bucket, []).append(tuple(row))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(rows), pa.int32()),
                                          "packed": pa.array([_pack(r) for r in rows.values()], pa.binary())})


def _documents(bundles: pa.Table) -> tuple[list, list, list]:
    """doc_ids, texts and held-out marks of a group."""
    rows = [r for p in bundles.column("packed").to_pylist() for r in _unpack(p)]
    return tuple(map(list, zip(*rows, strict=True)))


def _asking(shards: int):
    """A group's n-grams with their training counts, to every shard."""

    def run(bundles: pa.Table) -> pa.Table:
        _, texts, held = _documents(bundles)
        walk = Walk(texts)
        counts = walk.counts(~np.array(held, bool))
        cuts = [_cuts(k, shards) for k in walk.keys]
        packed = []
        for s in range(shards):
            part = []
            for order, (keys, count, cut) in enumerate(zip(walk.keys, counts, cuts, strict=True)):
                a, b = cut[s], cut[s + 1]
                part.append((b - a, _narrow(keys[a:b], 8 if order else 0), _small(count[a:b])))
            packed.append(_pack(part))
        return pa.table({"shard": pa.array(range(shards), pa.int32()), "bucket": pa.array(
            [bundles.column("bucket")[0].as_py()] * shards, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return run


def _answering(asked: pa.Table) -> pa.Table:
    """Corpus counts for each group, in the order in which it asked."""
    parts = [_unpack(x) for x in asked.column("packed").to_pylist()]
    answers: list[list] = [[] for _ in parts]
    tokens = kinds = 0
    for order in range(3):
        sizes = [int(p[order][0]) for p in parts]
        keys = np.concatenate([_widen(p[order][1], n) for p, n in zip(parts, sizes, strict=True)])
        distinct, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, np.concatenate([p[order][2] for p in parts]).astype(np.float64),
                           minlength=len(distinct)).astype(np.int64)
        if order == 0:
            tokens, kinds = int(sums.sum()), int((sums > 0).sum())
        ends = np.cumsum(sizes)
        for answer, a, b in zip(answers, ends - sizes, ends, strict=True):
            answer.append(_small(sums[which[a:b]]))
    return pa.table({"shard": asked.column("shard"), "bucket": asked.column("bucket"),
                     "packed": pa.array([_pack((tokens, kinds, a)) for a in answers], pa.binary())})


def _scoring(strength: tuple[float, float]):
    def run(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, held = _documents(bundles)
        walk = Walk(texts)
        packed = answers.column("packed").to_pylist()
        parts = [_unpack(packed[i]) for i in np.argsort(answers.column("shard").to_numpy())]
        tokens, kinds = sum(p[0] for p in parts), sum(p[1] for p in parts)
        counts = [np.concatenate([p[2][o] for p in parts]).astype(np.int64) for o in range(3)]
        known, base, score = scores(walk, counts, tokens, kinds, strength)
        n = len(ids)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()),
            "n_tokens": pa.array(walk.lengths, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64())})

    return run


def lm_scores(docs: DataFrame, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for
    every row: log10 probabilities under the additive root and under the model,
    learned from the rows that are not held out."""
    shards = max(1, buckets_of(docs) // 4)
    groups = 3 * shards  # smaller groups would ask for more n-grams twice
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    keyed = docs.select("doc_id", "text", (fold == 0).alias("held_out"), F.pmod(
        F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("bucket"))
    bundles = keyed.mapInArrow(_bundled, _TEXTS).repartition(groups, "bucket")
    asked = bundles.groupBy("bucket").applyInArrow(_asking(shards), _ASKED)
    answers = asked.groupBy("shard").applyInArrow(_answering, _ASKED)
    return bundles.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_scoring(strength), _SCORES)
