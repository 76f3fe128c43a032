"""Removal of long repeats by a content-chosen parse of the corpus; no suffix array is built.

Every byte is removed that lies in a string of ``WIDTH`` bytes which also starts
earlier: in a document before, or further left in the same one.

*Parse.*  A rolling hash over ``TRIGGER`` bytes chooses, in each window of
``WIDTH`` bytes, one trigger: the position of the least hash.  Consecutive windows
with the same trigger form a phrase.  The choice depends on the window's bytes
alone, so equal windows lie at the same place of phrases with the same trigger,
wherever they stand in the corpus, and every window has a trigger.

*Parse order.*  Phrases meet by trigger and content.  Of equal phrases only the
first in corpus order can hold anything new; the others are repeats as a whole.
Copies inside one task are settled there, so a phrase travels once per task.

*Dictionary order.*  Only distinct phrases that share their trigger with a
different one are left; their windows are sorted by content with the corpus order of their phrases, and
all but the first of equal ones are repeats.  Windows are verified byte by byte;
whole phrases are equal if the hashes of trigger and content are.

Everything else, which is most of a corpus with few repeats, never leaves the
first sort.  Groups of documents go through the last steps by a hash of doc_id.

Defined results: null is the empty text; texts under ``WIDTH`` bytes keep all;
rows with one doc_id are ordered by a hash of the text, and wholly equal rows are
one document (each row gets its result); a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import buckets_of, hand_back, saved

WIDTH = 100
TRIGGER = 24
#: Bytes parsed at once; a longer text is parsed in stretches.  The parse holds some hundred bytes for each.
STRETCH = 1 << 18
#: Rows read at once, and bytes of text whose phrases a task holds before it passes them on.
SLICE, HELD = 256, 16 << 20
PHRASES, SPANS, OPEN = 0, 1, 2
PACKED = "kind int, key int, rows long, packed binary"
_FIRST = -(1 << 63)
_PLACE = np.uint64((1 << 21) - 1)


class _Roll:
    """A polynomial hash modulo 2^64 of any stretch of a byte array."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.base = base & (1 << 64) - 1
        self.size = 0
        self._grow(size)

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = size
            ones = np.full(size, self.base, np.uint64)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones[1:] = pow(self.base, -1, 1 << 64)
            self.down = np.multiply.accumulate(ones)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((sums[hi] - sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return _mix((sums[width:] - sums[:-width]) * self.down[:n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_ROLLS: list[_Roll] = []


def _rolls() -> list[_Roll]:
    if not _ROLLS:
        _ROLLS.extend(_Roll(seed, STRETCH + 2 * WIDTH) for seed in (11, 23))
    return _ROLLS


def phrases_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger, content, document, start, windows) of each phrase of the texts
    ``data[begins[i]:ends[i]]``, which follow each other; at most 2^20 windows."""
    if len(data) < WIDTH:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    roll, other = _rolls()
    sums = roll.sums(data)
    grams = roll.windows(sums, TRIGGER)
    at = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~_PLACE) | (_PLACE - at)  # the rightmost of equals
    span, least = 1, low
    wide = WIDTH - TRIGGER + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[:len(low) - wide + 1], least[wide - span:wide - span + len(low) - wide + 1])
    trigger = (_PLACE - (least & _PLACE)).astype(np.int64)
    doc = np.repeat(np.arange(len(begins)), ends - begins)[:len(trigger)]
    inside = np.arange(len(trigger)) + WIDTH <= ends[doc]
    new = np.empty(len(trigger), bool)
    new[0] = True
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new & inside)
    stops = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    content = other.of(other.sums(data), starts, stops + WIDTH)
    own = doc[starts]
    return (_mix(grams[trigger[starts]] ^ np.uint64(0x5851F42D4C957F2D)), content, own,
            starts - begins[own], stops - starts + 1)


def _stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of all texts, parsed in stretches: (trigger, content, text,
    start, windows)."""
    waiting, size = [], 0

    def parse() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(b) for _, _, b in waiting])
        ends = np.cumsum(lengths)
        t, c, d, s, n = phrases_of(np.frombuffer(b"".join(b for _, _, b in waiting), np.uint8),
                                   ends - lengths, ends)
        which = np.array([i for i, _, _ in waiting], np.int64)
        ahead = np.array([o for _, o, _ in waiting], np.int64)
        return t, c, which[d], s + ahead[d], n

    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - WIDTH + 1), STRETCH):
            part = text[lo:lo + STRETCH + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            if size + len(part) > STRETCH + WIDTH and waiting:
                yield parse()
                waiting, size = [], 0
            waiting.append((i, lo, part))
            size += len(part)
    if waiting:
        yield parse()


def _pack(kind: int, key: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each key, holding its rows column by column."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    lows, highs = np.append(0, cuts), np.append(cuts, len(key))
    if not len(key):
        lows = highs = np.empty(0, np.int64)
    moved = {k: v[order] for k, v in columns.items()}
    packed = [pickle.dumps({k: v[a:b] for k, v in moved.items()}, 5) for a, b in zip(lows, highs, strict=True)]
    return pa.table({"kind": pa.array(np.full(len(lows), kind), pa.int32()),
                     "key": pa.array(key[lows], pa.int32()), "rows": pa.array(highs - lows, pa.int64()),
                     "packed": pa.array(packed, pa.binary())})


def _unpack(table: pa.Table) -> dict[str, np.ndarray]:
    parts = [pickle.loads(x) for x in table.column("packed").to_pylist()]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _documents(table: pa.Table | pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts as bytes, doc_id and text hash as integers."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    ids = np.array([_FIRST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    return texts, ids, table.column("_copy").to_numpy(zero_copy_only=False).astype(np.int64)


def _before(columns: dict[str, np.ndarray], *keys: str) -> np.ndarray:
    """Order by the keys, then by place in the corpus."""
    return np.lexsort((columns["start"], columns["copy"], columns["doc"], *(columns[k] for k in keys[::-1])))


def _later(columns: dict[str, np.ndarray], order: np.ndarray, *keys: str) -> np.ndarray:
    """Of the ordered rows, those that repeat the keys of the one before."""
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([columns[k][order[1:]] == columns[k][order[:-1]] for k in keys])
    return same


def _spans(columns: dict[str, np.ndarray], rows: np.ndarray) -> pa.Table:
    kept = {k: columns[k][rows] for k in ("doc", "copy", "start")}
    kept["size"] = (columns["n"][rows] + WIDTH - 1).astype(np.uint32)
    return _pack(SPANS, columns["bucket"][rows], kept)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of texts does not follow the batch size."""
    for batch in batches:
        for lo in range(0, len(batch), SLICE):
            yield batch.slice(lo, SLICE)
        hand_back()


def _parsed(shards: int):
    """Task side of the parse: phrases to their trigger's shard, and the spans
    of phrases that this task has seen before."""

    def settle(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # Each column takes the place of its parts.
        columns = {k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])}
        order = _before(columns, "trigger", "content")
        again = _later(columns, order, "trigger", "content")
        yield from _spans(columns, np.sort(_other_places(columns, order, again))).to_batches()
        first = np.sort(order[~again])
        del order, again
        columns = {k: columns.pop(k)[first] for k in list(columns)}
        shard = (columns["trigger"] % np.uint64(shards)).astype(np.int32)
        yield from _pack(PHRASES, shard, columns).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        hand_back()  # what the stage before left, ere the first batch comes
        for batch in _slices(batches):
            texts, ids, copies = _documents(batch)
            buckets = batch.column("_bucket").to_numpy(zero_copy_only=False).astype(np.int32)
            for trigger, content, i, start, n in _stretches(texts):
                if len(i):
                    held.append({"trigger": trigger, "content": content, "doc": ids[i], "copy": copies[i],
                                 "bucket": buckets[i], "start": start.astype(np.uint32),
                                 "n": n.astype(np.uint32)})
                    size += int(n.sum())
                if size > HELD:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)
            held = []
        hand_back()

    return run


def _compared(table: pa.Table) -> pa.Table:
    """Phrases of one shard: repeats of whole phrases, and those left open."""
    hand_back()
    if table.column("kind")[0].as_py() == SPANS:
        return table
    columns = _unpack(table)
    order = _before(columns, "trigger", "content")
    again = _later(columns, order, "trigger", "content")
    first = order[~again]
    same = _later(columns, first, "trigger")
    shared = same | np.append(same[1:], False)
    left = {k: v[first[shared]] for k, v in columns.items() if k != "content"}
    # a repeated row of the same document (same place) is not a repeat of it
    return pa.concat_tables([_spans(columns, _other_places(columns, order, again)),
                             _pack(OPEN, left["bucket"], left)])


def _other_places(columns: dict[str, np.ndarray], order: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Repeats that stand elsewhere than the first of their group."""
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    lead = order[head]
    same = np.logical_and.reduce([columns[k][order] == columns[k][lead] for k in ("doc", "copy", "start")])
    return order[again & ~same]


def _cut(shards: int):
    """Bytes of the open phrases of a group of documents, to their shards."""

    def run(docs: pa.Table, left: pa.Table) -> pa.Table:
        hand_back()
        if not left.num_rows or not docs.num_rows:
            return _pack(OPEN, np.empty(0, np.int32), {})
        columns = _unpack(left)
        texts, ids, copies = _documents(docs)
        place = {(d, c): i for i, (d, c) in enumerate(zip(ids.tolist(), copies.tolist(), strict=True))}
        cut = [texts[place[d, c]][s:s + n + WIDTH - 1] for d, c, s, n in zip(*(
            columns[k].tolist() for k in ("doc", "copy", "start", "n")), strict=True)]
        columns["bytes"] = np.array(cut, dtype=object)
        return _pack(OPEN, (columns["trigger"] % np.uint64(shards)).astype(np.int32), columns)

    return run


def _sorted_windows(table: pa.Table) -> pa.Table:
    """Spans of the windows that an earlier phrase with the trigger holds too."""
    hand_back()
    phrases = _unpack(table)
    data = np.frombuffer(b"".join(phrases["bytes"]), np.uint8)
    n = phrases["n"].astype(np.int64)
    own = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)
    at = base[own] + offset
    roll = _rolls()[1]
    columns = {k: phrases[k][own] for k in ("trigger", "doc", "copy", "bucket")}
    columns |= {"start": phrases["start"][own].astype(np.int64) + offset, "n": np.ones(len(own), np.uint32),
                "content": _window_hashes(roll, data, at)}
    order = _before(columns, "trigger", "content")
    again = _later(columns, order, "trigger", "content")
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    rows = np.flatnonzero(again)
    view = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    for lo in range(0, len(rows), 1 << 16):
        part = rows[lo:lo + (1 << 16)]
        if (view[at[order[part]]] != view[at[order[head[part]]]]).any():
            raise RuntimeError("two different strings share both hashes")
    found = np.sort(order[rows])
    if len(found):  # neighbouring windows of a phrase become one span
        apart = np.append(True, (np.diff(found) > 1) | (np.diff(own[found]) > 0))
        runs = np.flatnonzero(apart)
        columns["n"][found[runs]] = np.diff(np.append(runs, len(found)))
        found = found[runs]
    return _spans(columns, found)


def _window_hashes(roll: _Roll, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(data) - WIDTH + 1, STRETCH):
        a, b = np.searchsorted(at, (lo, lo + STRETCH))
        if b > a:
            hashes = roll.windows(roll.sums(data[lo:lo + STRETCH + WIDTH - 1]), WIDTH)
            out[a:b] = hashes[at[a:b] - lo]
    return out


def merged_spans(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    order = np.argsort(starts, kind="stable")
    for a, b in zip(starts[order].tolist(), (starts[order].astype(np.int64) + sizes[order]).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without bytes of characters that they cover only in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        if b < len(text) and text[b] & 0xC0 == 0x80:
            while b > a and text[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            out.append((a, b))
    return out


def _applied(characters: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        hand_back()
        texts, ids, copies = _documents(docs)
        by: dict[tuple[int, int], list[int]] = {}
        columns = _unpack(spans)
        if columns:
            for i, key in enumerate(zip(columns["doc"].tolist(), columns["copy"].tolist(), strict=True)):
                by.setdefault(key, []).append(i)
        removed, runs, digests, kept = [], [], [], []
        for text, d, c in zip(texts, ids.tolist(), copies.tolist(), strict=True):
            rows = by.get((d, c))
            cut = merged_spans(columns["start"][rows], columns["size"][rows]) if rows else []
            if characters:
                cut = whole_characters(text, cut)
            edges = [0, *(x for s in cut for x in s), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(text) - len(rest))
            runs.append(len(cut))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace") if characters else None)
        longs = {"n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": runs}
        return pa.table({"rest": docs.column("rest"), **{k: pa.array(v, pa.int64()) for k, v in longs.items()},
                         "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())})

    return run


def without_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for every row:
    ``rest`` holds the columns of ``docs`` but the text; ``kept_text`` is null
    unless ``characters``, where characters are removed whole or not at all.
    """
    n = buckets_of(docs)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("rest"), "doc_id", "text",
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_copy"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("_bucket"))
    parsed = keyed.select("doc_id", "_copy", "_bucket", "text").mapInArrow(_parsed(n), PACKED)
    settled = saved(parsed.groupBy("kind", "key").applyInArrow(_compared, PACKED))
    grouped = keyed.repartition(n, "_bucket")
    left = settled.where(F.col("kind") == OPEN)
    cut = grouped.groupBy("_bucket").cogroup(left.groupBy("key")).applyInArrow(_cut(n), PACKED)
    found = cut.groupBy("key").applyInArrow(_sorted_windows, PACKED)
    spans = settled.where(F.col("kind") == SPANS).unionByName(found)
    fields = T.StructType([T.StructField("rest", keyed.schema["rest"].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           *(T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept_text"))])
    return grouped.groupBy("_bucket").cogroup(spans.groupBy("key")).applyInArrow(_applied(characters), fields)


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of the texts, and ``n_chars`` to fit."""
    out = without_repeats(docs, characters=True)
    cols = [F.col("kept_text").alias(c) if c == "text" else
            F.length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
            F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols)
