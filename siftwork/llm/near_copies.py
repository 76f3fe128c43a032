"""Near copies by words: texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8 are linked, and so is whatever such links chain.

SimHash comes first.  Texts with one shingle set are one node, with a 64-bit SimHash of
the set.  Prints are cut into six blocks, each pair of blocks is a key, and under a key
each print meets the least and the greatest; pairs within 12 bits are verified on the
whole sets.  At 0.8 a tenth to a seventh of the bits differ, so keys long enough to tell
millions of texts apart miss pairs: an exact step follows for whatever SimHash has not
connected.

In that step no pair is lost.  All shingles have one order, and two sets that are alike
share shingles among the first fifth of each (prefix filter): as many, at least, as what
0.8 lets each set have alone leaves of its fifth.  Pairs are counted over all their
shared shingles, and those with fewer go before anything else of them is read.  Of the
candidates, those go whose parity marks differ in more bits than the sets may differ in
shingles (each shingle flips one bit, so marks never differ in more); the others are
verified on the whole sets.

The order puts shingles seen often in a sample behind all others, so that a common
line is no key.  Any order gives the same links; this one only saves work.

Groups of a key with up to ``PAIRWISE`` nodes are compared pair by pair.  A larger
group meets its first ``LEADERS`` members, then only pairs whose members these
links do not connect yet; pairs inside a component change nothing.  Such pairs are
candidates by one shared shingle, where what stands before and behind it is still long enough
for the overlap that 0.8 asks (positional filter), and their marks are compared where they
meet; so the count of a pair that shares no large group is whole, and of a crowd that stays
just below 0.8 only pairs whose marks allow 0.8 become rows.  Groups of more than ``TILE``
nodes are dealt as tiles, two blocks of nodes each.

Defined results: a text of fewer than five words is one shingle, null and empty
texts are copies of each other and of nothing else; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm import common, simhash
from siftwork.llm.common import buckets_of, hand_back, saved
from siftwork.llm.components import components
from siftwork.llm.repeats import PACKED, _pack, _unpack
from siftwork.llm.simhash import SEED

SHINGLE = 5
PAIRWISE, LEADERS = 16, 4
#: Nodes of a large group in each of the two blocks of a tile.
TILE = 4096
#: Bits of the parity marks.
MARKS = 1024
#: Rows of the sample (one in so many), and shingles listed as common: by a task, in all.
SAMPLED, TASK_COMMON, COMMON = 8, 256, 1 << 15
#: Keys a task holds before it passes them on.
HELD = 1 << 19
PAIRS, LARGE = 0, 1
#: Bytes of a row that names a text.
_ROW = 32
_MET = "kind int, a long, b long, shared int, needed int, packed binary"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def alike(n_a, n_b, both):
    """Whether sets of these sizes with this overlap have similarity 0.8."""
    return 9 * both >= 4 * (n_a + n_b)


def marks(grams: np.ndarray, bits: int = MARKS) -> bytes:
    """A bit for each residue: whether an odd number of shingles has it."""
    return np.packbits(np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 != 0).tobytes()


def _long_marks(grams: np.ndarray) -> bytes:
    """Marks with two bits at least for each shingle; none where ``MARKS`` are as many."""
    bits = 1 << (2 * len(grams) - 1).bit_length()
    return marks(grams, bits) if bits > MARKS else b""


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which long marks differ; longer ones are folded, 0 if there are none."""
    a, b = (np.frombuffer(m, np.uint64) for m in (x, y))
    n = min(len(a), len(b))
    if not n:
        return 0
    a, b = (np.bitwise_xor.reduce(m.reshape(-1, n), axis=0) for m in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled texts, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            parts = [shingles(t) for t in batch.column("text").to_pylist()]
            if parts:
                every = np.concatenate([seen, *parts])
                weights = np.concatenate([counts, np.ones(len(every) - len(seen), np.int64)])
                seen, back = np.unique(every, return_inverse=True)
                counts = np.bincount(back, weights).astype(np.int64)
                if len(seen) > HELD:  # rare ones so far start anew
                    seen, counts = seen[counts > 1], counts[counts > 1]
        top = np.argsort(-counts, kind="stable")[:TASK_COMMON]
        top = top[counts[top] > 2]
        yield pa.RecordBatch.from_pydict({"h": seen[top].view(np.int64), "n": counts[top]})

    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(
        count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "h").limit(COMMON).collect()
    found = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in rows], np.int64)[order]


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, node, n, keys, marks, long, print): the digest of the shingle set, its
    size, its first fifth in the common order, its parity marks, short and long, and its SimHash."""
    common, counts = _common(docs)

    @F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()),
                                T.StructField("keys", T.BinaryType()), T.StructField("marks", T.BinaryType()),
                                T.StructField("long", T.BinaryType()), T.StructField("print", T.LongType())]))
    def prefix(texts: pd.Series) -> pd.DataFrame:
        hand_back()
        nodes, sizes, keys, bits, long, prints = [], [], [], [], [], []
        for text in texts:
            grams = shingles(text)
            nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
            sizes.append(len(grams))
            bits.append(marks(grams))
            long.append(_long_marks(grams))
            prints.append(simhash.majority(grams))
            if len(common):
                at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                rank = np.where(common[at] == grams, counts[at], 0)
                grams = grams[np.argsort(rank, kind="stable")]
            keys.append(grams[:_fifth(len(grams))].tobytes())
        return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64),
                             "n": np.array(sizes, np.int32), "keys": keys, "marks": bits, "long": long,
                             "print": np.array(prints, np.uint64).view(np.int64)})

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), prefix("text").alias("p")).select(
        "doc_id", "copy", "p.*")


def _dealt(shards: int):
    """Keys to their shards; a node's keys once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def settle() -> Iterator[pa.RecordBatch]:
            columns = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            yield from _pack(PAIRS, (columns["key"] % np.uint64(shards)).astype(np.int32), columns).to_batches()

        for batch in batches:
            hand_back()
            for node, n, keys in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys")), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                key = np.frombuffer(keys, np.uint64)
                held.append({"key": key, "node": np.full(len(key), node), "n": np.full(len(key), n, np.int32),
                             "at": np.arange(len(key), dtype=np.int32)})
                size += len(key)
                if size > HELD:
                    yield from settle()
                    held, size, seen = [], 0, set()
        if held:
            yield from settle()

    return run


def _may_be_alike(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, first: bool = False) -> np.ndarray:
    """By sizes and by where the shared shingle stands: before it each set may share all that the other has
    there, in small groups that this one knows nothing of; nothing if it is the ``first`` they share."""
    n, m = c["n"][i].astype(np.int64), c["n"][j].astype(np.int64)
    at, other = c["at"][i].astype(np.int64), c["at"][j].astype(np.int64)
    before = 0 if first else np.minimum(at, other)
    return alike(n, m, np.minimum(n, m)) & alike(n, m, before + np.minimum(n - at, m - other))


def _groups(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows by key and node without repeats, and where each row's group begins
    and ends."""
    order = np.lexsort((c["node"], c["key"]))
    key, node = c["key"][order], c["node"][order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[:len(order)]
    c = {k: v[order[new]] for k, v in c.items()}
    _, begin, back, size = np.unique(c["key"], return_index=True, return_inverse=True, return_counts=True)
    return c, begin[back], (begin + size)[back]


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingles that two alike sets of these sizes share among the first fifths: of a fifth, those that
    the other set may lack come off."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    both = -(-4 * (n + m) // 9)

    def left(size):
        return _fifth(size) - (size - both)
    return np.maximum(1, np.minimum(left(n), left(m)))


def _fifth(size):
    return size - (4 * size + 4) // 5 + 1


def _pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], packed: bytes | None = None) -> pa.Table:
    """Distinct pairs (larger, smaller, shingles needed; 0: a candidate as it is) and how often each was met."""
    none = np.empty(0, np.int64)
    a = np.concatenate([np.maximum(x, y) for x, y, _ in found] or [none])
    b = np.concatenate([np.minimum(x, y) for x, y, _ in found] or [none])
    needed = np.concatenate([n for _, _, n in found] or [none])
    both, shared = np.unique(np.stack([a, b, needed]), axis=1, return_counts=True)
    n = both.shape[1]
    out = pa.table({"kind": pa.array(np.full(n, PAIRS), pa.int32()), "a": pa.array(both[0], pa.int64()),
                    "b": pa.array(both[1], pa.int64()), "shared": pa.array(shared, pa.int32()),
                    "needed": pa.array(both[2], pa.int32()), "packed": pa.nulls(n, pa.binary())})
    if packed is None:
        return out
    return pa.concat_tables([out, pa.table({
        "kind": pa.array([LARGE], pa.int32()), "a": pa.array([0], pa.int64()), "b": pa.array([0], pa.int64()),
        "shared": pa.array([0], pa.int32()), "needed": pa.array([0], pa.int32()),
        "packed": pa.array([packed], pa.binary())})])


def _met(table: pa.Table) -> pa.Table:
    """Pairs met in one shard, and the rows of its large groups."""
    hand_back()
    c, begin, end = _groups(_unpack(table))
    at, size = np.arange(len(begin)), end - begin
    found = []
    for step in range(1, PAIRWISE):
        i = np.flatnonzero((size <= PAIRWISE) & (at + step < end))
        n, m = c["n"][i].astype(np.int64), c["n"][i + step].astype(np.int64)
        fits = alike(n, m, np.minimum(n, m))
        i = i[fits]
        found.append((c["node"][i], c["node"][i + step], _needed(n[fits], m[fits])))
    large = np.flatnonzero(size > PAIRWISE)
    for k in range(LEADERS):
        lead = begin[large] + k
        # Leaders only save work: what they leave out meets in _across.
        ok = (large != lead) & _may_be_alike(c, large, lead, first=True)
        found.append((c["node"][large[ok]], c["node"][lead[ok]], np.zeros(int(ok.sum()), np.int64)))
    if not len(large):
        return _pairs(found)
    rest = _pack(LARGE, np.zeros(len(large), np.int32), {k: v[large] for k, v in c.items()})
    return _pairs(found, rest.column("packed")[0].as_py())


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            c = _unpack(pa.Table.from_batches([batch.slice(i, 1)]))
            yield pa.RecordBatch.from_pydict({k: c[k].view(np.int64) if k == "key" else c[k]
                                              for k in ("key", "node", "n", "at")})


def _closed(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False)
                 for k in ("key", "node", "n", "at", "root", "block", "tile", "shard")}
            c["key"] = c["key"].view(np.uint64)
            c["marks"] = _words(batch.column("marks").to_pylist())
            yield from _pack(LARGE, c.pop("shard") % shards, c).to_batches()

    return run


def _words(marks) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint64).reshape(-1, MARKS // 64)


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block`` and ``tile``: nodes of a key fall into blocks of about ``TILE``, and each pair of
    blocks, or a block by itself, is a tile."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")).where("blocks > 1")
    own, other = F.col("block"), F.col("other")
    dealt = rows.join(sizes, "key", "left").fillna(1, ["blocks"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("tile", F.least(own, other) * F.col("blocks") + F.greatest(own, other)).withColumn(
        "shard", F.pmod(F.xxhash64("key", "tile"), F.lit(1 << 30)).cast("int")).drop("blocks", "other")


def _across(table: pa.Table) -> pa.Table:
    """Candidates of large groups whose members are not connected yet."""
    hand_back()
    c = _unpack(table)
    found = []
    for tile in np.unique(c["tile"]):
        found += _of_tile({k: v[c["tile"] == tile] for k, v in c.items()})
    return _pairs(found)


def _of_tile(c: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    c, begin, end = _groups(c)
    found = []
    for lo, hi in sorted(set(zip(begin.tolist(), end.tolist(), strict=True))):
        roots, back, sizes = np.unique(c["root"][lo:hi], return_inverse=True, return_counts=True)
        if len(roots) == 1:
            continue
        order = np.argsort(sizes[back], kind="stable")  # small components first, the largest last
        order = order[np.argsort(back[order] == sizes.argmax(), kind="stable")] + lo
        mixed = c["block"][lo:hi].min() != c["block"][lo:hi].max()
        for k in range(len(order) - int(sizes.max())):
            i, others = order[k], order[k + 1:]
            others = others[c["root"][others] != c["root"][i]]
            if mixed:  # pairs of one block meet in a tile of its own
                others = others[c["block"][others] != c["block"][i]]
            others = others[_may_be_alike(c, np.full(len(others), i), others)]
            apart = np.bitwise_count(c["marks"][others] ^ c["marks"][i]).sum(axis=1, dtype=np.int64)
            others = others[9 * apart <= c["n"][others].astype(np.int64) + int(c["n"][i])]
            found.append((np.full(len(others), c["node"][i]), c["node"][others], np.zeros(len(others), np.int64)))
    return found


def _verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""
    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def with_sides(pairs: DataFrame, column: str) -> DataFrame:
        sides = prints.select("node", "n", column).join(nodes_of(pairs), "node", "left_semi").groupBy("node").agg(
            F.first("n").alias("n"), F.first(column).alias(column))
        return pairs.join(sides.toDF("a", "n", "x"), "a").join(sides.toDF("b", "m", "y"), "b")

    @F.pandas_udf(T.BooleanType())
    def may_be(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        apart = np.bitwise_count(_words(x) ^ _words(y)).sum(axis=1, dtype=np.int64)
        return pd.Series(9 * apart <= n.to_numpy(np.int64) + m.to_numpy(np.int64))

    @F.pandas_udf(T.BooleanType())
    def may_still(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        apart = np.array([_apart(i, j) for i, j in zip(x, y, strict=True)], np.int64)
        return pd.Series(9 * apart <= n.to_numpy(np.int64) + m.to_numpy(np.int64))

    met = saved(with_sides(pairs, "marks").where(may_be("n", "m", "x", "y")).select("a", "b", "n", "m"))
    # Marks say nothing of long texts: longer ones do, at a thirtieth to a sixteenth of what whole sets would move.
    both_long = F.least("n", "m") > MARKS // 2
    long = with_sides(met.where(both_long).select("a", "b"), "long").where(may_still("n", "m", "x", "y"))
    pairs = saved(met.where(~both_long).select("a", "b").unionByName(long.select("a", "b")))
    nodes = nodes_of(pairs)
    # One row of each node; if the table repeats rows, its texts are told apart once more.
    texts = saved(prints.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("doc_id", "copy")).alias("first")).select("node", F.col("first.doc_id").alias("_id"), "first.copy"))

    @F.pandas_udf(T.BinaryType())
    def sets(texts: pd.Series) -> pd.Series:
        hand_back()
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    repeated, read = bool(_repeats(prints).limit(1).count()), None
    for k, parts in _parts(texts):
        some = F.broadcast(_part(texts, k, parts))
        found = rows.join(some, (rows["copy"] == some["copy"]) & rows["doc_id"].eqNullSafe(some["_id"])).select("node", "text")
        if repeated:
            found = found.dropDuplicates(["node"])
        found = saved(found.select("node", sets("text").alias("grams")))
        read = found if read is None else read.unionByName(found)

    @F.pandas_udf(T.BooleanType())
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        hand_back()
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append(bool(alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
        return pd.Series(out, dtype=bool)

    one = read.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    other = read.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return saved(pairs.join(one, "a").join(other, "b").where(same("x", "y")).select("a", "b"))


def _repeats(prints: DataFrame) -> DataFrame:
    """(doc_id, copy) of rows that the table has more than once."""
    return prints.groupBy("doc_id", "copy").count().where("count > 1").select("doc_id", "copy")


def _parts(names: DataFrame) -> list[tuple[int, int]]:
    """Of which parts (number, of how many) rows are named, each small enough to broadcast: the texts are read once
    for each part instead of moving."""
    parts = max(1, -(-names.count() * _ROW // common.BROADCAST_BYTES))
    return [(k, parts) for k in range(parts)]


def _part(rows: DataFrame, k: int, parts: int, copy: str = "copy") -> DataFrame:
    return rows if parts == 1 else rows.where(F.pmod(F.xxhash64(copy), F.lit(parts)) == k)


def _by_simhash(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose prints are equal or meet."""
    nodes = prints.select("node", "print").distinct()
    first = nodes.groupBy("print").agg(F.min("node").alias("first"))
    same = nodes.join(first, "print").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    met = simhash.star_candidates(nodes).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return same.unionByName(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def _unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are not of one component."""
    told = pairs.join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left")
    return told.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, root): root names the component of the row's text."""
    shards = buckets_of(docs)
    prints = saved(_prints(docs))
    links = _verified(docs, prints, saved(_by_simhash(prints)))
    roots = components(links)
    met = saved(prints.select("node", "n", "keys").mapInArrow(_dealt(shards), PACKED)
                .groupBy("key").applyInArrow(_met, _MET))
    pairs = met.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.min("needed").alias("needed")).where("shared >= needed").select("a", "b")
    links = links.unionByName(_verified(docs, prints, saved(_unconnected(pairs, roots))))
    roots = components(links)
    large = met.where(F.col("kind") == LARGE).select("packed")
    if large.limit(1).count():
        rows = large.mapInArrow(_opened, "key long, node long, n int, at int").join(roots, "node", "left").withColumn(
            "root", F.coalesce("root", "node")).join(prints.select("node", "marks").distinct(), "node")
        more = _tiles(saved(rows)).mapInArrow(_closed(shards), PACKED).groupBy("key").applyInArrow(_across, _MET)
        more = saved(more.select("a", "b").distinct())
        if more.limit(1).count():
            links = links.unionByName(_verified(docs, prints, more))
            roots = components(links)
    return prints.select("doc_id", "copy", "node").join(roots, "node", "left").select(
        "doc_id", "copy", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, chosen as in ``simhash.keep_one``.

    What goes, and what is repeated, is broadcast in parts of bounded size, so no text moves."""
    grouped = saved(_grouped(docs))
    first = grouped.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.copy").alias("kept_copy"))
    same = grouped["doc_id"].eqNullSafe(kept["kept_id"]) & (grouped["copy"] == kept["kept_copy"])
    change = saved(grouped.join(kept, same, "left_anti").select("doc_id", "copy", F.lit(True).alias("_goes")).unionByName(
        _repeats(grouped).withColumn("_goes", F.lit(False))).groupBy("doc_id", "copy").agg(F.max("_goes").alias("_goes")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias("hash"))
    repeated, out = bool(change.where("NOT _goes").limit(1).count()), None
    for k, parts in _parts(change):
        some = F.broadcast(_part(change, k, parts))
        told = _part(rows, k, parts, "hash").join(
            some, rows["id"].eqNullSafe(some["doc_id"]) & (rows["hash"] == some["copy"]), "left")
        kept = told.where("_goes IS NULL").select("row.*")
        if repeated:
            kept = kept.unionByName(told.where("NOT _goes").dropDuplicates(["id", "hash"]).select("row.*"))
        out = kept if out is None else out.unionByName(kept)
    return out
