"""SimHash near-duplicates: fingerprints that differ in few bits are linked.

Fingerprints are compared, not documents: copies share one.  64 bits are cut into
``max_bits + 2`` blocks; two fingerprints within ``max_bits`` agree on at least
two whole blocks, so every close pair meets under one of the block pairs' keys.
Small key groups are joined with themselves and verified by Hamming distance.  In
a large group (near copies by the thousand) pairs would be quadratic, so members
meet under a second key instead: the fingerprint with up to ``max_bits / 2`` bits
flipped.  Two that share such a key are within ``max_bits`` of each other, and
any two that close share one: the same links, up to what is reachable.

Defined results: a null or empty text has fingerprint 0 and is linked like any
other; repeated rows keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import saved
from siftwork.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Key groups up to this size are verified pair by pair.
PAIRWISE = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), "<u8", max(1, len(words) - size + 1)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, copy, print): the fingerprint's bits as a signed long, and a hash
    of the text."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), simhash("text").alias("print"))


def _block_masks(max_bits: int) -> list[int]:
    """For each pair of blocks, the bits of both."""
    cuts = [round(64 * i / (max_bits + 2)) for i in range(max_bits + 3)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def close_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) among the distinct values of ``print`` that connect whatever
    chains of pairs within ``max_bits`` connect."""
    if max_bits % 2 or not 0 < max_bits < 8:
        raise ValueError("max_bits must be 2, 4 or 6")
    masks = _block_masks(max_bits)
    keyed = prints.select("print").distinct().select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("k")).select("print", "k.m", "k.key")
    sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(keyed.join(sizes, ["m", "key"]))
    small = met.where(F.col("n") <= PAIRWISE)
    other = small.select("m", "key", F.col("print").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = small.select("m", "key", F.col("print").alias("a")).join(
        other, ["m", "key"]).where((F.col("a") > F.col("b")) & near).select("a", "b").distinct()

    hot = None
    for i, mask in enumerate(masks):
        rest = [b for b in range(64) if not mask >> b & 1]
        flips = [0] + [sum(1 << b for b in some) for r in range(1, max_bits // 2 + 1)
                       for some in combinations(rest, r)]
        spread = met.where((F.col("n") > PAIRWISE) & (F.col("m") == i)).select(
            "m", "print", F.explode(F.array(*[F.lit(_signed(f)) for f in flips])).alias("flip")
        ).select("m", "print", F.col("print").bitwiseXOR(F.col("flip")).alias("hub"))
        hot = spread if hot is None else hot.unionByName(spread)
    centre = hot.groupBy("m", "hub").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = hot.join(centre, ["m", "hub"]).select(F.col("print").alias("a"), "b").where("a > b").distinct()
    return pairs.unionByName(stars)


def star_candidates(prints: DataFrame, blocks: int = 6, most: int = 12) -> DataFrame:
    """Pairs (a, b) of distinct values of ``print`` that agree on two of the blocks and differ in at most ``most``
    bits: of the prints that share a key, each meets the least and the greatest, so pairs grow with prints and
    not with the square of a group.  Candidates for a check of the texts, for prints far apart not all there are."""
    keyed = prints.select("print").distinct().select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(_block_masks(blocks - 2))])).alias("k")).select("print", "k.m", "k.key")
    ends = keyed.groupBy("m", "key").agg(F.min("print").alias("least"), F.max("print").alias("greatest")).where(
        "least < greatest")
    met = keyed.join(ends, ["m", "key"]).select("print", F.explode(F.array("least", "greatest")).alias("end"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("end"))) <= most
    return met.where((F.col("print") != F.col("end")) & near).select(
        F.greatest("print", "end").alias("a"), F.least("print", "end").alias("b")).distinct()


def _grouped(docs: DataFrame, size: int, max_bits: int) -> DataFrame:
    """(doc_id, copy, print, root): root names the group of linked fingerprints."""
    prints = saved(fingerprints(docs, size))
    roots = components(close_links(prints, max_bits))
    distinct = prints.select("print").distinct()
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"))
    return prints.join(rooted, "print")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    grouped = saved(_grouped(docs, size, max_bits))
    named = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(named, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id, the least text hash
    of its texts; a document without id stands behind all others."""
    return keep_first(docs, _grouped(docs, size, max_bits))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of ``grouped`` (doc_id, copy, root)."""
    first = grouped.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("_id"), F.col("first.copy").alias("_copy")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias("hash"))
    same = rows["id"].eqNullSafe(kept["_id"]) & (rows["hash"] == kept["_copy"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
