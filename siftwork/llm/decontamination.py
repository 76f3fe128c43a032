"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 words, or the whole of a shorter item) are sets of shingles
that must all be present for the window to occur.  So one shingle per window is a
sufficient prefix: the one that fewest places of the corpus hold.  Documents are
read once.  Each position is tested against a bitmap of the items' shingles, and
the few that pass are kept with their neighbourhood; from these the shingles are
counted, the rarest of each window becomes its key, and the join on that key is
bounded by position and length and verified word by word.

The bitmap has a bounded size and only filters; the joins broadcast the windows
while they are small and are left to the planner beyond that.  Column functions
only.

Defined results: null and empty texts have no words, are never hit and never
contaminated; items without words are ignored; items sharing an id count once;
rows are independent, so repeated documents keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import ascii_lower, saved, small_enough

WIDTH, SHINGLE, SHARE = 13, 5, 20
#: Everything in ASCII but digits and a-z, after lower-casing.
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BITS_LEAST, _BITS_MOST, _BITS_EACH = 1 << 12, 1 << 24, 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _APART), "")


def _hash(words: str | Column, at: Column, size: int) -> Column:
    """Of ``size`` word hashes from position ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(window, n, words, item_id): every window of every item."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                       words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    return cut.select("item_id", "w", at.alias("at")).select(
        "item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("words")).select(
        "item_id", "words", F.size("words").alias("n"),
        F.xxhash64("words", F.lit(1)).alias("window")).distinct()


def _shingled(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, n, words, size, offset, key) for every shingle of a window."""
    size = F.least(F.col("n"), F.lit(shingle))
    spread = windows.select("window", "n", "words", size.alias("size"), F.explode(
        F.sequence(F.lit(0), F.col("n") - size)).alias("offset"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    key = F.coalesce(*[F.when(F.col("size") == s, _hash("h", F.col("offset"), s)) for s in range(1, shingle + 1)])
    return spread.withColumn("key", key).drop("h")


def _places(key: Column, bits: int) -> list[Column]:
    """Two places of the bitmap for a hash."""
    return [key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))]


def _bitmap(keys: DataFrame, bits: int) -> Column:
    """The bitmap over ``key`` as a constant array of longs, at most 2 MB: its
    size has a bound whatever the number of keys, so it may pass the driver."""
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    filled = [0] * max(1, bits // 64)
    for r in words.collect():
        filled[r["id"]] = r["bits"]
    return F.expr("cast(split('" + ",".join(map(str, filled)) + "', ',') as array<bigint>)")


def _hashes(size: int) -> Column:
    """Hashes of all shingles of a document, by position."""
    return F.when(F.size("h") >= size, F.transform(
        F.sequence(F.lit(0), F.size("h") - size), lambda i: _hash("h", i, size))).otherwise(
        F.array().cast("array<bigint>"))


def _passing(size: int, bitmap: Column, bits: int) -> Column:
    """Positions whose shingle the bitmap lets pass: struct(at, key)."""
    def set_in(key: Column) -> Column:
        one, two = (F.getbit(F.get(bitmap, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
                    for p in _places(key, bits))
        return one & two

    placed = F.transform(f"h{size}", lambda h, i: F.struct(i.alias("at"), h.alias("key")))
    return F.filter(placed, lambda x: set_in(x["key"]))


def _candidates(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """One slim row for each document: its words' number, the positions whose
    shingles the bitmap lets pass, and the words if there are any."""
    n = max(1, keys.count())
    bits = min(_BITS_MOST, max(_BITS_LEAST, 1 << (n * _BITS_EACH - 1).bit_length()))
    bitmap = _bitmap(keys, bits)
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for s in sizes:
        rows = rows.withColumn(f"h{s}", _hashes(s))
    rows = rows.withColumn("places", F.concat(*[_passing(s, bitmap, bits) for s in sizes]))
    return saved(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "copy",
        F.size("words").cast("long").alias("n_words"), "places",
        F.when(F.size("places") > 0, F.col("words")).alias("words")))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE,
                  share: int = SHARE) -> DataFrame:
    """(doc_id, copy, n_words, n_hit, n_items, items_sha256, contaminated) for
    every row of ``docs``; ``copy`` hashes the text.  A document is contaminated
    if at least one word in ``share`` lies in a window of an item."""
    windows = saved(_windows(items, width))
    shingles = saved(_shingled(windows.drop("item_id").distinct(), shingle))
    keys = shingles.select("key").distinct()
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    slim = _candidates(docs, keys, sizes or [shingle])
    reach = F.greatest(F.col("p.at") - width, F.lit(0))
    hits = slim.where(F.size("places") > 0).select("row", "n_words", "words", F.explode("places").alias("p")).select(
        "row", "n_words", F.col("p.key").alias("key"), F.col("p.at").alias("at"), reach.alias("base"),
        F.slice("words", reach + 1, F.lit(2 * width + shingle)).alias("near"))

    small = small_enough(shingles.count(), 64 + 16 * width)
    held = F.broadcast if small else lambda df: df
    seen = hits.select("key").join(held(keys), "key").groupBy("key").agg(F.count("*").alias("seen"))
    rare = shingles.join(seen, "key", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "key", "n", "words")).alias("r"))
    anchors = saved(rare.where("r.seen > 0").select("window", "r.offset", "r.key", "r.n", "r.words"))

    begin = F.col("at") - F.col("offset")
    met = hits.join(held(anchors), "key").where(
        (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
        & (F.slice("near", begin - F.col("base") + 1, F.col("n")) == F.col("words")))
    met = saved(met.select("row", "window", begin.alias("begin"), (begin + F.col("n")).alias("end")).distinct())

    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest("begin", F.least("end", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = met.select("row", "begin", "end").distinct().select("row", new.alias("new")).groupBy("row").agg(
        F.sum("new").cast("long").alias("n_hit"))
    named = met.select("row", "window").distinct().join(
        held(windows.select("window", "item_id")), "window").select("row", "item_id").distinct().groupBy("row").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    found = hit.join(named, "row")
    out = slim.select("row", "doc_id", "copy", "n_words").join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "copy", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = contamination(docs, items).where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_copy"])
    return docs.join(bad, same, "left_anti")
