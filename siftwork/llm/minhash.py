"""Document fingerprints: one-permutation MinHash in b bits.

Each shingle of five words is hashed once; the top bits name its bin and the least
hash of a bin stands for it.  An empty bin takes the value of a filled one, chosen
by a hash of its own that all documents share (optimal densification): bin ``b``
ranks all bins by ``a_b * bin + c_b`` and takes the first that is filled.  Only the
low bits of each bin are kept, packed as one hex digit a bin, and likeness corrects
for chance agreement of those bits.  All of it is column functions.

Defined results: A-Z, a-z and other letters are lower-cased, words end at white
space; a text of fewer words is one shingle, so the empty (or null) text has a
fingerprint too, which only the empty text is like.  Equal texts have equal
fingerprints; repeated rows keep their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_LOG2, BITS, SHINGLE = 7, 4, 5
BINS = 1 << BINS_LOG2
_SPACE = r"[ \t\n\x0B\f\r]+"


def _multipliers() -> tuple[list[int], list[int]]:
    """An odd factor and a summand for each bin (Weyl steps of two constants)."""
    steps = [(b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for b in range(BINS)]
    mixed = [(s ^ s >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1 for s in steps]
    return [m >> 40 & (BINS - 1) | 1 for m in mixed], [m >> 52 & (BINS - 1) for m in mixed]


def _ints(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(map(str, values)) + ")")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text``: an array with the low bits
    of each bin.  The steps are columns of their own, so that none runs twice."""
    shift = 64 - BINS_LOG2
    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\f\r")), _SPACE)
    df = df.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    wh = F.col("_wh")
    df = df.withColumn("_sh", F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(wh) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(SHINGLE)]))))
    sh = F.col("_sh")
    bin_of = lambda h: F.shiftrightunsigned(h, shift)
    firsts = F.filter(sh, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(sh, i - 1))))
    df = df.withColumn("_filled", F.transform(firsts, lambda h: (
        F.shiftleft(bin_of(h), BITS) + h.bitwiseAND(F.lit((1 << BITS) - 1))).cast("int")))
    df = df.withColumn("_bins", F.transform("_filled", lambda x: F.shiftright(x, BITS)))
    a, c = map(_ints, _multipliers())
    low = F.lit((1 << BITS) - 1)

    def value(b: Column) -> Column:
        own = F.array_position("_bins", b)
        taken = F.array_min(F.transform("_filled", lambda x: F.shiftleft(
            (F.get(a, b) * F.shiftright(x, BITS) + F.get(c, b)).bitwiseAND(F.lit(BINS - 1)), BITS
        ).bitwiseOR(x.bitwiseAND(low))))
        return F.when(own > 0, F.get("_filled", (own - 1).cast("int"))).otherwise(taken).bitwiseAND(low).cast("byte")

    df = df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value))
    return df.drop("_wh", "_sh", "_filled", "_bins")


def packed(fingerprint: str) -> Column:
    """One hex digit for each bin."""
    return F.array_join(F.transform(fingerprint, lambda v: F.substr(
        F.lit("0123456789abcdef"), v.cast("int") + 1, F.lit(1))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: the share of
    equal bins, less what unlike texts agree on by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def _stripe(order: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below ``order``, found in two steps of root length."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    whole = F.expr("cast(split('" + ",".join(map(str, cuts)) + "', ',') as array<bigint>)")
    coarse = F.expr("cast(split('" + ",".join(map(str, cuts[step - 1::step])) + "', ',') as array<bigint>)") \
        if len(cuts) >= step else F.expr("cast(array() as array<bigint>)")
    head = F.size(F.filter(coarse, lambda x: x <= order))
    return head * step + F.size(F.filter(F.slice(whole, head * step + 1, F.lit(step)), lambda x: x <= order))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and, as ``next_<name>``, the carried
    columns of the next document by descending doc_id; the last one's next is the
    first.  Rows of one doc_id follow by a hash of their text, null ids come last.

    Rows are dealt into stripes of doc_id, whose cuts come from approximate
    quantiles; a stripe also gets the row that follows its last one.  So the order
    costs one shuffle, and no task holds more than a stripe."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.select(F.percentile_approx(
        "doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * max(100, parts)).alias("c")).first()["c"]
    striped = docs.withColumns({"_order": order}).withColumn(
        "_stripe", _stripe(F.col("_order"), sorted(set(cuts or []))))
    tops = sorted((r["_stripe"], r["top"]) for r in striped.select("_stripe", "_order").groupBy("_stripe").agg(
        F.max("_order").alias("top")).collect())
    if not tops:
        tops = [(0, 0)]
    follows = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    guests = docs.sparkSession.createDataFrame(follows, "_order long, _guest int")
    placed = striped.join(F.broadcast(guests), "_order", "left").withColumn("_at", F.explode(F.array_compact(F.array(
        F.struct(F.col("_stripe").alias("s"), F.lit(0).alias("g")),
        F.when(F.col("_guest").isNotNull(), F.struct(F.col("_guest").alias("s"), F.lit(1).alias("g")))))))
    placed = placed.withColumns({"_own": F.col("_at.s"), "_late": F.col("_at.g"),
                                 "_tie": F.xxhash64(F.coalesce("text", F.lit("")))})
    by = Window.partitionBy("_own").orderBy(F.col("_late"), F.col("_order").desc(), F.col("_tie"))
    # One select, so that the columns share one window and one exchange.
    out = placed.select(*docs.columns, "_late", *[F.lead(name).over(by).alias(f"next_{name}") for name in carried])
    return out.where("_late = 0").drop("_late")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every text against itself with its last third replaced from the next
    document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)."""
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "print")
    pairs = with_next(own, ["text", "print"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("edited", F.concat(
        F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third)))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", "edited")
    both = with_fingerprint(pairs, "edited", "edited_print")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed("print").alias("fingerprint"), packed("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"))
