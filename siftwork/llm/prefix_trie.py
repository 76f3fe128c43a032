"""Prefix trie of conversations: shared beginnings, and what sharing them saves.

A node is a distinct sequence of first turns.  Its key is built without walking a
conversation: a turn's digest is mixed with its depth, and the key of a prefix is the
exclusive or of its turns' digests (180 bits), which segments of a long conversation
compute apart and join.  A key met twice by chance needs about 2^90 prefixes; one
built on purpose is not defended against.  Totals over subtrees come from tree
contraction (``contraction``), so neither the depth of the trie nor the number of a
node's children makes a long chain of steps or a large group.

Defined results: null roles and texts are empty; turns without conversation or
position are left out; a conversation without turns is a member of the root; repeated
positions of a conversation are not expected (number the turns first); without
conversations there is no node.  Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import saved, streamed_sha256
from siftwork.llm.contraction import subtree_totals

#: Turns of a conversation whose prefixes are computed in one group.
SEGMENT = 4096
#: Conversation ids that one group joins to a list.
IDS = 1 << 16
_LANES = ("k0", "k1", "k2")
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn, its role delimited by length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def prefixes(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``turns`` (conv_id, depth, digest, ...) with the keys of the prefix that ends there
    (k0, k1, k2) and of the one before (p0, p1, p2)."""
    mixed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    rows = turns.withColumn("_mixed", mixed).withColumns({
        f"m{i}": F.conv(F.substring("_mixed", 1 + 15 * i, 15), 16, 10).cast("long") for i in range(3)}).withColumn(
        "_segment", F.floor((F.col("depth") - 1) / segment)).drop("_mixed")
    up_to = Window.partitionBy("conv_id", "_segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.bit_xor(f"m{i}").over(up_to) for i, k in enumerate(_LANES)})
    if turns.where(F.col("depth") > segment).limit(1).count():
        rows = saved(rows)
        before = Window.partitionBy("conv_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, 0)
        carried = rows.groupBy("conv_id", "_segment").agg(*(F.bit_xor(f"m{i}").alias(f"c{i}") for i in range(3)))
        carried = carried.select("conv_id", (F.col("_segment") + 1).alias("_segment"),
                                 *(F.bit_xor(f"c{i}").over(before).alias(f"c{i}") for i in range(3)))
        rows = rows.join(carried, ["conv_id", "_segment"], "left").withColumns(
            {k: F.col(k).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i, k in enumerate(_LANES)}).drop("c0", "c1", "c2")
    return rows.withColumns({f"p{i}": F.col(k).bitwiseXOR(F.col(f"m{i}")) for i, k in enumerate(_LANES)}).drop(
        "m0", "m1", "m2", "_segment")


def prefix_trie(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (UTF-8 bytes that the subtree's turns need not be read
    again), ``ends_sha256`` (of the ids of conversations that end there).

    ``convs`` (conv_id, n_turns), each once; ``turns`` (conv_id, depth from 1, role, text)."""
    convs = convs.where("conv_id IS NOT NULL").select("conv_id", "n_turns")
    text = F.coalesce("text", F.lit(""))
    read = turns.where("conv_id IS NOT NULL AND depth IS NOT NULL").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    zero = F.lit(0).cast("long")
    at_root = convs.select("conv_id", zero.alias("depth"), zero.alias("bytes"),
                           *(zero.alias(k) for k in _LANES), *(zero.alias(f"p{i}") for i in range(3)))
    members = saved(prefixes(read, segment).drop("digest").unionByName(at_root))

    keyed = saved(members.groupBy("depth", *_LANES).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        *(F.max(f"p{i}").alias(f"p{i}") for i in range(3))))
    children = keyed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"),
                                                *(F.col(f"p{i}").alias(k) for i, k in enumerate(_LANES))).count()
    parents = keyed.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                           *(F.col(k).alias(f"p{i}") for i, k in enumerate(_LANES)))
    nodes = saved(keyed.join(parents, ["depth", "p0", "p1", "p2"], "left").join(children, ["depth", *_LANES], "left")
                  .withColumn("n_children", F.coalesce("count", zero)).drop("count", "p0", "p1", "p2"))

    def node(conv: str, depth: Column) -> Column:
        return F.struct(F.col(conv).alias("conv_id"), depth.alias("depth"))

    tree = nodes.select(
        node("conv_id", F.col("depth")).alias("id"),
        F.when(F.col("depth") > 0, node("parent_conv_id", F.col("depth") - 1)).alias("parent"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).select("id.*", "n_leaves", "saved_tokens")

    ends = members.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi")
    lists = ends.groupBy("depth", *_LANES, F.floor(F.col("conv_id") / IDS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = streamed_sha256(lists, ["depth", *_LANES], ["block"], {"ends_sha256": "ids"}, between=",")
    return nodes.join(digests, ["depth", *_LANES], "left").join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
