"""Subtree totals of a forest by parallel tree contraction.

Rounds alternate two steps until only roots are left.  Rake: every leaf goes and adds
its total to its parent.  Compress: in every chain of nodes with one child, those
whose coin is below both neighbours' go, and their child moves up; what a gone node
held then travels with the child.  No two neighbours go at once, a third of a chain
goes in each round, so the rounds grow with the logarithm of the tree whatever its
shape.  Afterwards the gone nodes are expanded again: a raked node's total was whole
when it went, a compressed one's is what it held, what travelled with its child by
then, and the total of that child; following these links doubles its reach in each round.

A round is two grouped exchanges of messages between nodes.  Messages to one node are
combined before the shuffle, so a parent of any number of children is no hot group.
Each round is one table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import saved


def subtree_totals(forest: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): sums over each node and all below it.

    ``forest`` is (id, parent, *values) with long values; a root's parent is null.  A null value
    counts as 0, a node without id is left out, a parent that is no node is as good as a root.  Rows
    of one id are added up.  A circle is refused."""
    kinds = dict(forest.dtypes)
    held = [F.sum(F.coalesce(F.col(v), F.lit(0))).cast("long").alias(v) for v in values]
    here = saved(forest.where("id IS NOT NULL").groupBy("id").agg(F.max("parent").alias("up"), *held)
                 .withColumns({"with_" + v: F.lit(0).cast("long") for v in values}))
    gone, left, turn = [], here.count(), 0
    none = F.lit(None).cast(kinds["id"])
    while here.where("up IS NOT NULL").limit(1).count():
        after = saved(_round(here, values, none, turn))
        gone.append(after.where("gone").select("id", "to", *values))
        here = after.where("NOT gone").drop("gone", "to")
        now, turn = here.count(), turn + 1
        if now == left:
            raise ValueError("the parents of some nodes run in a circle")
        left = now
    known = here.select("id", none.alias("to"), *values)
    for part in gone:
        known = known.unionByName(part)
    return _expanded(saved(known), values)


def _round(here: DataFrame, values: list[str], none: Column, turn: int) -> DataFrame:
    """The nodes after one rake and one compress step: ``gone`` marks those that went, ``to`` the child
    that a compressed one left its place to."""
    carried, borne = ["with_" + v for v in values], ["kid_" + v for v in values]
    zero = F.lit(0).cast("long")

    # Children make themselves known.
    self_rows = here.select("id", F.lit(True).alias("own"), "up", *values, *carried,
                            *(zero.alias(c) for c in borne), zero.alias("kids"), none.alias("kid"))
    calls = here.where("up IS NOT NULL").select(
        F.col("up").alias("id"), F.lit(False).alias("own"), none.alias("up"), *(zero.alias(c) for c in values + carried),
        *(F.col("with_" + v).alias("kid_" + v) for v in values), F.lit(1).cast("long").alias("kids"), F.col("id").alias("kid"))
    met = self_rows.unionByName(calls).groupBy("id").agg(
        F.max("own").alias("own"), F.max("up").alias("up"), *(F.sum(c).alias(c) for c in values + carried + borne),
        F.sum("kids").alias("kids"), F.max("kid").alias("kid")).where("own").drop("own")

    def coin(node: str) -> Column:
        return F.xxhash64(F.lit(turn), F.col(node))

    inner = F.col("up").isNotNull()
    marked = met.withColumns({
        "leaf": inner & (F.col("kids") == 0),
        "out": inner & (F.col("kids") == 1) & (coin("id") < coin("kid")) & (coin("id") < coin("up"))})

    # Leaves hand their totals up; compressed nodes offer their place to their child.
    plain = [zero.alias("raked"), none.alias("place"), *(zero.alias("add_" + c) for c in values + carried)]
    both = marked.select("id", F.lit(True).alias("own"), "up", *values, *carried, *borne, "kid", "leaf", "out", *plain)
    blank = [F.lit(False).alias("own"), none.alias("up"), *(zero.alias(c) for c in values + carried + borne),
             none.alias("kid"), F.lit(False).alias("leaf"), F.lit(False).alias("out")]
    rakes = marked.where("leaf").select(
        F.col("up").alias("id"), *blank, F.lit(1).cast("long").alias("raked"), none.alias("place"),
        *((F.col(v) + F.col("with_" + v)).alias("add_" + v) for v in values),
        *(zero.alias("add_" + c) for c in carried))
    offers = marked.where("out").select(
        F.col("kid").alias("id"), *blank, zero.alias("raked"), F.col("up").alias("place"),
        *(zero.alias("add_" + v) for v in values),
        *((F.col(v) + F.col("with_" + v)).alias("add_with_" + v) for v in values))
    told = both.unionByName(rakes).unionByName(offers).groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("own", "up", "kid", "leaf", "out", "place")), F.sum("raked").alias("raked"),
        *(F.sum(c).alias(c) for c in values + carried + borne), *(F.sum("add_" + c).alias("add_" + c) for c in values + carried))

    # A leaf takes no place; its parent, then, stays for the next round.
    moved = ~F.col("leaf") & F.col("place").isNotNull()
    compressed = F.col("out") & (F.col("raked") == 0)
    return told.where("own").select(
        "id", F.when(moved, F.col("place")).otherwise(F.col("up")).alias("up"),
        *((F.col(v) + F.col("add_" + v) + F.when(compressed, F.col("kid_" + v)).otherwise(0)).alias(v) for v in values),
        *((F.col(c) + F.when(moved, F.col("add_" + c)).otherwise(0)).alias(c) for c in carried),
        (F.col("leaf") | compressed).alias("gone"), F.when(compressed, F.col("kid")).alias("to"))


def _expanded(known: DataFrame, values: list[str]) -> DataFrame:
    """Totals of compressed nodes from the nodes their places went to."""
    while known.where("to IS NOT NULL").limit(1).count():
        far = known.select(F.col("id").alias("to"), F.col("to").alias("next"),
                           *(F.col(v).alias("far_" + v) for v in values))
        whole = known.where("to IS NULL")
        open_ = known.where("to IS NOT NULL").join(far, "to", "left").select(
            "id", F.col("next").alias("to"), *((F.col(v) + F.coalesce("far_" + v, F.lit(0))).alias(v) for v in values))
        known = saved(whole.unionByName(open_))
    return known.select("id", *values)
