"""Figures of every album at once: shared signals, coherence, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.vector import (
    dot, group_vector_sum, mean_pairwise_cosine, unit)
from siftwork.operators.order_stats import positions

# Fixed values of the album analysis.
COMMON_SHARE = 0.6
SPLIT_SHARE = 0.5
TAG_SHARE = 0.5
OUTLIERS = 3
OUTLIER_MIN_MEMBERS = 4


def ordered_members(items: DataFrame) -> DataFrame:
    """All members of each album with their place in its order and its size."""
    totals = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("members"))
    return positions(items, ["album_id"], ["position", "sample_id"], "pos").join(totals, "album_id")


def _facet_shares(items: DataFrame, attributes: DataFrame) -> DataFrame:
    members = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    counted = items.select("album_id", "sample_id").join(attributes, "sample_id").groupBy(
        "album_id", "grp", "label").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("album_id", "grp").orderBy(F.col("c").desc(), "label")
    top = counted.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= 2)
    return top.join(members, "album_id").withColumn("share", F.col("c") / F.col("n"))


def common_signals(items: DataFrame, attributes: DataFrame,
                   tags: DataFrame | None = None, vlm_tags: DataFrame | None = None) -> DataFrame:
    """``album_id, kind, grp, label, share`` carried by most members.  Shares
    are over all members, whether or not a facet abstained."""
    out = _facet_shares(items, attributes).where(
        (F.col("pos") == 1) & (F.col("share") >= COMMON_SHARE)).select(
        "album_id", F.lit("attribute").alias("kind"), "grp", "label", "share")
    members = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    for kind, table in (("tag", tags), ("vlm_tag", vlm_tags)):
        if table is None:
            continue
        counted = items.select("album_id", "sample_id").join(table, "sample_id").groupBy(
            "album_id", "tag").agg(F.count(F.lit(1)).alias("c"))
        share = F.col("c") / F.col("n")
        out = out.union(counted.join(members, "album_id").where(share >= TAG_SHARE).select(
            "album_id", F.lit(kind), F.lit(None).cast("string"), F.col("tag"), share))
    return out


def different_signals(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """Facet groups without a majority whose two leading labels cover half."""
    shares = _facet_shares(items, attributes)
    pair = shares.groupBy("album_id", "grp").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("share").alias("both"),
        F.max("share").alias("lead"),
        F.max(F.when(F.col("pos") == 1, F.col("label"))).alias("first_label"),
        F.max(F.when(F.col("pos") == 2, F.col("label"))).alias("second_label"),
        F.max(F.when(F.col("pos") == 2, F.col("share"))).alias("second_share"))
    return pair.where(
        (F.col("labels") == 2) & (F.col("lead") < COMMON_SHARE) & (F.col("both") >= SPLIT_SHARE)
    ).select("album_id", "grp", "first_label", F.col("lead").alias("first_share"),
             "second_label", "second_share")


def coherence(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine per album of two or more vectors, from their sum."""
    joined = items.select("album_id", F.col("sample_id").alias("id")).join(vectors, "id")
    sums = group_vector_sum(joined, ["album_id"])
    return sums.select("album_id", "n", mean_pairwise_cosine(F.col("total"), F.col("n")).alias(
        "coherence")).where(F.col("coherence").isNotNull())


def outliers(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """The members furthest from the album centre, for albums of four up."""
    joined = items.select("album_id", F.col("sample_id").alias("id")).join(vectors, "id")
    centres = group_vector_sum(joined, ["album_id"]).where(
        F.col("n") >= OUTLIER_MIN_MEMBERS).select("album_id", unit(F.col("total")).alias("centre"))
    scored = joined.join(centres, "album_id").select(
        "album_id", "id", dot(F.col("embedding"), F.col("centre")).alias("score"))
    order = Window.partitionBy("album_id").orderBy("score", "id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= OUTLIERS)
