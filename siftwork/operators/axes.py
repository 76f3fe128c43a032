"""The four review axes, from component measures to explained buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.order_stats import percentile_buckets
from siftwork.session import reliable_checkpoint

# The components of each axis, whether a low value is the hard
# end, and the phrase a component earns in its own top 30 percent.
COMPONENTS = (
    ("legibility", "blur", True, "blurred"),
    ("legibility", "luma", True, "dark"),
    ("rarity", "word_rarity", False, "rare wording"),
    ("rarity", "isolation", False, "unlike its neighbours"),
    ("difficulty", "agreement", True, "weak caption match"),
    ("difficulty", "consistency", True, "captions disagree"),
    ("clutter", "vocab", False, "many things named"),
    ("clutter", "length_sd", False, "uneven captions"),
)
NOTABLE = 0.7


def component_rows(measures: DataFrame, components=COMPONENTS) -> DataFrame:
    """Wide measures ``(id, <component>...)`` to ``id, axis, metric, raw, value``
    with the value turned so that larger is harder.  Missing ones have no row."""
    entries = [F.struct(
        F.lit(axis).alias("axis"), F.lit(name).alias("metric"),
        F.col(name).cast("double").alias("raw"),
        (-F.col(name) if low_is_hard else F.col(name)).cast("double").alias("value"))
        for axis, name, low_is_hard, _ in components if name in measures.columns]
    rows = measures.select("id", F.explode(F.array(*entries)).alias("e")).select("id", "e.*")
    return rows.where(F.col("raw").isNotNull())


def score_axes(measures: DataFrame, components=COMPONENTS) -> DataFrame:
    """``id, axis, score, detail, why``: one row per scored axis of a sample.

    Each component becomes a percentile rank, an axis averages the ones it has
    and is ranked again.  ``detail`` keeps the raw values, ``why`` names the
    components in their own hard tail.

    The fits read the measures several times, so these are written out once."""
    rows = percentile_buckets(component_rows(reliable_checkpoint(measures), components))
    phrase = F.create_map(*[F.lit(x) for _, name, _, why in components for x in (name, why)])
    share = F.col("bucket") / 10.0
    notable = F.when(share >= NOTABLE, F.struct(share.alias("p"), F.col("metric").alias("m")))
    # At most one row per component of an axis.
    merged = rows.groupBy("id", "axis").agg(
        F.avg(share).alias("value"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("metric", F.bround("raw", 4).alias("raw"))))).alias("detail"),
        F.sort_array(F.collect_list(notable), asc=False).alias("hits"))
    why = F.array_join(F.transform("hits", lambda h: phrase[h["m"]]), ", ")
    scored = percentile_buckets(
        merged.withColumn("why", F.when(F.size("hits") > 0, why)).drop("hits"), key="axis")
    return scored.select("id", "axis", F.col("bucket").alias("score"), "detail", "why")


def axes_wide(scored: DataFrame) -> DataFrame:
    """Axis rows to one row per sample, unscored axes NULL."""
    names = list(dict.fromkeys(axis for axis, *_ in COMPONENTS))
    return scored.groupBy("id").agg(
        *[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in names],
        F.map_from_entries(F.collect_list(F.struct(
            "axis", F.struct("detail", "why").alias("d")))).alias("axis_detail"))
