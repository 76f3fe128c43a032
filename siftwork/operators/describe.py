"""What sets a selection apart from its corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.operators.selection import Selection

# Both bars a facet must clear, and how many are shown.
MIN_FACET_COUNT = 5
MIN_ABS_Z = 2.0
MAX_FACETS = 12
TOP_CLUSTERS = 6


def _sizes(corpus: Corpus, selected: DataFrame) -> Column:
    """``struct(n, big_n)``: sizes of the set and the corpus."""
    flagged = corpus.samples.select("id").join(
        selected.select("id", F.lit(1).alias("in_set")), "id", "left")
    return flagged.agg(F.struct(
        F.count("in_set").alias("n"), F.count(F.lit(1)).alias("big_n")).alias("s")).scalar()


def z_score(k: Column, n: Column, big_k: Column, big_n: Column) -> Column:
    """Surprise of ``k`` hits in a draw of ``n`` without replacement."""
    p = big_k / big_n
    variance = n * p * (1 - p) * (big_n - n) / (big_n - 1)
    usable = (n > 1) & (big_n > 1) & (n < big_n) & (variance > 0)
    return F.when(usable, (k - n * p) / F.sqrt(variance)).otherwise(F.lit(0.0))


def facet_lift(corpus: Corpus, selection: Selection) -> DataFrame:
    """Every facet with its lift and z, groups already filtered by left out."""
    selected = selection.apply(corpus)
    marked = corpus.table("attributes").join(
        selected.select(F.col("id").alias("sample_id"), F.lit(1).alias("in_set")),
        "sample_id", "left")
    applied = sorted({grp for grp, _ in selection.facets()})
    if applied:
        marked = marked.where(~F.col("grp").isin(applied))
    counts = marked.groupBy("grp", "label").agg(
        F.count("in_set").alias("k"), F.count(F.lit(1)).alias("big_k"))
    n, big_n = F.col("_s.n"), F.col("_s.big_n")
    return counts.withColumn("_s", _sizes(corpus, selected)).select(
        "grp", "label", "k", "big_k", n.alias("n"), big_n.alias("big_n"),
        (F.col("k") / n).alias("set_share"), (F.col("big_k") / big_n).alias("corpus_share"),
        ((F.col("k") / n) / (F.col("big_k") / big_n)).alias("lift"),
        z_score(F.col("k"), n, F.col("big_k"), big_n).alias("z"))


def notable_facets(lifts: DataFrame, limit: int = MAX_FACETS) -> DataFrame:
    """Over- and under-represented facets, strongest first, per ``side``.

    An absent facet counts only where enough were expected."""
    expected = F.col("n") * F.col("corpus_share")
    side = F.when((F.col("z") >= MIN_ABS_Z) & (F.col("k") >= MIN_FACET_COUNT), "over").when(
        (F.col("z") <= -MIN_ABS_Z) & (expected >= MIN_FACET_COUNT), "under")
    kept = lifts.withColumn("side", side).where(F.col("side").isNotNull())
    strength = F.when(F.col("side") == "over", -F.col("lift")).otherwise(F.col("lift"))
    order = Window.partitionBy("side").orderBy(strength, "grp", "label")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def facet_report(lifts: DataFrame, limit: int = MAX_FACETS) -> DataFrame:
    """``notable_facets`` as shown: rounded, with the filter that drills in."""
    return notable_facets(lifts, limit).select(
        "side", "pos", F.col("grp").alias("group"), "label", F.col("k").alias("count"),
        F.bround("set_share", 4).alias("set_share"),
        F.bround("corpus_share", 4).alias("corpus_share"),
        F.bround("lift", 2).alias("lift"), F.bround("z", 1).alias("z"),
        F.concat(F.lit("attr="), "grp", F.lit(":"), "label").alias("drill"))


def axis_deltas(corpus: Corpus, selection: Selection) -> DataFrame:
    """Mean of each axis in the set and in the corpus, one pass."""
    selected = selection.apply(corpus).select("id", F.lit(True).alias("in_set"))
    rows = corpus.samples.select("id", *AXES).join(selected, "id", "left")
    means = rows.agg(*[f for a in AXES for f in (
        F.avg(a).alias(f"{a}_all"), F.avg(F.when(F.col("in_set"), F.col(a))).alias(f"{a}_set"))])
    per_axis = F.explode(F.array(*[F.struct(
        F.lit(a).alias("axis"), F.col(f"{a}_set").alias("set_mean"),
        F.col(f"{a}_all").alias("corpus_mean")) for a in AXES]))
    out = means.select(per_axis.alias("r")).select("r.*")
    return out.where(F.col("set_mean").isNotNull() & F.col("corpus_mean").isNotNull()).withColumn(
        "delta", F.col("set_mean") - F.col("corpus_mean"))


def set_counts(corpus: Corpus, selection: Selection) -> DataFrame:
    """Split counts and the largest clusters of the set: ``kind, key, n``."""
    selected = selection.apply(corpus)
    splits = selected.groupBy(F.col("split").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    clusters = (
        selected.where(F.col("cluster").isNotNull())
        .groupBy(F.col("cluster").cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "key").limit(TOP_CLUSTERS))
    return splits.select(F.lit("split").alias("kind"), "key", "n").union(
        clusters.select(F.lit("cluster").alias("kind"), "key", "n"))


def set_agreement(corpus: Corpus, selection: Selection) -> DataFrame:
    selected = selection.apply(corpus).select(
        F.col("id").alias("sample_id"), F.lit(True).alias("in_set"))
    marked = corpus.table("captions").join(selected, "sample_id", "left")
    return marked.agg(
        F.avg(F.when(F.col("in_set"), F.col("agreement"))).alias("mean_agreement"),
        F.avg("agreement").alias("corpus_mean_agreement"))


def describe_guard(corpus: Corpus, selection: Selection) -> DataFrame:
    """Set size, corpus size and the message that replaces the facets when
    there is nothing to compare."""
    selected = selection.apply(corpus)
    nothing = F.lit("Nothing matches this selection.")
    whole = F.lit("This is the whole dataset, so there is nothing to compare it against.")
    message = F.when(F.col("_s.n") == 0, nothing)
    if selection.is_empty:
        message = message.otherwise(whole)
    one = corpus.spark.range(1).withColumn("_s", _sizes(corpus, selected))
    return one.select(
        F.col("_s.n").alias("set_size"), F.col("_s.big_n").alias("corpus_size"),
        F.lit(not selection.is_empty).alias("filtered"), message.alias("message"))
