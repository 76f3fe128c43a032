"""Corpus figures: counts, distributions, coverage, histograms, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.functions import text as tx

# Bins of the agreement and score histograms, the share of
# captions the default review line cuts off, the hard-tail score.
AGREEMENT_BINS = 40
SCORE_BINS = 24
REVIEW_SHARE = 0.01
HARD_TAIL = 8
MAX_POINTS = 24
MAX_PIE_POINTS = 10
MAX_TABLE_ROWS = 200


def overview(corpus: Corpus) -> DataFrame:
    """One row of counts; each is one aggregate over one table."""
    captions = corpus.table("captions").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count("agreement").alias("scored")).alias("c"))

    def members(table: str) -> Column:
        return corpus.table(table).agg(F.count_distinct("sample_id")).scalar()

    return (
        corpus.samples.agg(F.count(F.lit(1)).alias("samples"))
        .withColumn("_c", captions.scalar())
        .select("samples", F.col("_c.n").alias("captions"),
                F.col("_c.scored").alias("scored_captions"),
                members("vlm_tags").alias("enriched"),
                members("sample_tags").alias("tagged")))


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def average_caption_words(captions: DataFrame) -> DataFrame:
    return captions.agg(F.avg(tx.space_word_count(F.col("text"))).alias("avg_words"))


def size_buckets(samples: DataFrame) -> DataFrame:
    """Samples per long-side class; unknown or zero sides are left out."""
    side = F.greatest("width", "height")
    label = (F.when(side < 400, "<400px").when(side < 500, "400-499px").otherwise("500px+"))
    return (
        samples.where((F.col("width") > 0) & (F.col("height") > 0))
        .groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def caption_length_histogram(captions: DataFrame) -> DataFrame:
    """Captions per five-word class, the last one open."""
    low = F.least(F.floor(F.size(tx.plain_words(F.col("text"))) / 5) * 5, F.lit(40)).cast("int")
    name = F.when(F.col("low") < 40, F.concat_ws("-", "low", (F.col("low") + 4))).otherwise("40+")
    counted = captions.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("low", name.alias("bucket"), "n")


def word_count_distribution(captions: DataFrame, top: int = 40) -> DataFrame:
    """Captions per exact word count; those over ``top`` share one open row, so
    the counts add up.  ``mean_words`` is the mean up to ``top``, ``mean_all``
    that of all captions."""
    words = F.col("words")
    counted = captions.groupBy(tx.space_word_count(F.col("text"), trim=True).alias("words")).agg(
        F.count(F.lit(1)).alias("n"))
    classes = counted.groupBy(F.least(words, F.lit(top + 1)).cast("int").alias("words")).agg(
        F.sum("n").alias("n"), F.sum(words * F.col("n")).alias("total"))
    everything = Window.partitionBy(F.lit(1))  # top + 1 rows
    some = words <= top
    mean_words = F.sum(F.when(some, F.col("total"))).over(everything) / F.sum(F.when(some, F.col("n"))).over(everything)
    mean_all = F.sum("total").over(everything) / F.sum("n").over(everything)
    return classes.select("words", (words > top).alias("open"), "n", mean_words.alias("mean_words"),
                          mean_all.alias("mean_all"))


def top_words(captions: DataFrame, n: int = 30) -> DataFrame:
    words = captions.select(F.explode(tx.vocabulary(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "word").limit(n)


def attribute_coverage(attributes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per facet label its count and share of ALL samples, beside its group's
    labelled count, abstentions and mean confidence."""
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    labels = attributes.groupBy("grp", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf_sum"),
        F.count("confidence").alias("conf_n"))
    # The group figures come from the label counts: one scan, a tiny window.
    in_group = Window.partitionBy("grp")
    labelled = F.sum("n").over(in_group)
    return labels.select(
        "grp", "label", "n", (F.col("n") / total).alias("share"),
        labelled.alias("labelled"), F.greatest(total - labelled, F.lit(0)).alias("abstained"),
        (F.sum("conf_sum").over(in_group) / F.sum("conf_n").over(in_group)).alias(
            "mean_confidence"))


def tag_counts(sample_tags: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Members per tag; with a tag table, tags without members count zero."""
    counts = sample_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    if tags is None:
        return counts
    return tags.select("tag").distinct().join(counts, "tag", "left").fillna(0, ["n"])


def top_tags(vlm_tags: DataFrame, n: int = 40) -> DataFrame:
    return tag_counts(vlm_tags).orderBy(F.col("n").desc(), "tag").limit(n)


def dimension_counts(samples: DataFrame) -> DataFrame:
    name = F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"))
    return samples.groupBy(name.alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- histograms

def range_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, lo, hi, n`` over the observed range, empty bins present.

    The range is split evenly and values are truncated into it; the largest
    one falls past the end and belongs to the last bin."""
    seen = df.where(F.col(value).isNotNull())
    edges = seen.agg(F.min(value).alias("a"), F.max(value).alias("b")).select(F.struct(
        F.col("a").alias("lo"),
        (F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(F.lit(1.0)) / bins
         ).alias("width")).alias("e"))
    placed = seen.select(value).withColumn("_e", edges.scalar())
    index = F.least(((F.col(value) - F.col("_e.lo")) / F.col("_e.width")).cast("int"),
                    F.lit(bins - 1))
    counted = placed.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        frame.join(counted, "bin", "left").withColumn("_e", edges.scalar())
        .where(F.col("_e.lo").isNotNull())
        .select("bin",
                (F.col("_e.lo") + F.col("bin") * F.col("_e.width")).alias("lo"),
                (F.col("_e.lo") + (F.col("bin") + 1) * F.col("_e.width")).alias("hi"),
                F.coalesce("n", F.lit(0)).alias("n")))


def agreement_histogram(captions: DataFrame) -> DataFrame:
    return range_histogram(captions, "agreement", AGREEMENT_BINS)


def agreement_summary(captions: DataFrame) -> DataFrame:
    return captions.agg(
        F.count("agreement").alias("scored"), F.avg("agreement").alias("mean"),
        F.min("agreement").alias("lowest"), F.max("agreement").alias("highest"))


def review_selection(captions: DataFrame, threshold: float | Column,
                     samples: DataFrame | None = None) -> DataFrame:
    """Captions and samples at or below the line, optionally inside a set."""
    below = captions.where(F.col("agreement") <= threshold)
    if samples is not None:
        below = below.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    return below.agg(F.count(F.lit(1)).alias("captions"),
                     F.count_distinct("sample_id").alias("samples"))


def review_threshold(histogram: DataFrame, share: float = REVIEW_SHARE) -> DataFrame:
    """Upper edge of the first bin at which ``share`` of all is reached.  The
    histogram has a fixed number of bins, so one window holds it."""
    order = Window.partitionBy(F.lit(1)).orderBy("bin")
    seen = F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    cum = histogram.withColumn("seen", seen)
    return cum.agg(F.coalesce(F.min(F.when(F.col("seen") >= share, F.col("hi"))),
                              F.max("hi")).alias("threshold"))


def score_distribution(hits: DataFrame, threshold: float) -> DataFrame:
    """Histogram of ranking scores with the count below ``threshold``.

    Unlike the agreement bins this one divides by the observed range, so a
    single-valued ranking keeps everything in its first bin."""
    below = hits.agg(F.count_if(F.col("score") < threshold).alias("k"))
    return range_histogram(hits, "score", SCORE_BINS).withColumn("below", below.scalar())


def neighbour_stats(isolation: DataFrame) -> DataFrame:
    """n, p5, median and minimum of the neighbour similarity, by nearest rank."""
    from siftwork.operators.order_stats import nearest_rank

    sims = isolation.where(F.col("isolation").isNotNull()).select(
        F.lit("sim").alias("metric"), (1.0 - F.col("isolation")).alias("value"))
    return nearest_rank(sims, {"p5": 0.05, "median": 0.5, "min": 0.0}).drop("metric")


# ----------------------------------------------------------------------- slices

def hard_tail(samples: DataFrame, at: int = HARD_TAIL) -> DataFrame:
    """Samples scoring ``at`` or more on each axis; no row when none is scored."""
    counts = samples.agg(
        *[F.count_if(F.col(a) >= at).alias(a) for a in AXES],
        F.count(F.coalesce(*[F.col(a) for a in AXES])).alias("_scored"))
    return counts.where("_scored > 0").unpivot("_scored", list(AXES), "axis", "n").drop("_scored")


def slice_comparison(corpus: Corpus, grp: str) -> DataFrame:
    """Per label of one facet group: size, share and mean signals."""
    total = corpus.samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    signals = corpus.samples.select("id", *AXES, "caption_consistency")
    labelled = corpus.table("attributes").where(F.col("grp") == grp).select(
        F.col("sample_id").alias("id"), "label")
    return labelled.join(signals, "id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in AXES],
        F.avg("caption_consistency").alias("consistency")).withColumn(
        "share", F.col("n") / total)


def superlatives(slices: DataFrame) -> DataFrame:
    """Largest, rarest and hardest slice.  Slices are read largest first and a
    tie goes to the first read, then to the smaller label."""
    lead = F.struct(-F.col("n"), F.col("label"))
    scored = F.col("difficulty").isNotNull()

    def first_by(value: Column, on: Column | None = None) -> Column:
        key = F.struct(value, lead)
        return F.min_by("label", key if on is None else F.when(on, key))

    return slices.agg(
        first_by(-F.col("n")).alias("largest"), first_by(F.col("n")).alias("rarest"),
        first_by(-F.col("difficulty"), scored).alias("hardest"),
        first_by(-F.coalesce("legibility", F.lit(0.0)), scored).alias("hardest_to_see"))


def capped(points: DataFrame, limit: int = MAX_POINTS) -> DataFrame:
    """``label, value`` cut to ``limit`` points, the tail summed in one named
    remainder.  The head is picked by a top-n, so the full list is never
    ranked in one task."""
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked_head = points.orderBy(F.abs("value").desc(), "label").limit(limit)
    order = Window.partitionBy(F.lit(1)).orderBy(F.abs("value").desc(), "label")
    head = ranked_head.withColumn("pos", F.row_number().over(order)).withColumn("n", n)
    kept = head.where((F.col("n") <= limit) | (F.col("pos") < limit)).select("label", "value")
    # `kept` has at most `limit` rows, below any broadcast threshold.
    rest = points.join(kept.select("label"), "label", "left_anti").agg(
        F.count(F.lit(1)).alias("k"), F.sum("value").alias("value"))
    tail = rest.where("k > 0").select(
        F.concat(F.lit("other ("), F.col("k"), F.lit(" levels)")).alias("label"), "value")
    return kept.union(tail)


def with_shares(points: DataFrame) -> DataFrame:
    total = points.agg(F.sum("value").alias("t")).scalar()
    return points.withColumn("share", F.col("value") / total)


def table_block(rows: DataFrame, order: list, limit: int = MAX_TABLE_ROWS) -> DataFrame:
    """First ``limit`` rows of a table, each with the full row count."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(*order).limit(limit).withColumn("total_rows", total)


def observed_domain(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
