"""Ordered lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.operators.details import first_captions, sibling_means

#: Each sort key with its SQL; rows that are not scored come last both ways.
SORTED_BY = {f"{axis}_{way}": f"coalesce({sign}{axis}, 1e9)"
             for axis in AXES for way, sign in (("asc", ""), ("desc", "-"))}


def axis_order(sort: str | None) -> list[Column]:
    """Columns to sort by, ids last; an unknown key means id order."""
    keys = [SORTED_BY[sort]] if sort in SORTED_BY else []
    return [F.expr(k) for k in (*keys, "id")]


def page(selected: DataFrame, number: int = 1, per_page: int = 60,
         sort: str | None = None) -> DataFrame:
    """One page of a filtered set with the total of the whole set."""
    total = selected.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        selected.orderBy(*axis_order(sort)).offset((number - 1) * per_page).limit(per_page)
        .withColumn("total", total))


def page_after(selected: DataFrame, axis: str, descending: bool, last_value: int | None,
               last_id: int, per_page: int = 60) -> DataFrame:
    """The page that follows a row, by its sort key instead of an offset: deep
    pages cost the same as the first."""
    col, same = F.col(axis), F.col("id") > last_id
    if last_value is None:
        after = col.isNull() & same
    else:
        beyond = col < last_value if descending else col > last_value
        after = beyond | ((col == last_value) & same) | col.isNull()
    sort = f"{axis}_{'desc' if descending else 'asc'}"
    return selected.where(after).orderBy(*axis_order(sort)).limit(per_page)


def album_order(selected: DataFrame, items: DataFrame, album: int) -> DataFrame:
    members = items.where(F.col("album_id") == album).select(
        F.col("sample_id").alias("id"), "position")
    return selected.join(members, "id").orderBy("position", "id")


def rerank_by_axis(ranking: DataFrame, samples: DataFrame, sort: str) -> DataFrame:
    """Retrieved rows re-ordered by an axis; scores stay those of retrieval."""
    if sort not in SORTED_BY:
        return ranking
    axis = sort[:sort.rindex("_")]
    joined = ranking.join(samples.select("id", axis), "id")
    order = Window.partitionBy("query_id").orderBy(*axis_order(sort))
    return joined.withColumn("rank", F.row_number().over(order))


def suspect_captions(corpus: Corpus, limit: int = 50, ascending: bool = True,
                     selected: DataFrame | None = None,
                     max_agreement: float | None = None) -> DataFrame:
    """Captions by agreement with the mean of their siblings.

    The list is cut first; siblings are then summed for its samples only, with
    the semi-join pushed below the aggregate."""
    scored = corpus.table("captions").where(F.col("agreement").isNotNull())
    if max_agreement is not None:
        scored = scored.where(F.col("agreement") <= max_agreement)
    samples = corpus.samples if selected is None else selected
    scored = scored.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    key = F.col("agreement").asc() if ascending else F.col("agreement").desc()
    cut = scored.orderBy(key, "id").limit(limit)
    cards = samples.select(F.col("id").alias("sample_id"), "filename", "split")
    return sibling_means(corpus.table("captions"), of=cut).join(cards, "sample_id")


def inconsistent_samples(corpus: Corpus, limit: int = 30,
                         selected: DataFrame | None = None) -> DataFrame:
    samples = corpus.samples if selected is None else selected
    cut = samples.where(F.col("caption_consistency").isNotNull()).orderBy(
        "caption_consistency", "id").limit(limit)
    near = corpus.table("captions").join(
        cut.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    first = first_captions(near).withColumnRenamed("sample_id", "id")
    return cut.join(first, "id", "left").withColumn(
        "first_caption", F.coalesce("first_caption", F.lit("")))


def rare_examples(attributes: DataFrame, k: int = 12) -> DataFrame:
    """The k most confident samples of every facet label."""
    order = Window.partitionBy("grp", "label").orderBy(
        F.col("confidence").desc_nulls_last(), "sample_id")
    return attributes.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def most_isolated(isolation: DataFrame, n: int = 100) -> DataFrame:
    return isolation.orderBy(F.col("isolation").desc(), "id").limit(n)


def newest_activity(activity: DataFrame, limit: int = 50) -> DataFrame:
    """Latest events by id; a payload that is no JSON object reads as empty or
    as a single value."""
    parsed = F.try_parse_json("payload")
    kind = F.schema_of_variant(parsed)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    as_map = F.when(parsed.isNull(), F.lit("{}")).when(is_object, F.col("payload")).otherwise(
        F.concat(F.lit('{"value":'), F.col("payload"), F.lit("}")))
    return activity.orderBy(F.col("id").desc()).limit(limit).withColumn("payload", as_map)


def strongest_pairs(pairs: DataFrame, limit: int = 200) -> DataFrame:
    return pairs.orderBy(F.col("score").desc(), "a_id", "b_id").limit(limit)
