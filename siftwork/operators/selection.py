"""The selection vocabulary: one description of a set, used by every job.

A selection narrows samples before anything ranks, samples or aggregates them.
Membership filters are semi-joins and stay lazy; an empty selection hands the
table back untouched, which is not the same as selecting nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.functions import text as tx



@dataclass(frozen=True)
class Selection:
    split: str | None = None
    tag: str | None = None
    vlm_tag: str | None = None
    cluster: int | None = None
    album: int | None = None
    attrs: tuple[str, ...] = ()
    axes: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)
    ids: DataFrame | tuple[str, ...] | None = None
    max_agreement: float | None = None
    box: tuple[float, float, float, float] | None = None

    def facets(self) -> list[tuple[str, str]]:
        """``group:label`` entries; one without a colon says nothing."""
        return [tuple(a.split(":", 1)) for a in self.attrs if a and ":" in a]

    def axis_bounds(self) -> dict[str, tuple[int | None, int | None]]:
        return {a: b for a, b in self.axes.items() if a in AXES and b != (None, None)}

    @property
    def is_empty(self) -> bool:
        ids_given = self.ids is not None and not (
            isinstance(self.ids, tuple) and not self.ids)
        return not (self.split or self.tag or self.vlm_tag or self.facets()
                    or self.axis_bounds() or ids_given or self.box
                    or self.cluster is not None or self.album is not None
                    or self.max_agreement is not None)

    def apply(self, corpus: Corpus, samples: DataFrame | None = None) -> DataFrame:
        """The selected rows of ``samples`` (the corpus table by default)."""
        df = corpus.samples if samples is None else samples
        if self.is_empty:
            return df
        predicate = self._row_predicate()
        if predicate is not None:
            df = df.where(predicate)
        for members in self._memberships(corpus):
            df = df.join(members, "id", "left_semi")
        return df

    def selected_ids(self, corpus: Corpus) -> DataFrame | None:
        """Selected ids, or None when nothing was asked for."""
        return None if self.is_empty else self.apply(corpus).select("id")

    def _row_predicate(self) -> Column | None:
        tests = []
        if self.split:
            tests.append(F.col("split") == self.split)
        if self.cluster is not None:
            tests.append(F.col("cluster") == self.cluster)
        for axis, (low, high) in self.axis_bounds().items():
            if low is not None:
                tests.append(F.col(axis) >= low)
            if high is not None:
                tests.append(F.col(axis) <= high)
        if self.box:
            x0, y0, x1, y1 = self.box
            tests.append(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        combined = None
        for t in tests:
            combined = t if combined is None else combined & t
        return combined

    def _memberships(self, corpus: Corpus) -> list[DataFrame]:
        sample_id = F.col("sample_id").alias("id")
        out = []
        if self.tag:
            out.append(corpus.table("sample_tags").where(F.col("tag") == self.tag).select(sample_id))
        if self.vlm_tag:
            out.append(
                corpus.table("vlm_tags").where(F.col("tag") == self.vlm_tag).select(sample_id))
        if self.album is not None:
            out.append(corpus.table("album_items").where(
                F.col("album_id") == self.album).select(sample_id))
        if self.facets():
            out.append(with_all_facets(corpus.table("attributes"), self.facets()))
        if self.ids is not None and not (isinstance(self.ids, tuple) and not self.ids):
            out.append(resolve_ids(corpus.samples, self.ids))
        if self.max_agreement is not None:
            out.append(corpus.table("captions").where(
                F.col("agreement") <= self.max_agreement).select(sample_id))
        return out


def with_all_facets(attributes: DataFrame, facets: list[tuple[str, str]]) -> DataFrame:
    """Ids carrying every listed facet, in one pass over the facet rows."""
    wanted = list(dict.fromkeys(facets))
    hit = None
    for grp, label in wanted:
        test = (F.col("grp") == grp) & (F.col("label") == label)
        hit = test if hit is None else hit | test
    return (
        attributes.where(hit).groupBy(F.col("sample_id").alias("id"))
        .agg(F.count_distinct("grp", "label").alias("k"))
        .where(F.col("k") == len(wanted)).select("id"))


def id_entries(spark: SparkSession, text: str) -> DataFrame:
    """A pasted list as rows ``pos, entry``, repeats dropped, order kept."""
    one = spark.createDataFrame([(text,)], "t string")
    return one.select(F.posexplode(tx.parse_id_entries(F.col("t"))).alias("pos", "entry"))


def resolve_ids(samples: DataFrame, ids: DataFrame | tuple[str, ...]) -> DataFrame:
    """Ids named by a list of ids and file names; unknown entries match nothing.

    Two equality joins, one per meaning of an entry, so neither side ever needs
    a nested loop; Catalyst broadcasts the list when it is small.
    """
    if isinstance(ids, DataFrame):
        entries = ids.select(F.col(ids.columns[-1]).alias("entry")).distinct()
    else:
        entries = samples.sparkSession.createDataFrame(
            [(e,) for e in dict.fromkeys(ids)], "entry string")
    is_id = tx.is_id_entry(F.col("entry"))
    numbers = entries.where(is_id).select(F.expr("try_cast(entry AS bigint)").alias("id"))
    names = entries.where(~is_id).select(F.col("entry").alias("filename"))
    by_id = samples.select("id").join(numbers, "id", "left_semi")
    by_name = samples.select("id", "filename").join(names, "filename", "left_semi").select("id")
    return by_id.union(by_name)


def ids_resolved(samples: DataFrame, ids: DataFrame | tuple[str, ...]) -> DataFrame:
    """One row: how many samples the list names, before any other filter."""
    return resolve_ids(samples, ids).agg(F.count_distinct("id").alias("ids_resolved"))


def bounded(ids: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first ``n`` ids in order, each with the full count and a truncation
    flag; the count comes from its own aggregate, not from the cut list."""
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    return (
        ids.orderBy(key).limit(n)
        .withColumn("total", total.scalar())
        .withColumn("truncated", F.col("total") > n))


def card(score: Column | None = None, basis: Column | None = None) -> list[Column]:
    """The result-card projection of a samples row with ``first_caption``."""
    axes = F.struct(*[F.col(a) for a in AXES])
    none_scored = F.coalesce(*[F.col(a) for a in AXES]).isNull()
    return [
        F.col("id"), F.col("filename"), F.col("split"), F.col("width"), F.col("height"),
        F.col("first_caption").alias("caption"),
        (score if score is not None else F.lit(None).cast("double")).alias("score"),
        (basis if basis is not None else F.lit(None).cast("string")).alias("score_basis"),
        F.when(~none_scored, axes).alias("axes"),
    ]


def map_points(corpus: Corpus) -> DataFrame:
    """Projected samples with their mean agreement and isolation."""
    mean = corpus.table("captions").groupBy(F.col("sample_id").alias("id")).agg(
        F.avg("agreement").alias("agreement"))
    isolation = F.get_json_object("axis_detail", "$.rarity.isolation").cast("double")
    return (
        corpus.samples.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .join(mean, "id", "left")
        .select("id", "x", "y", "split", F.coalesce("cluster", F.lit(0)).alias("cluster"),
                *AXES, "agreement", isolation.alias("isolation")))
