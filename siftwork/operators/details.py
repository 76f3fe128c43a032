"""Joins that assemble rows: captions, paths, annotations, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.session import reliable_checkpoint


def first_captions(captions: DataFrame) -> DataFrame:
    """``sample_id, first_caption``: the text at the smallest index."""
    return captions.groupBy("sample_id").agg(F.min_by("text", "idx").alias("first_caption"))


def with_mean_agreement(corpus: Corpus) -> DataFrame:
    mean = corpus.table("captions").groupBy(F.col("sample_id").alias("id")).agg(
        F.avg("agreement").alias("mean_agreement"))
    return corpus.samples.join(mean, "id", "left")


def captions_of_samples(corpus: Corpus) -> DataFrame:
    s = corpus.samples.select(F.col("id").alias("sample_id"), "filename", "split")
    return corpus.table("captions").join(s, "sample_id")


def sibling_means(captions: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Captions with the mean agreement of the sample's *other* scored ones.

    Sums are combined per sample and joined back, so a sample holding a third
    of all captions is one aggregate row and a splittable join, not one window
    partition.  With ``of`` only those captions are returned."""
    rows = captions if of is None else of
    scored = captions.where(F.col("agreement").isNotNull())
    if of is not None:
        scored = scored.join(of.select("sample_id").distinct(), "sample_id", "left_semi")
    sums = scored.groupBy("sample_id").agg(
        F.sum("agreement").alias("_s"), F.count(F.lit(1)).alias("_n"))
    others = F.col("_n") - F.col("agreement").isNotNull().cast("int")
    mean = (F.col("_s") - F.coalesce("agreement", F.lit(0.0))) / others
    return rows.join(sums, "sample_id", "left").withColumn(
        "sibling_mean", F.when(others > 0, mean)).drop("_s", "_n")


def label_paths(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """``id, path``: names from the root down to each label.

    Paths double in length each round, so a tree takes as many rounds as its
    depth has bits.  A label on a cycle, or below one, has a NULL path; a parent
    that does not exist ends a path."""
    known = labels.select(F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    state = labels.select("id", "name", "parent_id").join(known, "parent_id", "left").select(
        "id", F.when(F.col("known"), F.col("parent_id")).alias("above"),
        F.array("id").alias("ids"), F.array("name").alias("path"))
    while True:
        state = reliable_checkpoint(state)
        if state.where(F.col("above").isNotNull()).isEmpty():
            return state.select("id", "path")
        upper = state.select(F.col("id").alias("above"), F.col("above").alias("next"),
                             F.col("ids").alias("ids_above"), F.col("path").alias("path_above"))
        joined = state.join(upper, "above", "left")
        going = F.col("above").isNotNull()
        ids = F.when(going, F.concat("ids_above", "ids")).otherwise(F.col("ids"))
        path = F.when(going, F.concat("path_above", "path")).otherwise(F.col("path"))
        loops = F.size(F.array_distinct(ids)) < F.size(ids)
        lost = loops | path.isNull()
        state = joined.select("id", F.when(~lost, F.col("next")).alias("above"), ids.alias("ids"),
                              F.when(~lost, path).alias("path"))


def annotation_view(corpus: Corpus) -> DataFrame:
    """Annotations with their sample, mask facts and label.  The raster column
    is pruned before the join, so it is never read."""
    samples = corpus.samples.select(F.col("id").alias("sample_id"), "filename", "split")
    masks = corpus.table("annotation_masks").select(
        F.col("annotation_id").alias("id"), F.lit(True).alias("has_mask"),
        F.col("width").alias("mask_width"), F.col("height").alias("mask_height"))
    links = corpus.table("annotation_labels").select(F.col("annotation_id").alias("id"), "label_id")
    labels = corpus.table("object_labels").select(
        F.col("id").alias("label_id"), F.col("name").alias("label_name"))
    return (
        corpus.table("annotations").join(samples, "sample_id")
        .join(masks, "id", "left").join(links, "id", "left").join(labels, "label_id", "left")
        .withColumn("has_mask", F.coalesce("has_mask", F.lit(False))))


def annotation_page(annotations: DataFrame, size: int = 20, offset: int = 0) -> DataFrame:
    """One page per sample in id order, with total and next offset."""
    size = max(1, size)
    order = Window.partitionBy("sample_id").orderBy("id")
    # Counted apart from the window, so the rank limit can cut early.
    totals = annotations.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    page = annotations.withColumn("pos", F.row_number().over(order)).where(
        F.col("pos") <= offset + size).where(F.col("pos") > offset)
    end = F.least(F.lit(offset + size), F.col("total"))
    return page.join(totals, "sample_id").withColumn(
        "next_offset", F.when(end < F.col("total"), end))


def reconcile(index: DataFrame, table: DataFrame, samples_shown: int = 5) -> DataFrame:
    """Does the vector table still describe the rows?  One full outer join on
    id gives every figure; the shown orphans are the smallest ids."""
    left = index.select("id").distinct().withColumn("in_index", F.lit(1))
    right = table.select("id").distinct().withColumn("in_table", F.lit(1))
    both = left.join(right, "id", "full_outer")
    orphan = F.col("in_table").isNull()
    missing = F.col("in_index").isNull()
    shown = both.where(orphan).orderBy("id").limit(samples_shown).agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    counts = both.agg(
        F.count("in_index").alias("index_vectors"), F.count("in_table").alias("table_rows"),
        F.count_if(orphan).alias("orphan_vectors"),
        F.count_if(missing).alias("rows_without_vectors"))
    return counts.select(
        "*", ((F.col("orphan_vectors") == 0) & (F.col("rows_without_vectors") == 0)).alias(
            "consistent"),
        shown.scalar().alias("sample_orphan_ids"))


def hydrate(ranking: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a ranking; ids without a row drop out, ``rank`` keeps the order."""
    return ranking.join(rows, "id")


# ---------------------------------------------------------------------- records

def caption_lists(captions: DataFrame) -> DataFrame:
    """``id, captions``: all texts of a sample by index; a record holds its whole
    sample, whatever its size."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return captions.groupBy(F.col("sample_id").alias("id")).agg(
        F.transform(ordered, lambda s: s["text"]).alias("captions"))


def tag_lists(tags: DataFrame, name: str) -> DataFrame:
    return tags.groupBy(F.col("sample_id").alias("id")).agg(
        F.array_sort(F.collect_set("tag")).alias(name))


def facet_maps(attributes: DataFrame) -> DataFrame:
    """``id, attributes, attribute_confidence``; one entry per facet group."""
    entry = F.struct("grp", "label")
    conf = F.when(F.col("confidence").isNotNull(), F.struct("grp", "confidence"))
    return attributes.groupBy(F.col("sample_id").alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("attributes"),
        F.map_from_entries(F.array_sort(F.collect_list(conf))).alias("attribute_confidence"))


def axis_map() -> Column:
    """Axis scores as a map, unscored axes absent."""
    pairs = F.array(*[F.struct(F.lit(a).alias("k"), F.col(a).cast("int").alias("v")) for a in AXES])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def records(corpus: Corpus, selected: DataFrame | None = None, scores: bool = True) -> DataFrame:
    """Export records of the selected samples (all of them by default).

    The selection is pushed into every side table before it is grouped."""
    base = corpus.samples if selected is None else corpus.samples.join(
        selected.select("id"), "id", "left_semi")

    def side(name: str) -> DataFrame:
        df = corpus.table(name)
        if selected is None:
            return df
        return df.join(selected.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")

    none = F.array().cast("array<string>")
    out = (
        base.join(caption_lists(side("captions")), "id", "left")
        .join(tag_lists(side("sample_tags"), "tags"), "id", "left"))
    cols = ["id", "filename", "split",
            F.coalesce("captions", none).alias("captions"), F.coalesce("tags", none).alias("tags")]
    if scores:
        mean = side("captions").groupBy(F.col("sample_id").alias("id")).agg(
            F.avg("agreement").alias("_m"))
        out = out.join(facet_maps(side("attributes")), "id", "left").join(mean, "id", "left")
        cols += [
            axis_map().alias("axes"), "cluster",
            F.bround("caption_consistency", 4).alias("caption_consistency"),
            F.bround("_m", 4).alias("mean_agreement"), "attributes",
            F.transform_values("attribute_confidence", lambda _k, v: F.bround(v, 4)).alias(
                "attribute_confidence")]
    return out.select(*cols)


def sample_details(corpus: Corpus, selected: DataFrame | None = None) -> DataFrame:
    """Everything stored about each sample, as one record."""
    vlm = corpus.table("vlm_tags")
    if selected is not None:
        vlm = vlm.join(selected.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    none = F.array().cast("array<string>")
    return records(corpus, selected).join(tag_lists(vlm, "vlm_tags"), "id", "left").withColumn(
        "vlm_tags", F.coalesce("vlm_tags", none))


def compare_pairs(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """Stored signals of sample pairs ``(a_id, b_id)`` side by side.

    Facets as ``{group: [a, b]}`` with the count that agree, tags shared and
    on one side only."""
    info = (
        corpus.samples.select("id", "split", "cluster")
        .join(facet_maps(corpus.table("attributes")).select("id", "attributes"), "id", "left")
        .join(tag_lists(corpus.table("vlm_tags"), "tags"), "id", "left"))
    none = F.array().cast("array<string>")
    empty = F.map_from_arrays(none, none)

    def side(p: str) -> DataFrame:
        return info.select(
            F.col("id").alias(f"{p}_id"), F.col("split").alias(f"{p}_split"),
            F.col("cluster").alias(f"{p}_cluster"),
            F.coalesce("attributes", empty).alias(f"{p}_attr"),
            F.coalesce("tags", none).alias(f"{p}_tags"))

    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    groups = F.array_sort(F.array_union(F.map_keys("a_attr"), F.map_keys("b_attr")))
    facets = F.transform(groups, lambda g: F.struct(
        g.alias("grp"), F.col("a_attr")[g].alias("a"), F.col("b_attr")[g].alias("b")))
    same = F.size(F.filter(F.col("facets"), lambda f: f["a"] == f["b"]))
    return both.withColumn("facets", facets).select(
        *pairs.columns, "a_split", "b_split",
        (F.col("a_split") == F.col("b_split")).alias("same_split"),
        F.coalesce(F.col("a_cluster") == F.col("b_cluster"), F.lit(False)).alias("same_cluster"),
        "facets", same.alias("facets_equal"),
        F.array_intersect("a_tags", "b_tags").alias("tags_shared"),
        F.array_except("a_tags", "b_tags").alias("tags_only_a"),
        F.array_except("b_tags", "a_tags").alias("tags_only_b"))
