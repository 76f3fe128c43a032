"""Signals computed from vectors: agreement, consistency, facets, floor."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.vector import dot, group_vector_sum, mean_pairwise_cosine
from siftwork.operators import vector_blocks as vb
from siftwork.operators.order_stats import interpolated_quantile
from siftwork.operators.similarity import knn
from siftwork.session import reliable_checkpoint

# Logit scale of the zero-shot softmax, margin below which a
# group abstains.
SOFTMAX_SCALE = 100.0
MIN_MARGIN = 0.10
# Rows of a prompt bank that a task holds at a time.
PROMPTS_HELD = 10_000

# The prompt bank of the review facets.  Data, not code: a job
# may pass another table of (grp, label, prompt).
PROMPT_BANK = (
    ("setting", "indoor", "a photo taken indoors"),
    ("setting", "outdoor", "a photo taken outdoors"),
    ("time_of_day", "day", "a photo taken during the day"),
    ("time_of_day", "night", "a photo taken at night"),
    ("time_of_day", "dusk", "a photo taken at sunset or dusk"),
    ("environment", "beach/water", "a photo at the beach or in the water"),
    ("environment", "snow", "a photo in the snow"),
    ("environment", "street", "a photo on a city street"),
    ("environment", "forest", "a photo in a forest or woods"),
    ("environment", "field/park", "a photo in a grassy field or park"),
    ("environment", "mountains", "a photo in the mountains or on rocky terrain"),
    ("environment", "indoors", "a photo inside a building or room"),
    ("main_subject", "dog", "a photo of a dog"),
    ("main_subject", "person", "a photo of one person"),
    ("main_subject", "group", "a photo of a group of people"),
    ("main_subject", "child", "a photo of a child"),
    ("main_subject", "other animal", "a photo of an animal that is not a dog"),
    ("main_subject", "vehicle", "a photo of a vehicle"),
)


def caption_agreement(captions: DataFrame, caption_vectors: DataFrame,
                      vectors: DataFrame) -> DataFrame:
    """``id, sample_id, agreement``: caption against its own sample; a caption
    with either vector missing has no row."""
    own = vectors.select(F.col("id").alias("sample_id"), F.col("embedding").alias("_s"))
    return (
        captions.select("id", "sample_id").join(caption_vectors, "id").join(own, "sample_id")
        .select("id", "sample_id", dot(F.col("embedding"), F.col("_s")).alias("agreement")))


def caption_consistency(captions: DataFrame, caption_vectors: DataFrame) -> DataFrame:
    """``sample_id, n, consistency``: mean cosine between a sample's captions."""
    joined = captions.select("id", "sample_id").join(caption_vectors, "id")
    sums = group_vector_sum(joined, ["sample_id"])
    return sums.select("sample_id", "n", mean_pairwise_cosine(F.col("total"), F.col("n")).alias(
        "consistency")).where(F.col("consistency").isNotNull())


def zero_shot(vectors: DataFrame, prompts: DataFrame, min_margin: float = MIN_MARGIN,
              scale: float = SOFTMAX_SCALE) -> DataFrame:
    """``id, grp, label, confidence, margin``: the winning label per facet
    group, absent where the runner-up is too close; of equal labels the least.

    ``prompts`` is ``(grp, label, embedding)``, a bank that every task holds: a
    vector meets it inside its own batch, so nothing is exchanged.  A bank past
    ``PROMPTS_HELD`` rows is dealt into tiles; each passes over the vectors in
    turn, and the tiles' maxima and softmax sums are merged by id and group."""
    bank = prompts.select("grp", "label", "embedding")
    tiles = -(-bank.count() // PROMPTS_HELD)
    vectors = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
    if tiles > 1:
        tiles = tiles * 2  # the deal is uneven
        dealt = reliable_checkpoint(bank.withColumn("tile", F.floor(F.rand(7) * tiles)))
        parts = [reliable_checkpoint(_facet_maxima(vectors, dealt.where(F.col("tile") == i), scale)) for i in range(tiles)]
        found = _merged_maxima(reduce(DataFrame.unionByName, parts))
    else:
        found = _facet_maxima(vectors, bank, scale)
    margin = F.when(F.col("second").isNull(), 1.0).otherwise((1 - F.exp(F.col("second") - F.col("top"))) / F.col("mass"))
    return found.select("id", "grp", "label", (1 / F.col("mass")).alias("confidence"), margin.alias("margin")).where(
        F.col("margin") >= min_margin)


def _facet_maxima(vectors: DataFrame, bank: DataFrame, scale: float) -> DataFrame:
    """``id, grp, label, top, second, mass``: the greatest two logits of a group
    and its softmax sum relative to the greatest."""
    groups: dict[str, list] = {}
    for row in sorted(bank.collect(), key=lambda r: (r["grp"], r["label"])):
        groups.setdefault(row["grp"], []).append(row)
    held = [(grp, np.array([r["label"] for r in rows], object), np.array([r["embedding"] for r in rows], float))
            for grp, rows in groups.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = vb.longs(batch.column("id")), vb.matrix(batch.column("embedding"))
            for grp, labels, vectors_ in held:
                logits = np.round(m @ vectors_.T, 12) * scale  # copies of a vector tie
                top = logits.max(axis=1)
                second = pa.nulls(len(ids), pa.float64())
                if len(labels) > 1:
                    second = pa.array(np.partition(logits, -2, axis=1)[:, -2])
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "grp": pa.array([grp] * len(ids), pa.string()),
                    "label": pa.array(labels[logits.argmax(axis=1)], pa.string()), "top": top, "second": second,
                    "mass": np.exp(logits - top[:, None]).sum(axis=1)})

    return vectors.mapInArrow(run, "id long, grp string, label string, top double, second double, mass double")


def _merged_maxima(parts: DataFrame) -> DataFrame:
    """The rows of several tiles as one for each id and group; a row's parts are
    as many as the tiles."""
    rows = parts.groupBy("id", "grp").agg(
        F.array_sort(F.collect_list(F.struct("top", "second", "mass", "label"))).alias("p"), F.max("top").alias("top"))
    greatest = F.sort_array(F.concat(F.transform("p", lambda x: x["top"]), F.array_compact(
        F.transform("p", lambda x: x["second"]))), asc=False)
    return rows.select(
        "id", "grp", F.array_min(F.transform(F.filter("p", lambda x: x["top"] == F.col("top")),
                                             lambda x: x["label"])).alias("label"),
        "top", F.get(greatest, F.lit(1)).alias("second"),
        F.aggregate("p", F.lit(0.0), lambda total, x: total + x["mass"] * F.exp(x["top"] - F.col("top"))).alias("mass"))


def similarity_floor(vectors: DataFrame, q: float = 0.1, **options) -> DataFrame:
    """The 10th percentile of each vector's nearest-neighbour cosine.  The fit reads
    the cosines several times, so they are written once."""
    nearest = knn(vectors, vectors.withColumnRenamed("id", "query_id"), 1,
                  exclude_self=True, **options)
    values = reliable_checkpoint(nearest.select(F.lit("nn").alias("metric"), F.col("score").alias("value")))
    return interpolated_quantile(values, q).select(
        F.col("q_value").alias("floor"))
