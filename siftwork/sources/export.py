"""Export sinks with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.corpus import AXES

# What the exported numbers mean, for a reader who did not run
# the query.
AXIS_SEMANTICS = "0-10 percentile ranks over this corpus; not comparable across datasets"
ATTRIBUTE_SEMANTICS = (
    "per-group zero-shot argmax over a fixed prompt bank, recorded only where the winner leads "
    "by the margin; groups are scored independently and may contradict each other")


def manifest(spark: SparkSession, query: str, model: str, corpus_samples: Column,
             fingerprint: Column, count: Column, ranked_depth: int | None = None,
             truncated: bool | None = None, scores: bool = True) -> DataFrame:
    """One row that says where an export came from.  Figures are subqueries of
    the tables themselves."""
    return spark.range(1).select(
        F.lit(query).alias("query"), F.lit(model).alias("embed_model"),
        corpus_samples.alias("corpus_samples"), fingerprint.alias("embeddings_fingerprint"),
        F.lit(ranked_depth).cast("int").alias("ranked_depth"),
        F.lit(truncated).cast("boolean").alias("truncated"), F.lit(scores).alias("scores"),
        F.lit(AXIS_SEMANTICS).alias("axis_semantics"),
        F.lit(ATTRIBUTE_SEMANTICS).alias("attribute_semantics"), count.alias("count"))


def flat(records: DataFrame, scores: bool = True) -> DataFrame:
    """Positional form: five base columns, then the scores appended, so that a
    reader by index keeps working."""
    cols = ["id", "filename", "split", F.array_join("captions", " | ").alias("captions"),
            F.array_join("tags", " ").alias("tags")]
    if scores:
        cols += [F.col("axes")[a].alias(a) for a in AXES]
        cols += ["cluster", "caption_consistency", "mean_agreement"]
    return records.orderBy("id").select(*cols)


def write_export(records: DataFrame, manifest_row: DataFrame, path: str, fmt: str) -> None:
    """Write records as ``json``, ``jsonl`` or ``csv`` under ``path``.

    Data files are written in parallel with the manifest beside them; the JSON
    lines form also carries it as the first record of the first file."""
    manifest_row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if fmt == "csv":
        flat(records, "axes" in records.columns).write.mode("overwrite").option(
            "header", True).option("escape", '"').csv(f"{path}/data")
    elif fmt == "jsonl":
        jsonl_lines(records, manifest_row).write.mode("overwrite").text(f"{path}/data")
    elif fmt == "json":
        records.write.mode("overwrite").json(f"{path}/data")
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def jsonl_lines(records: DataFrame, manifest_row: DataFrame) -> DataFrame:
    """The single-stream form: a manifest line, then one line per record."""
    m = F.struct(*[F.col(c) for c in manifest_row.columns if c != "count"])
    head = manifest_row.select(
        F.lit(0).alias("line"), F.lit(None).cast("long").alias("id"),
        F.to_json(F.struct(m.alias("_manifest"), F.col("count"))).alias("value"))
    body = records.select(
        F.lit(1).alias("line"), "id",
        F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value"))
    return head.union(body).orderBy("line", F.col("id").asc_nulls_first()).select("value")
