"""Dataset adapters and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.order_stats import positions

ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def adapter(name: str):
    """Register a reader that yields ``split, src_order, caption*...`` rows."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        ADAPTERS[name] = fn
        return fn
    return add


def open_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in ADAPTERS:
        raise ValueError(f"unknown dataset {name!r}, available: {sorted(ADAPTERS)}")
    return ADAPTERS[name](spark, path)


@adapter("parquet")
def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@adapter("json")
def _json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


@adapter("csv")
def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def caption_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower().startswith("caption")]


def name_rows(raw: DataFrame, order: str = "src_order", suffix: str = ".jpg") -> DataFrame:
    """Add ``filename``: split and six-digit position inside the split."""
    numbered = positions(raw, ["split"], [order], "_pos")
    return numbered.withColumn("filename", F.format_string(
        "%s_%06d" + suffix, F.col("split"), F.col("_pos"))).drop("_pos")


def caption_rows(raw: DataFrame) -> DataFrame:
    """``filename, idx, text`` from the caption columns, blank ones dropped and
    the rest renumbered."""
    cols = F.array(*[F.trim(F.col(c).cast("string")) for c in caption_columns(raw)])
    kept = F.filter(cols, lambda t: F.coalesce(t != "", F.lit(False)))
    return raw.select("filename", F.posexplode(kept).alias("idx", "text"))


def new_rows(raw: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose file name is not in the corpus yet, first copy kept."""
    fresh = raw.dropDuplicates(["filename"]).join(
        existing.select("filename"), "filename", "left_anti")
    return fresh if limit is None else fresh.orderBy("filename").limit(limit)


def work_queue(samples: DataFrame, vlm_tags: DataFrame, limit: int | None = None) -> DataFrame:
    """Samples no model has tagged, by id."""
    todo = samples.join(vlm_tags.select(F.col("sample_id").alias("id")), "id", "left_anti")
    return todo if limit is None else todo.orderBy("id").limit(limit)


def parsed_tags(answers: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """``sample_id, tag`` from model answers ``(sample_id, answer)`` holding
    ``{"tags": [...]}``, none already stored; the first ``limit`` of an answer if
    there is a limit, all otherwise."""
    tags = F.from_json("answer", "struct<tags: array<string>>")["tags"]
    clean = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))),
                     lambda t: F.coalesce(t != "", F.lit(False)))
    rows = answers.select("sample_id", F.explode(clean if limit is None else F.slice(clean, 1, limit)).alias("tag"))
    return rows.dropDuplicates().join(existing, ["sample_id", "tag"], "left_anti")
