"""The tables of one corpus and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AXES = ("legibility", "rarity", "difficulty", "clutter")

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


GEOMETRY = _schema(x=_D, y=_D, w=_D, h=_D, points=T.ArrayType(T.ArrayType(_D)))

SCHEMAS: dict[str, T.StructType] = {
    "samples": _schema(
        id=_L, dataset=_S, filename=_S, split=_S, width=_I, height=_I, filesize=_L,
        x=_D, y=_D, cluster=_I, caption_consistency=_D,
        legibility=_I, rarity=_I, difficulty=_I, clutter=_I, axis_detail=_S),
    "captions": _schema(id=_L, sample_id=_L, idx=_I, text=_S, agreement=_D),
    "attributes": _schema(sample_id=_L, grp=_S, label=_S, confidence=_D),
    "sample_tags": _schema(sample_id=_L, tag=_S),
    "vlm_tags": _schema(sample_id=_L, tag=_S),
    "albums": _schema(
        id=_L, name=_S, summary=_S, category=_S, notes=_S, cover_sample_id=_L,
        origin=_S, position=_I, created_at=T.TimestampType(), updated_at=T.TimestampType()),
    "album_items": _schema(
        album_id=_L, sample_id=_L, position=_L, added_at=T.TimestampType()),
    "activity": _schema(id=_L, kind=_S, payload=_S, created_at=T.TimestampType()),
    "annotations": _schema(
        id=_L, sample_id=_L, kind=_S, geometry=GEOMETRY, label=_S,
        created_at=T.TimestampType()),
    "annotation_masks": _schema(
        annotation_id=_L, raster=T.BinaryType(), width=_I, height=_I,
        model_id=_S, model_revision=_S),
    "annotation_labels": _schema(annotation_id=_L, label_id=_L),
    "object_labels": _schema(id=_L, name=_S, parent_id=_L),
    "vectors": _schema(id=_L, embedding=T.ArrayType(T.FloatType())),
    "caption_vectors": _schema(id=_L, embedding=T.ArrayType(T.FloatType())),
}


@dataclass(frozen=True)
class Corpus:
    """One corpus: a handle on each of its tables, none of them read yet."""

    samples: DataFrame
    captions: DataFrame | None = None
    attributes: DataFrame | None = None
    sample_tags: DataFrame | None = None
    vlm_tags: DataFrame | None = None
    albums: DataFrame | None = None
    album_items: DataFrame | None = None
    activity: DataFrame | None = None
    annotations: DataFrame | None = None
    annotation_masks: DataFrame | None = None
    annotation_labels: DataFrame | None = None
    object_labels: DataFrame | None = None
    vectors: DataFrame | None = None
    caption_vectors: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.samples.sparkSession

    def table(self, name: str) -> DataFrame:
        """A table of the corpus; an absent one is empty, with its schema."""
        df = getattr(self, name)
        return df if df is not None else self.spark.createDataFrame([], SCHEMAS[name])

    def with_tables(self, **tables: DataFrame) -> "Corpus":
        return replace(self, **tables)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "Corpus":
        """Read every table that exists under ``root`` (one Parquet folder each)."""
        found = {}
        for f in fields(cls):
            path = f"{root.rstrip('/')}/{f.name}"
            if _exists(spark, path):
                found[f.name] = spark.read.parquet(path)
        return cls(**found)

    def save(self, root: str) -> None:
        """Write the present tables; samples are partitioned by split."""
        for f in fields(type(self)):
            df = getattr(self, f.name)
            if df is None:
                continue
            writer = df.write.mode("overwrite")
            if f.name == "samples" and "split" in df.columns:
                writer = writer.partitionBy("split")
            writer.parquet(f"{root.rstrip('/')}/{f.name}")


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)
