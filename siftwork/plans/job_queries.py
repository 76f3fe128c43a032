"""Jobs that write: each query runs one and returns what a reader finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators import details
from siftwork.plans import bindings as b
from siftwork.plans.bindings import sql
from siftwork.plans.corpus_queries import RECORD
from siftwork.plans.registry import query
from siftwork.session import scratch
from siftwork.sources import builds, export
from siftwork.streaming import ingest

READ_BACK = sql(RECORD + """
    SELECT id, filename, split, coalesce(captions, '') AS captions, coalesce(tags, '') AS tags,
           (SELECT count(*) FROM samples) AS stated
    FROM samples s LEFT JOIN cap ON cap.sample_id = id LEFT JOIN tag ON tag.sample_id = id""",
    "samples", "captions", "sample_tags", "vlm_tags", "attributes").replace("\n\n    ,", ",")


def _exported(spark, sf, form: str):
    c = b.docs(spark, sf)
    records = details.records(c, scores=False)
    row = export.manifest(
        spark, "all", "none", c.samples.agg(F.count("*")).scalar(),
        builds.fingerprint(c.vectors).select("fingerprint").scalar(), records.agg(F.count("*")).scalar(), scores=False)
    path = scratch(spark)
    export.write_export(records, row, path, form)
    stated = spark.read.json(f"{path}/manifest").select("count").scalar()
    back = spark.read.json(f"{path}/data").where(F.col("id").isNotNull())
    return back.select("id", "filename", "split", F.array_join("captions", " | ").alias("captions"),
                       F.array_join("tags", " ").alias("tags"), stated.alias("stated"))


@query("export_jsonl_read_back", READ_BACK)
def export_jsonl_read_back(spark, sf):
    return _exported(spark, sf, "jsonl")


@query("export_json_read_back", READ_BACK)
def export_json_read_back(spark, sf):
    return _exported(spark, sf, "json")


@query("build_read_back", """
    SELECT 'captions' AS name, count(*) AS n, sum(conv_id) AS total FROM conversations
    UNION ALL SELECT 'vectors', count(*), sum(vec_id) FROM embeddings WHERE vec_id % 2 = 0""")
def build_read_back(spark, sf):
    """Two builds are committed; a reader finds both tables of the second."""
    root = scratch(spark)
    vectors = b.vectors(spark, sf)
    captions = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")
    builds.commit(spark, root, {"vectors": vectors, "captions": captions.where("id < 10")}, "first")
    builds.commit(spark, root, {"vectors": vectors.where("id % 2 = 0"), "captions": captions}, "second")
    found = builds.current_build(spark, root)
    one, other = (found[name].agg(F.count("*").alias("n"), F.sum("id").alias("total")).select(
        F.lit(name).alias("name"), "n", "total") for name in ("captions", "vectors"))
    return one.unionByName(other)


def _served(spark, step: str, found: dict) -> DataFrame:
    """What a reader finds: the number of tables, and of vectors and their ids."""
    vectors = found["vectors"] if found else spark.createDataFrame([], "id long")
    return vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("total")).select(
        F.lit(step).alias("step"), F.lit(len(found)).alias("tables"), "n", "total")


@query("build_after_ingest", """
    SELECT '1 built' AS step, 2 AS tables, count(*) AS n, sum(vec_id) AS total FROM embeddings WHERE vec_id % 4 > 0
    UNION ALL SELECT '2 ingested', 0, 0, 0
    UNION ALL SELECT '3 built again', 2, count(*), sum(vec_id) FROM embeddings""")
def build_after_ingest(spark, sf):
    """Rows that arrive put the build out of force until the next one."""
    root = scratch(spark)
    vectors = b.vectors(spark, sf)
    captions = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")
    old = vectors.where("id % 4 > 0")
    before, after = (builds.corpus_mark(vectors=v, captions=captions) for v in (old, vectors))
    builds.commit(spark, root, {"vectors": old, "captions": captions}, "first", corpus=before)
    first = _served(spark, "1 built", builds.current_build(spark, root, before))
    stale = _served(spark, "2 ingested", builds.current_build(spark, root, after))
    builds.commit(spark, root, {"vectors": vectors, "captions": captions}, "second", corpus=after)
    return first.unionByName(stale).unionByName(
        _served(spark, "3 built again", builds.current_build(spark, root, after)))


@query("build_race", """
    SELECT '1 in force' AS step, 1 AS tables, count(*) AS n, sum(vec_id) AS total FROM embeddings WHERE vec_id % 3 = 1
    UNION ALL SELECT '2 refused', 1, 0, 0
    UNION ALL SELECT '3 next', 1, count(*), sum(vec_id) FROM embeddings""")
def build_race(spark, sf):
    """Two writers start from one build; the one that is late is refused, and the next starts from the winner."""
    root, vectors = scratch(spark), b.vectors(spark, sf)
    base = builds.commit(spark, root, {"vectors": vectors.where("id % 3 = 0")}, "base")
    builds.commit(spark, root, {"vectors": vectors.where("id % 3 = 1")}, "quick", replaces=base)
    refused = 0
    try:
        builds.commit(spark, root, {"vectors": vectors.where("id % 3 = 2")}, "late", replaces=base)
    except builds.Superseded:
        refused = 1
    won = _served(spark, "1 in force", builds.current_build(spark, root))
    builds.commit(spark, root, {"vectors": vectors}, "next")
    late = spark.range(1).select(F.lit("2 refused").alias("step"), F.lit(refused).alias("tables"),
                                 F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    return won.unionByName(late).unionByName(_served(spark, "3 next", builds.current_build(spark, root)))


@query("stream_ingest", """
    SELECT DISTINCT lang || '/' || (doc_id // 3) AS filename FROM documents""")
def stream_ingest(spark, sf):
    """Documents land in two overlapping drops; each name is stored once."""
    docs = b.table(spark, sf, "documents").select("doc_id", F.concat_ws(
        "/", "lang", F.floor(F.col("doc_id") / 3)).alias("filename"))
    drops, target, state = (scratch(spark) for _ in range(3))
    for part in (docs.where("doc_id % 5 < 3"), docs.where("doc_id % 5 > 1")):
        names = part.select("filename")
        names.write.mode("append").parquet(drops)
        ingest.ingest_stream(ingest.read_drops(spark, drops, names.schema), target, state).awaitTermination()
    return spark.read.parquet(target).select("filename")
