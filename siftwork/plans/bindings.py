"""The test tables seen as corpora, in Spark and as SQL fragments.

``docs``: documents are samples, conversation turns their captions, labels and
columns their facets.  ``lines``: the same samples with document lines as
captions.  ``trail``: customers with their events as scored captions.
``parts``: parts collected into albums by the orders that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.corpus import AXES, Corpus
from siftwork.operators.order_stats import percentile_buckets
from siftwork.session import reliable_checkpoint, spread

SPLIT_SQL = ("CASE WHEN source LIKE '%8' THEN 'validation' "
             "WHEN source LIKE '%9' THEN 'test' ELSE 'train' END")
LABEL_SPLIT_SQL = "CASE label WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END"
SEGMENT_SPLIT_SQL = ("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'test' "
                     "WHEN 'MACHINERY' THEN 'validation' ELSE 'train' END")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_axes(samples: DataFrame, measures: dict[str, Column], key: str = "id") -> DataFrame:
    """Percentile axes from one measure each, joined to the samples."""
    entries = F.array(*[F.struct(F.lit(a).alias("metric"), m.cast("double").alias("value"))
                        for a, m in measures.items()])
    rows = samples.select(key, F.explode(entries).alias("e")).select(key, "e.*")
    # The fit reads the measures several times; the texts behind them once.
    scored = percentile_buckets(reliable_checkpoint(rows))
    wide = scored.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == a, F.col("bucket"))).alias(a) for a in AXES])
    return samples.join(wide, key, "left")


def doc_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("dataset"),
        F.format_string("doc_%06d.txt", "doc_id").alias("filename"),
        F.expr(SPLIT_SQL).alias("split"), F.col("n_chars").cast("int").alias("width"),
        F.size(F.split("text", "\n")).alias("height"))


def doc_attributes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")

    def facet(df: DataFrame, grp: str, label: Column, conf: Column) -> DataFrame:
        return df.select(F.col("doc_id").alias("sample_id"), F.lit(grp).alias("grp"),
                         label.alias("label"), conf.cast("double").alias("confidence"))

    mass = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return (
        facet(docs, "lang", F.col("lang"), mass)
        .union(facet(docs, "source", F.col("source"), mass))
        .union(facet(labels, "quality", F.when(F.col("quality") == 1, "good").otherwise("poor"),
                     F.lit(None)))
        .union(facet(labels, "toxic", F.when(F.col("toxic") == 1, "yes").otherwise("no"),
                     F.lit(None))))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("sample_id"),
        F.col("turn").cast("int").alias("idx"), "text",
        (F.length("text") / 2000.0).alias("agreement"))


def line_captions(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "raw"))
    return lines.select(
        (F.col("doc_id") * 1000000 + F.col("idx")).alias("id"), F.col("doc_id").alias("sample_id"),
        "idx", F.trim("raw").alias("text"), F.lit(None).cast("double").alias("agreement")).where(
        F.col("text") != "")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr(LABEL_SPLIT_SQL).alias("split"), "label")


def docs(spark: SparkSession, sf: str, axes: bool = False) -> Corpus:
    samples = doc_samples(spark, sf)
    if axes:
        labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
        samples = with_axes(samples.join(labels, "id", "left"), {
            "legibility": -F.col("width"), "rarity": F.col("height"),
            "difficulty": -F.col("quality"), "clutter": F.col("height") / F.col("width")})
        samples = samples.drop("quality").withColumn(
            "cluster", (F.col("height") / 10).cast("int")).withColumn(
            "caption_consistency", F.col("width") / (F.col("width") + 5000.0)).withColumn(
            "axis_detail", F.format_string('{"rarity": {"isolation": %d}}', "height"))
    flags = table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.explode(F.filter(F.array(
            F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good")),
            lambda t: t.isNotNull())).alias("tag"))
    return Corpus(
        samples=samples, captions=turns(spark, sf), attributes=doc_attributes(spark, sf),
        sample_tags=event_tags(spark, sf), vlm_tags=flags, vectors=vectors(spark, sf))


def lines(spark: SparkSession, sf: str) -> Corpus:
    return docs(spark, sf).with_tables(captions=line_captions(spark, sf))


def event_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("tag")).distinct()


def trail(spark: SparkSession, sf: str) -> Corpus:
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    samples = customers.select(
        F.col("c_custkey").alias("id"), F.lit("customer").alias("dataset"),
        F.col("c_name").alias("filename"), F.expr(SEGMENT_SPLIT_SQL).alias("split"),
        F.col("c_nationkey").alias("cluster"),
        (F.col("c_acctbal") / 10000.0).alias("caption_consistency"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000.0).alias("x"),
        (F.col("c_nationkey") / 25.0).alias("y"))
    captions = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("sample_id"),
        F.col("event_id").cast("int").alias("idx"), F.col("event_type").alias("text"),
        F.col("value").alias("agreement"))
    where = customers.join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("sample_id"), F.explode(F.array(
            F.struct(F.lit("nation").alias("grp"), F.col("n_name").alias("label")),
            F.struct(F.lit("segment").alias("grp"), F.col("c_mktsegment").alias("label")))).alias("f"),
        F.lit(None).cast("double").alias("confidence")).select("sample_id", "f.*", "confidence")
    return Corpus(samples=samples, captions=captions, attributes=where,
                  sample_tags=event_tags(spark, sf))


def album_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("sample_id")).agg(
        F.min("l_linenumber").cast("long").alias("position"))


def parts(spark: SparkSession, sf: str) -> Corpus:
    p = table(spark, sf, "part")
    facets = p.select(F.col("p_partkey").alias("sample_id"), F.explode(F.array(
        F.struct(F.lit("brand").alias("grp"), F.col("p_brand").alias("label")),
        F.struct(F.lit("type").alias("grp"), F.col("p_type").alias("label")))).alias("f"),
        (F.col("p_retailprice") / 10000.0).alias("confidence")).select(
        "sample_id", "f.*", "confidence")
    albums = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).cast("long").alias("cover_sample_id"))
    return Corpus(
        samples=p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename")),
        attributes=facets, albums=albums, album_items=album_items(spark, sf),
        vectors=vectors(spark, sf),
        vlm_tags=p.select(F.col("p_partkey").alias("sample_id"), F.col("p_type").alias("tag")))


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Unit mean vector of each label: ``label, embedding``."""
    from siftwork.functions.vector import group_vector_mean, unit

    means = group_vector_mean(table(spark, sf, "embeddings"), ["label"])
    return means.select("label", unit(F.col("mean")).alias("embedding"))


def page_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Page titles as search queries."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"), title.alias("text")).where(F.col("text") != "")


# ------------------------------------------------------------------ SQL fragments

FRAGMENTS: dict[str, str] = {
    "samples": f"""samples AS (
        SELECT doc_id AS id, source AS dataset, printf('doc_%06d.txt', doc_id) AS filename,
               {SPLIT_SQL} AS split, n_chars AS width,
               len(string_split(text, chr(10))) AS height FROM documents)""",
    "attributes": """attributes AS (
        SELECT doc_id AS sample_id, 'lang' AS grp, lang AS label,
               n_chars / (n_chars + 1000e0) AS confidence FROM documents
        UNION ALL SELECT doc_id, 'source', source, n_chars / (n_chars + 1000e0) FROM documents
        UNION ALL SELECT doc_id, 'quality', CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, NULL
        FROM labels
        UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END, NULL
        FROM labels)""",
    "captions": """captions AS (
        SELECT conv_id * 1000 + turn AS id, conv_id AS sample_id, turn AS idx, text,
               length(text) / 2000e0 AS agreement FROM conversations)""",
    "line_captions": """line_captions AS (
        SELECT doc_id * 1000000 + i - 1 AS id, doc_id AS sample_id, i - 1 AS idx, trim(raw) AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        WHERE trim(raw) <> '')""",
    "sample_tags": """sample_tags AS (
        SELECT DISTINCT user_id AS sample_id, event_type AS tag FROM events)""",
    "vlm_tags": """vlm_tags AS (
        SELECT doc_id AS sample_id, 'toxic' AS tag FROM labels WHERE toxic = 1
        UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1)""",
    "axis_values": """axis_values AS (
        SELECT s.id, 'legibility' AS metric, CAST(-width AS DOUBLE) AS value FROM samples s
        UNION ALL SELECT id, 'rarity', CAST(height AS DOUBLE) FROM samples
        UNION ALL SELECT doc_id, 'difficulty', CAST(-quality AS DOUBLE) FROM labels
        UNION ALL SELECT id, 'clutter', CAST(height AS DOUBLE) / width FROM samples)""",
    "scored": """buckets AS (
        SELECT id, metric, CAST(round_even(
            percent_rank() OVER (PARTITION BY metric ORDER BY value) * 10, 0) AS INT) AS bucket
        FROM axis_values),
    scored AS (
        SELECT s.*, CAST(height // 10 AS INT) AS cluster,
               width / (width + 5000e0) AS caption_consistency,
               max(bucket) FILTER (metric = 'legibility') AS legibility,
               max(bucket) FILTER (metric = 'rarity') AS rarity,
               max(bucket) FILTER (metric = 'difficulty') AS difficulty,
               max(bucket) FILTER (metric = 'clutter') AS clutter
        FROM samples s JOIN buckets USING (id) GROUP BY ALL)""",
    "customers": f"""customers AS (
        SELECT c_custkey AS id, c_name AS filename, {SEGMENT_SPLIT_SQL} AS split,
               c_nationkey AS cluster, c_acctbal / 10000e0 AS caption_consistency,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000e0 END AS x,
               c_nationkey / 25e0 AS y FROM customer)""",
    "trail": """trail AS (
        SELECT event_id AS id, user_id AS sample_id, event_type AS text, value AS agreement
        FROM events)""",
    "customer_facets": """customer_facets AS (
        SELECT c_custkey AS sample_id, 'segment' AS grp, c_mktsegment AS label FROM customer
        UNION ALL SELECT c_custkey, 'nation', n_name FROM customer
        JOIN nation ON n_nationkey = c_nationkey)""",
    "items": """items AS (
        SELECT l_orderkey AS album_id, l_partkey AS sample_id,
               CAST(min(l_linenumber) AS BIGINT) AS position FROM lineitem GROUP BY ALL)""",
    "part_facets": """part_facets AS (
        SELECT p_partkey AS sample_id, 'brand' AS grp, p_brand AS label FROM part
        UNION ALL SELECT p_partkey, 'type', p_type FROM part)""",
    "vecs": f"""vecs AS (
        SELECT vec_id AS id, label, {LABEL_SPLIT_SQL} AS split,
               CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "sims": """sims AS (
        SELECT a.id AS a_id, b.id AS b_id, list_dot_product(a.v, b.v) AS score
        FROM vecs a, vecs b)""",
    "centres": """elements AS (
        SELECT id, label, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM vecs),
    centre_elements AS (SELECT label, i, avg(e) AS e FROM elements GROUP BY ALL),
    centre_norms AS (SELECT label, sqrt(sum(e * e)) AS n FROM centre_elements GROUP BY label),
    centres AS (
        SELECT label, list(e / n ORDER BY i) AS v
        FROM centre_elements JOIN centre_norms USING (label) GROUP BY label)""",
    "queries": """queries AS (
        SELECT page_id AS query_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS text
        FROM pages WHERE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> '')""",
}


def sql(body: str, *fragments: str) -> str:
    """A query over the named fragments, in the order given."""
    return "WITH " + ",\n".join(FRAGMENTS[f] for f in fragments) + "\n" + body
