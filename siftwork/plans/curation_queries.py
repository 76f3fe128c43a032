"""Queries over curation steps, ingest, geometry, provenance and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import geometry as geo
from siftwork.operators import aggregates as ag
from siftwork.operators import curation as cu
from siftwork.operators import details
from siftwork.plans import bindings as b
from siftwork.plans.bindings import sql
from siftwork.plans.registry import query, r6
from siftwork.plans.vector_queries import _join
from siftwork.sources import builds, export, scan
from siftwork.streaming.activity import activity_windows

# ----------------------------------------------------------------------------- tags


def _wanted_tags(spark, sf):
    """Tags customers asked for, untidy, some for unknown samples."""
    orders = b.table(spark, sf, "orders")
    return orders.select(
        (F.col("o_custkey") * 2).alias("sample_id"),
        F.concat(F.lit("  "), F.when(F.col("o_orderstatus") == "F", "CLICK").when(
            F.col("o_orderstatus") == "O", "Error ").otherwise("  ")).alias("tag"))


WANTED = """
    , wanted AS (SELECT DISTINCT o_custkey * 2 AS sample_id,
        CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'error' END AS tag FROM orders),
    added AS (SELECT w.sample_id, w.tag FROM wanted w JOIN customer ON c_custkey = w.sample_id
        WHERE tag IS NOT NULL AND (w.sample_id, w.tag) NOT IN (SELECT sample_id, tag FROM sample_tags))
"""


@query("tags_to_add", _join(WANTED + "SELECT * FROM added", "sample_tags"))
def tags_to_add(spark, sf):
    return cu.tags_to_add(b.trail(spark, sf).samples, b.event_tags(spark, sf), _wanted_tags(spark, sf))


@query("bulk_tag", _join(WANTED + """
    SELECT tag, count(*) AS n FROM (SELECT * FROM sample_tags UNION ALL SELECT * FROM added) GROUP BY tag""",
    "sample_tags"))
def bulk_tag(spark, sf):
    snapshot = cu.bulk_tag(b.trail(spark, sf).samples, b.event_tags(spark, sf), _wanted_tags(spark, sf))
    return ag.tag_counts(snapshot)


@query("remove_tags", _join(WANTED + """
    SELECT sample_id, tag FROM sample_tags WHERE (sample_id, tag) NOT IN (
        SELECT sample_id, tag FROM wanted WHERE tag IS NOT NULL)""", "sample_tags"))
def remove_tags(spark, sf):
    from siftwork.functions.text import tag_name

    gone = _wanted_tags(spark, sf).select("sample_id", tag_name(F.col("tag")).alias("tag"))
    return cu.remove_tags(b.event_tags(spark, sf), gone)


@query("orphan_tags", sql("""
    SELECT DISTINCT p_type AS tag FROM part WHERE p_type NOT IN (SELECT tag FROM sample_tags)""",
    "sample_tags"))
def orphan_tags(spark, sf):
    names = b.table(spark, sf, "part").select(F.col("p_type").alias("tag"))
    return cu.orphan_tags(names, b.event_tags(spark, sf))


@query("latest_verdict", """
    SELECT user_id AS sample_id, 'verdict:' || arg_max(event_type, (ts, event_type)) AS tag
    FROM events WHERE event_type <> 'view' GROUP BY 1""")
def latest_verdict(spark, sf):
    prefix = F.when(F.col("event_type") != "view", cu.VERDICT_PREFIX).otherwise("seen:")
    calls = b.table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.concat(prefix, "event_type").alias("tag"), "ts")
    return cu.latest_verdicts(calls)


# --------------------------------------------------------------------------- albums

@query("album_from_tag", sql("""
    SELECT 1 AS album_id, sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position
    FROM sample_tags WHERE tag = 'signup'""", "sample_tags"))
def album_from_tag(spark, sf):
    return cu.album_from_tag(b.event_tags(spark, sf), "signup", 1)


@query("albums_from_tags", sql("""
    SELECT tag, sample_id, row_number() OVER (PARTITION BY tag ORDER BY sample_id) - 1 AS position
    FROM sample_tags""", "sample_tags"))
def albums_from_tags(spark, sf):
    return cu.albums_from_tags(b.event_tags(spark, sf))


@query("album_add", _join("""
    , w AS (SELECT o_orderkey AS album_id, o_custkey AS sample_id, o_orderkey % 7 AS i FROM orders),
    e AS (SELECT album_id, max(position) AS last FROM items GROUP BY 1)
    SELECT album_id, sample_id, coalesce(last + 1, 0) + i AS position
    FROM w JOIN part ON p_partkey = sample_id LEFT JOIN e USING (album_id)
    WHERE (album_id, sample_id) NOT IN (SELECT album_id, sample_id FROM items)""", "items"))
def album_add(spark, sf):
    c = b.parts(spark, sf)
    wanted = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("album_id"), F.col("o_custkey").alias("sample_id"),
        (F.col("o_orderkey") % 7).alias("i"))
    return cu.items_to_add(c.album_items, c.samples, wanted)


@query("next_positions", _join("""
    SELECT o_orderkey AS album_id, coalesce(max(position) + 1, 0) AS next_position
    FROM orders LEFT JOIN items ON album_id = o_orderkey GROUP BY 1""", "items"))
def next_positions(spark, sf):
    c = b.parts(spark, sf)
    return cu.next_positions(c.album_items, c.albums)


@query("album_compact", sql("""
    SELECT album_id, sample_id,
           row_number() OVER (PARTITION BY album_id ORDER BY position, sample_id) - 1 AS position
    FROM items""", "items"))
def album_compact(spark, sf):
    return cu.compact(b.album_items(spark, sf))


@query("album_remove", _join("""
    , gone AS (SELECT l_orderkey AS album_id, l_partkey AS sample_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT album_id, sample_id,
           row_number() OVER (PARTITION BY album_id ORDER BY position, sample_id) - 1 AS position
    FROM items WHERE (album_id, sample_id) NOT IN (SELECT album_id, sample_id FROM gone)""", "items"))
def album_remove(spark, sf):
    c = b.parts(spark, sf)
    gone = b.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("sample_id"))
    return cu.remove_items(c.albums, c.album_items, gone)[1]


@query("cleared_covers", _join("""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND NOT EXISTS (
        SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 0 AND l_returnflag = 'R')
        THEN 0 END AS cover_sample_id FROM orders""", "items"))
def cleared_covers(spark, sf):
    c = b.parts(spark, sf)
    gone = b.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("sample_id"))
    return cu.remove_items(c.albums, c.album_items, gone)[0].select("id", "cover_sample_id")


ORDER = """
    , giv AS (SELECT l_orderkey AS album_id, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1
                     THEN l_suppkey ELSE l_partkey END AS sample_id FROM lineitem),
    cnt AS (SELECT album_id, sample_id, count(*) AS times FROM giv GROUP BY ALL),
    bth AS (SELECT coalesce(c.album_id, i.album_id) AS album_id, coalesce(c.sample_id, i.sample_id) AS sample_id,
                   times, i.album_id IS NOT NULL AS member
            FROM cnt c FULL JOIN items i ON i.album_id = c.album_id AND i.sample_id = c.sample_id),
    bad AS (SELECT album_id, sample_id, 'missing' AS kind FROM bth WHERE times IS NULL
        UNION ALL SELECT album_id, sample_id, 'unknown' FROM bth WHERE NOT member
        UNION ALL SELECT album_id, sample_id, 'duplicate' FROM bth WHERE times > 1)
"""


def _given_order(spark, sf):
    line = b.table(spark, sf, "lineitem")
    wrong = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)
    return line.select(
        F.col("l_orderkey").alias("album_id"),
        F.when(wrong, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("sample_id"),
        F.col("l_linenumber").alias("i"))


@query("reorder_check", _join(ORDER + """
    SELECT album_id, kind, count(*) AS n,
           array_to_string(list(sample_id ORDER BY sample_id)[1:10], ' ') AS ids
    FROM bad GROUP BY ALL""", "items"))
def reorder_check(spark, sf):
    got = cu.order_problems(b.album_items(spark, sf), _given_order(spark, sf))
    return got.withColumn("ids", F.array_join("ids", " "))


@query("reordered", _join(ORDER + """
    , pos AS (SELECT l_orderkey AS album_id, l_partkey AS sample_id, l_linenumber AS i FROM lineitem
              WHERE l_orderkey NOT IN (SELECT album_id FROM bad))
    SELECT items.album_id, items.sample_id, CAST(coalesce(100 - i, position) AS BIGINT) AS position
    FROM items LEFT JOIN pos USING (album_id, sample_id)""", "items"))
def reordered(spark, sf):
    order = _given_order(spark, sf).withColumn("i", 100 - F.col("i"))
    return cu.reorder(b.album_items(spark, sf), order)


@query("album_summaries", _join("""
    , f AS (SELECT album_id, count(*) AS n, arg_min(sample_id, (position, sample_id)) AS first
            FROM items GROUP BY 1)
    SELECT o_orderkey AS id, coalesce(n, 0) AS items,
           CASE WHEN o_orderstatus = 'F' THEN 0 ELSE first END AS cover
    FROM orders LEFT JOIN f ON album_id = o_orderkey""", "items"))
def album_summaries(spark, sf):
    c = b.parts(spark, sf)
    return cu.album_summaries(c.albums, c.album_items).select("id", "items", "cover")


@query("missing_ids", """
    SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)""")
def missing_ids(spark, sf):
    wanted = b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return cu.missing_ids(b.vectors(spark, sf), wanted)


@query("existing_or_nothing", """
    SELECT DISTINCT l_partkey AS id FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))""")
def existing_or_nothing(spark, sf):
    wanted = b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return cu.existing_or_nothing(b.parts(spark, sf).samples, wanted)


@query("working_set", """
    SELECT user_id AS id FROM (SELECT DISTINCT user_id FROM events)
    WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def working_set(spark, sf):
    """A working set less what was dropped from it."""
    kept = b.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    dropped = b.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return kept.join(dropped, "id", "left_anti")


# ----------------------------------------------------------------- labels and views

LABELS = """
    WITH known AS (SELECT n_nationkey AS id, lower(n_name) AS name, NULL AS parent FROM nation
                   UNION ALL SELECT 100 + r_regionkey, lower(r_name), 'nation_1' FROM region),
    asked AS (SELECT DISTINCT regexp_replace(trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')), '^(?:a|an) (.)', '\\1')
                 AS name, lower(p_brand) AS parent FROM part
              UNION SELECT DISTINCT lower(r_name), lower(n_name) FROM region JOIN nation ON r_regionkey = n_regionkey
              UNION SELECT DISTINCT lower(n_name), NULL FROM nation
              UNION SELECT DISTINCT lower(p_name), NULL FROM part),
    seen AS (SELECT a.name, a.parent, k.id, coalesce(a.parent = a.name OR (k.id IS NOT NULL
                 AND a.parent IS NOT NULL AND a.parent IS DISTINCT FROM k.parent), FALSE) AS clash
             FROM asked a LEFT JOIN known k USING (name)),
    several AS (SELECT name FROM asked GROUP BY name HAVING count(DISTINCT parent) > 1)
"""


def _label_steps(spark, sf):
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    known = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                          F.lit(None).cast("long").alias("parent_id")).union(
        region.select((100 + F.col("r_regionkey")).cast("long"), "r_name", F.lit(1).cast("long")))
    part = b.table(spark, sf, "part")
    none = F.lit(None).cast("string")
    asked = part.select(F.col("p_type").alias("label_name"), F.col("p_brand").alias("parent_name")).union(
        region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")).union(
        nation.select("n_name", none)).union(part.select("p_name", none))
    return cu.resolve_labels(known, asked)


@query("label_conflicts", LABELS + """
    SELECT name, parent FROM seen WHERE clash
    UNION ALL SELECT name, parent FROM seen WHERE id IS NULL AND NOT clash AND name IN (FROM several)""")
def label_conflicts(spark, sf):
    return _label_steps(spark, sf)["conflicts"]


@query("label_new", LABELS + """
    SELECT name, max(parent) AS parent FROM seen
    WHERE id IS NULL AND NOT clash AND name NOT IN (FROM several) GROUP BY name""")
def label_new(spark, sf):
    return _label_steps(spark, sf)["new"]


@query("label_resolved", LABELS + """
    SELECT CAST(id AS BIGINT) AS id, name FROM seen WHERE id IS NOT NULL AND NOT clash""")
def label_resolved(spark, sf):
    return _label_steps(spark, sf)["resolved"]


@query("stale_views", """
    SELECT page_id AS id, page_id % 2 = 1 AS stale, string_split(url, '?')[1] AS query FROM pages""")
def stale_views(spark, sf):
    """Pages as saved views; the odd ones were stored under another model."""
    pages = b.table(spark, sf, "pages")
    model = F.when(F.col("page_id") % 2 == 1, "old").otherwise("model")
    views = pages.select(F.col("page_id").alias("id"), F.concat(
        F.split("url", r"\?")[0], F.lit("&_embed_model="), model).alias("query"))
    # Two model marks are compared; the corpus mark is absent and not stale.
    current = b.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("model").alias("embed_model"), F.col("n").cast("string").alias("corpus"))
    return cu.stale_views(views, current).select("id", "stale", "query")


@query("stale_corpus_views", """
    SELECT page_id AS id, page_id % 3 = 1 AS stale, string_split(url, '?')[1] AS query FROM pages""")
def stale_corpus_views(spark, sf):
    """Pages as saved views; every third was stored over a smaller corpus."""
    pages = b.table(spark, sf, "pages")
    now = b.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    marked = pages.withColumn("n", now.scalar()).select(F.col("page_id").alias("id"), F.concat(
        F.split("url", r"\?")[0], F.lit("&_corpus="),
        F.col("n") - F.when(F.col("page_id") % 3 == 1, 1).otherwise(0)).alias("query"))
    current = now.select(F.lit("model").alias("embed_model"), F.col("n").cast("string").alias("corpus"))
    return cu.stale_views(marked, current).select("id", "stale", "query")


@query("refused_activity", """
    SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) + 11 > 4000 THEN 'payload over 4000 characters'
           WHEN role <> 'user' THEN 'kind is not a client''s' END AS refused FROM conversations
    WHERE length(text) + 11 > 4000 OR role <> 'user'""")
def refused_activity(spark, sf):
    events = b.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("role") == "user", "search_snapshot").otherwise("album_create").alias("kind"),
        F.to_json(F.struct(F.col("text").alias("q"))).alias("payload"))
    return cu.judged_activity(events).where("refused IS NOT NULL").select("id", "refused")


@query("valid_activity", """
    SELECT conv_id * 1000 + turn AS id FROM conversations
    WHERE role = 'user' AND length(text) + 11 <= 4000""")
def valid_activity(spark, sf):
    turns = b.table(spark, sf, "conversations")
    events = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("role") == "user", "search_snapshot").otherwise("album_create").alias("kind"),
        F.to_json(F.struct(F.col("text").alias("q"))).alias("payload"))
    return cu.valid_activity(events).select("id")


@query("activity_windows", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
           time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
           event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
def windows(spark, sf):
    events = b.table(spark, sf, "events").select("ts", F.col("event_type").alias("kind"))
    return activity_windows(events)


# --------------------------------------------------------------------------- ingest

@query("caption_columns", """
    SELECT split || '_' || printf('%06d', i) || '.txt' AS filename,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS idx, trim(t) AS text
    FROM (SELECT doc_id, split, i, unnest([lang, source, NULL, ' ']) AS t, unnest([1, 2, 3, 4]) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i FROM (
            SELECT *, CASE WHEN source LIKE '%8' THEN 'validation' WHEN source LIKE '%9' THEN 'test'
                      ELSE 'train' END AS split FROM documents)))
    WHERE trim(t) <> ''""")
def caption_columns(spark, sf):
    raw = b.table(spark, sf, "documents").select(
        F.expr(b.SPLIT_SQL).alias("split"), F.col("doc_id").alias("src_order"),
        F.col("lang").alias("caption_0"), F.col("source").alias("Caption_1"),
        F.lit(None).cast("string").alias("caption_2"), F.lit(" ").alias("caption_3"))
    return scan.caption_rows(scan.name_rows(raw, suffix=".txt"))


@query("ingest_new_rows", """
    SELECT DISTINCT event_type || '_' || user_id AS filename FROM events
    WHERE event_type || '_' || user_id NOT IN (SELECT 'click_' || c_custkey FROM customer)""")
def ingest_new_rows(spark, sf):
    name = F.concat_ws("_", "event_type", "user_id")
    raw = b.table(spark, sf, "events").select(name.alias("filename"))
    stored = b.table(spark, sf, "customer").select(
        F.concat_ws("_", F.lit("click"), "c_custkey").alias("filename"))
    return scan.new_rows(raw, stored)


@query("work_queue", sql("""
    SELECT id FROM samples WHERE id NOT IN (SELECT sample_id FROM vlm_tags)""", "samples", "vlm_tags"))
def work_queue(spark, sf):
    c = b.docs(spark, sf)
    return scan.work_queue(c.samples, c.vlm_tags).select("id")


@query("parsed_tags", _join("""
    , t AS (SELECT doc_id AS sample_id, list_filter(list_transform(string_split(text, ' '),
                lambda w: lower(trim(w))), lambda w: w <> '') AS tags FROM documents)
    SELECT DISTINCT sample_id, unnest(tags) AS tag FROM t
    EXCEPT SELECT sample_id, tag FROM vlm_tags""", "vlm_tags"))
def parsed_tags(spark, sf):
    docs = b.table(spark, sf, "documents")
    answers = docs.select(F.col("doc_id").alias("sample_id"), F.to_json(F.struct(
        F.split("text", " ").alias("tags"))).alias("answer"))
    return scan.parsed_tags(answers, b.docs(spark, sf).vlm_tags)


@query("fingerprint", """
    SELECT (SELECT count(*) FROM documents) AS rows, TRUE AS order_free, TRUE AS sees_a_change""")
def fingerprint(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    plain = builds.fingerprint(docs)
    shuffled = builds.fingerprint(docs.orderBy(F.col("doc_id").desc()))
    changed = builds.fingerprint(docs.withColumn("text", F.upper("text")))
    return plain.select(
        "rows", (F.col("fingerprint") == shuffled.select("fingerprint").scalar()).alias("order_free"),
        (F.col("fingerprint") != changed.select("fingerprint").scalar()).alias("sees_a_change"))


# ---------------------------------------------------------------- export and geometry

@query("export_csv", sql("""
    SELECT id, filename, split, coalesce(c, '') AS captions, coalesce(t, '') AS tags FROM samples
    LEFT JOIN (SELECT sample_id, string_agg(text, ' | ' ORDER BY idx) AS c FROM captions GROUP BY 1) x
        ON x.sample_id = id
    LEFT JOIN (SELECT sample_id, string_agg(tag, ' ' ORDER BY tag) AS t FROM sample_tags GROUP BY 1) y
        ON y.sample_id = id""", "samples", "captions", "sample_tags"))
def export_csv(spark, sf):
    return export.flat(details.records(b.docs(spark, sf), scores=False), scores=False)


@query("export_jsonl")
def export_jsonl(spark, sf):
    c = b.docs(spark, sf)
    records = details.records(c, scores=False)
    row = export.manifest(
        spark, "split=", "none", c.samples.agg(F.count(F.lit(1))).scalar(),
        builds.fingerprint(c.vectors).select("fingerprint").scalar(),
        records.agg(F.count(F.lit(1))).scalar(), scores=False)
    return export.jsonl_lines(records, row)


@query("export_manifest", """
    SELECT (SELECT count(*) FROM documents) AS corpus_samples, 300 AS ranked_depth, FALSE AS truncated,
           (SELECT count(*) FROM documents WHERE lang = 'en') AS count""")
def export_manifest(spark, sf):
    c = b.docs(spark, sf)
    got = export.manifest(
        spark, "attr=lang:en", "none", c.samples.agg(F.count(F.lit(1))).scalar(), F.lit(""),
        c.attributes.where("grp = 'lang' AND label = 'en'").agg(F.count(F.lit(1))).scalar(),
        ranked_depth=300, truncated=False)
    return got.select("corpus_samples", "ranked_depth", "truncated", "count")


@query("geometry_check", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           l_discount * 8 BETWEEN 0 AND 1 AND l_tax * 10 BETWEEN 0 AND 1 AND l_quantity / 50 BETWEEN 0 AND 1
           AND l_quantity > 0 AND l_discount * 8 + l_quantity / 50 <= 1.0001 AND l_tax * 10 + 0.5 <= 1.0001
               AS valid
    FROM lineitem""")
def geometry_check(spark, sf):
    g = F.struct((F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 10).alias("y"),
                 (F.col("l_quantity") / 50).alias("w"), F.lit(0.5).alias("h"),
                 F.lit(None).cast("array<array<double>>").alias("points"))
    return b.table(spark, sf, "lineitem").withColumn("g", g).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        geo.valid_geometry(F.lit("rect"), F.col("g")).alias("valid"))


@query("clean_detections", """
    WITH c AS (SELECT l_orderkey AS sample_id, l_returnflag AS label, round_even(l_tax * 10, 3) AS score,
                      least(greatest(l_quantity - 10, 0), 30) / 30 AS x,
                      least(greatest(l_discount * 100, 0), 20) / 20 AS y,
                      least(greatest(l_quantity, 0), 30) / 30 AS x1,
                      least(greatest(l_discount * 100 + 5, 0), 20) / 20 AS y1 FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, label, x, y, x1, y1) AS pos
          FROM c WHERE x1 > x AND y1 > y)
    SELECT sample_id, label, round(score, 3) AS score, round(x, 6) AS x, round(y, 6) AS y,
           round(x1 - x, 6) AS w, round(y1 - y, 6) AS h FROM k WHERE pos <= 12""")
def clean_detections(spark, sf):
    boxes = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), (F.col("l_quantity") - 10).alias("x0"),
        (F.col("l_discount") * 100).alias("y0"), F.col("l_quantity").alias("x1"),
        (F.col("l_discount") * 100 + 5).alias("y1"), F.col("l_returnflag").alias("label"),
        (F.col("l_tax") * 10).alias("score"), F.lit(30).alias("width"), F.lit(20).alias("height"))
    got = geo.clean_detections(boxes)
    return got.select("sample_id", "label", "score", *[r6(c).alias(c) for c in "xywh"])
