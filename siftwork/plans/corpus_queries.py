"""Queries over counts, distributions, selections, records and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import aggregates as ag
from siftwork.operators import details, listing
from siftwork.operators import selection as sel
from siftwork.operators.order_stats import percentile_buckets, scaled_to_observed
from siftwork.operators.selection import Selection
from siftwork.plans import bindings as b
from siftwork.plans.bindings import sql
from siftwork.plans.registry import query, r6
from siftwork.sources import report

# ------------------------------------------------------------------------ overview


@query("overview", sql("""
    SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM captions) AS captions,
           (SELECT count(agreement) FROM captions) AS scored_captions,
           (SELECT count(DISTINCT sample_id) FROM vlm_tags) AS enriched,
           (SELECT count(DISTINCT sample_id) FROM sample_tags) AS tagged""",
    "samples", "captions", "vlm_tags", "sample_tags"))
def overview(spark, sf):
    return ag.overview(b.docs(spark, sf))


@query("split_counts", sql(
    "SELECT split, count(*) AS n FROM samples GROUP BY split", "samples"))
def split_counts(spark, sf):
    return ag.split_counts(b.doc_samples(spark, sf))


@query("average_caption_words", sql("""
    SELECT round(avg(length(text) - length(replace(text, ' ', '')) + 1), 6) AS avg_words
    FROM line_captions""", "line_captions"))
def average_caption_words(spark, sf):
    return ag.average_caption_words(b.line_captions(spark, sf)).select(
        r6("avg_words").alias("avg_words"))


@query("size_buckets", sql("""
    SELECT CASE WHEN greatest(width, height) < 400 THEN '<400px'
                WHEN greatest(width, height) < 500 THEN '400-499px' ELSE '500px+' END AS bucket,
           count(*) AS n
    FROM samples WHERE width > 0 AND height > 0 GROUP BY ALL""", "samples"))
def size_buckets(spark, sf):
    return ag.size_buckets(b.doc_samples(spark, sf))


@query("length_hist", sql("""
    SELECT CAST(low AS INT) AS low,
           CASE WHEN low < 40 THEN low || '-' || (low + 4) ELSE '40+' END AS bucket, count(*) AS n
    FROM (SELECT least(len(regexp_extract_all(lower(text), '[a-z'']+')) // 5 * 5, 40) AS low
          FROM line_captions) GROUP BY low""", "line_captions"))
def length_hist(spark, sf):
    return ag.caption_length_histogram(b.line_captions(spark, sf))


@query("word_count_dist", sql("""
    SELECT CAST(least(words, 41) AS INT) AS words, words > 40 AS open, sum(n)::BIGINT AS n,
           round(any_value(mean_words), 6) AS mean_words, round(any_value(mean_all), 6) AS mean_all
    FROM (SELECT words, n, sum(words * n) FILTER (words <= 40) OVER () / sum(n) FILTER (words <= 40) OVER ()
                     AS mean_words, sum(words * n) OVER () / sum(n) OVER () AS mean_all
          FROM (SELECT length(trim(text)) - length(replace(trim(text), ' ', '')) + 1 AS words,
                       count(*) AS n FROM line_captions GROUP BY 1)) GROUP BY 1, 2""", "line_captions"))
def word_count_dist(spark, sf):
    return ag.word_count_distribution(b.line_captions(spark, sf)).withColumns(
        {"mean_words": r6("mean_words"), "mean_all": r6("mean_all")})


STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query("top_words", sql(f"""
    SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM line_captions)
    WHERE length(word) > 2 AND word NOT IN ({STOP_SQL})
    GROUP BY word ORDER BY n DESC, word LIMIT 30""", "line_captions"))
def top_words(spark, sf):
    return ag.top_words(b.line_captions(spark, sf))


@query("facet_coverage", sql("""
    SELECT grp, label, n, round(n / (SELECT count(*) FROM samples), 6) AS share,
           CAST(sum(n) OVER g AS BIGINT) AS labelled,
           CAST(greatest((SELECT count(*) FROM samples) - sum(n) OVER g, 0) AS BIGINT) AS abstained,
           round(sum(cs) OVER g / nullif(sum(cn) OVER g, 0), 6) AS mean_confidence
    FROM (SELECT grp, label, count(*) AS n, sum(confidence) AS cs, count(confidence) AS cn
          FROM attributes GROUP BY ALL) WINDOW g AS (PARTITION BY grp)""", "samples", "attributes"))
def facet_coverage(spark, sf):
    c = b.docs(spark, sf)
    return ag.attribute_coverage(c.attributes, c.samples).select(
        "grp", "label", "n", r6("share").alias("share"), "labelled", "abstained",
        r6("mean_confidence").alias("mean_confidence"))


@query("tag_counts", sql("""
    SELECT t.tag, count(s.sample_id) AS n FROM (
        SELECT DISTINCT event_type AS tag FROM events UNION SELECT DISTINCT p_type FROM part) t
    LEFT JOIN sample_tags s USING (tag) GROUP BY t.tag""", "sample_tags"))
def tag_counts(spark, sf):
    names = b.table(spark, sf, "events").select(F.col("event_type").alias("tag")).union(
        b.table(spark, sf, "part").select("p_type"))
    return ag.tag_counts(b.event_tags(spark, sf), names)


@query("top_model_tags", sql("""
    SELECT tag, count(*) AS n FROM vlm_tags GROUP BY tag ORDER BY n DESC, tag LIMIT 40""",
    "vlm_tags"))
def top_model_tags(spark, sf):
    return ag.top_tags(b.docs(spark, sf).vlm_tags)


@query("dimension_counts", sql("""
    SELECT width || '×' || height AS dimensions, count(*) AS n FROM samples GROUP BY ALL""",
    "samples"))
def dimension_counts(spark, sf):
    return ag.dimension_counts(b.doc_samples(spark, sf))


# ---------------------------------------------------------------- agreement and QA

@query("agreement_hist", sql("""
    , e AS (SELECT min(agreement) AS lo, max(agreement) AS hi FROM trail),
    w AS (SELECT lo, (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / 40 AS width FROM e)
    SELECT CAST(i AS INT) AS bin, round(lo + i * width, 6) AS lo,
           round(lo + (i + 1) * width, 6) AS hi, count(agreement) AS n
    FROM w CROSS JOIN range(40) r(i) LEFT JOIN trail
      ON least(CAST(trunc((agreement - lo) / width) AS INT), 39) = i
    GROUP BY i, lo, width""", "trail").replace("\n\n    ,", ","))
def agreement_hist(spark, sf):
    h = ag.agreement_histogram(b.trail(spark, sf).captions)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("agreement_summary", sql("""
    SELECT count(agreement) AS scored, round(avg(agreement), 6) AS mean,
           min(agreement) AS lowest, max(agreement) AS highest FROM trail""", "trail"))
def agreement_summary(spark, sf):
    return ag.agreement_summary(b.trail(spark, sf).captions).withColumn("mean", r6("mean"))


@query("agreement_selection", sql("""
    SELECT count(*) AS captions, count(DISTINCT sample_id) AS samples
    FROM trail JOIN customers c ON c.id = sample_id
    WHERE agreement <= 5.0 AND split = 'train'""", "trail", "customers"))
def agreement_selection(spark, sf):
    c = b.trail(spark, sf)
    return ag.review_selection(c.captions, 5.0, Selection(split="train").apply(c))


@query("review_threshold", sql("""
    , e AS (SELECT min(agreement) AS lo, max(agreement) AS hi FROM trail),
    w AS (SELECT lo, (hi - lo) / 40 AS width FROM e),
    h AS (SELECT least(CAST(trunc((agreement - lo) / width) AS INT), 39) AS i, count(*) AS n
          FROM trail, w GROUP BY 1),
    c AS (SELECT i, sum(n) OVER (ORDER BY i) / sum(n) OVER () AS seen FROM h)
    SELECT round(lo + (min(i) + 1) * any_value(width), 6) AS threshold
    FROM c, w WHERE seen >= 0.01 GROUP BY lo""", "trail").replace("\n\n    ,", ","))
def review_threshold(spark, sf):
    h = ag.agreement_histogram(b.trail(spark, sf).captions)
    return ag.review_threshold(h).select(r6("threshold").alias("threshold"))


@query("suspects", sql("""
    , s AS (SELECT sample_id, sum(agreement) AS total, count(agreement) AS k FROM trail GROUP BY 1)
    SELECT t.id, t.sample_id, c.filename, c.split, t.text, t.agreement,
           round(CASE WHEN k > 1 THEN (total - agreement) / (k - 1) END, 9) AS sibling_mean
    FROM trail t JOIN customers c ON c.id = t.sample_id JOIN s USING (sample_id)
    WHERE c.split = 'train'
    ORDER BY t.agreement, t.id LIMIT 50""", "trail", "customers").replace("\n\n    ,", ","))
def suspects(spark, sf):
    c = b.trail(spark, sf)
    got = listing.suspect_captions(c, 50, selected=Selection(split="train").apply(c))
    return got.select("id", "sample_id", "filename", "split", "text", "agreement",
                      F.round("sibling_mean", 9).alias("sibling_mean"))


@query("siblings", sql("""
    , s AS (SELECT sample_id, sum(agreement) AS total, count(agreement) AS k FROM trail GROUP BY 1)
    SELECT id, sample_id,
           round(CASE WHEN k > 1 THEN (total - agreement) / (k - 1) END, 9) AS sibling_mean
    FROM trail JOIN s USING (sample_id)""", "trail").replace("\n\n    ,", ","))
def siblings(spark, sf):
    return details.sibling_means(b.trail(spark, sf).captions).select(
        "id", "sample_id", F.round("sibling_mean", 9).alias("sibling_mean"))


@query("inconsistent_samples", sql("""
    , f AS (SELECT sample_id, arg_min(text, idx) AS t FROM captions GROUP BY 1)
    SELECT id, round(caption_consistency, 6) AS caption_consistency, coalesce(t, '') AS first_caption
    FROM scored LEFT JOIN f ON f.sample_id = id
    ORDER BY scored.caption_consistency, id LIMIT 30""",
    "samples", "captions", "axis_values", "scored").replace("\n\n    ,", ","))
def inconsistent_samples(spark, sf):
    return listing.inconsistent_samples(b.docs(spark, sf, axes=True)).select(
        "id", r6("caption_consistency").alias("caption_consistency"), "first_caption")


# ------------------------------------------------------------------------ selection

@query("sel_split", sql("SELECT id, filename FROM samples WHERE split = 'validation'", "samples"))
def sel_split(spark, sf):
    c = b.docs(spark, sf)
    return Selection(split="validation").apply(c).select("id", "filename")


@query("sel_tag", sql("""
    SELECT id FROM samples WHERE id IN (SELECT sample_id FROM sample_tags WHERE tag = 'purchase')""",
    "samples", "sample_tags"))
def sel_tag(spark, sf):
    return Selection(tag="purchase").apply(b.docs(spark, sf)).select("id")


@query("sel_model_tag", sql("""
    SELECT id FROM samples WHERE id IN (SELECT sample_id FROM vlm_tags WHERE tag = 'toxic')""",
    "samples", "vlm_tags"))
def sel_model_tag(spark, sf):
    return Selection(vlm_tag="toxic").apply(b.docs(spark, sf)).select("id")


@query("sel_facets", sql("""
    SELECT id, split FROM samples s
    WHERE EXISTS (SELECT 1 FROM attributes a WHERE a.sample_id = s.id AND grp = 'lang' AND label = 'en')
      AND EXISTS (SELECT 1 FROM attributes a WHERE a.sample_id = s.id
                  AND grp = 'quality' AND label = 'good')""", "samples", "attributes"))
def sel_facets(spark, sf):
    chosen = Selection(attrs=("lang:en", "quality:good", "no colon here"))
    return chosen.apply(b.docs(spark, sf)).select("id", "split")


@query("sel_axis_range", sql("""
    SELECT id, legibility, difficulty FROM scored
    WHERE legibility >= 3 AND legibility <= 7 AND difficulty >= 1""",
    "samples", "axis_values", "scored"))
def sel_axis_range(spark, sf):
    chosen = Selection(axes={"legibility": (3, 7), "difficulty": (1, None)})
    return chosen.apply(b.docs(spark, sf, axes=True)).select("id", "legibility", "difficulty")


@query("sel_cluster", sql("""
    SELECT id FROM customers WHERE cluster = 7""", "customers"))
def sel_cluster(spark, sf):
    return Selection(cluster=7).apply(b.trail(spark, sf)).select("id")


@query("sel_id_list", sql("""
    SELECT DISTINCT id, filename FROM samples
    WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error')
       OR filename IN (SELECT printf('doc_%06d.txt', conv_id * 3) FROM conversations)""", "samples"))
def sel_id_list(spark, sf):
    ids = b.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("entry"))
    names = b.table(spark, sf, "conversations").select(
        F.format_string("doc_%06d.txt", F.col("conv_id") * 3))
    return Selection(ids=ids.union(names)).apply(b.docs(spark, sf)).select("id", "filename")


@query("ids_resolved", sql("""
    SELECT count(*) AS ids_resolved FROM samples
    WHERE id IN (SELECT o_custkey FROM orders)
       OR filename IN (SELECT o_orderpriority FROM orders)""", "samples"))
def ids_resolved(spark, sf):
    orders = b.table(spark, sf, "orders")
    entries = orders.select(F.col("o_custkey").cast("string").alias("entry")).union(
        orders.select("o_orderpriority"))
    return sel.ids_resolved(b.doc_samples(spark, sf), entries)


@query("parsed_id_lists", """
    SELECT doc_id, CAST(pos AS INT) AS pos, entry FROM (
        SELECT doc_id, unnest(entries) AS entry, generate_subscripts(entries, 1) - 1 AS pos FROM (
            SELECT doc_id, list_filter(list_transform(
                string_split(replace(replace(text, chr(13), ','), chr(10), ','), ','),
                lambda x: trim(x)), lambda x: x <> '') AS raw,
                list_transform(list_filter(list_zip(raw, range(len(raw))),
                    lambda x: list_position(raw, x[1]) = x[2] + 1), lambda x: x[1]) AS entries
            FROM documents))""")
def parsed_id_lists(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.parse_id_entries(F.col("text"))).alias("pos", "entry"))


@query("sel_max_agreement", sql("""
    SELECT id FROM customers WHERE id IN (SELECT sample_id FROM trail WHERE agreement <= 1.5)""",
    "customers", "trail"))
def sel_max_agreement(spark, sf):
    return Selection(max_agreement=1.5).apply(b.trail(spark, sf)).select("id")


@query("sel_album", sql("""
    SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT sample_id FROM items WHERE album_id = 7)""",
    "items"))
def sel_album(spark, sf):
    return Selection(album=7).apply(b.parts(spark, sf)).select("id")


@query("sel_box", sql("""
    SELECT id, x, y FROM customers WHERE x BETWEEN 0.2 AND 0.6 AND y BETWEEN 0.1 AND 0.5""", "customers"))
def sel_box(spark, sf):
    return Selection(box=(0.2, 0.1, 0.6, 0.5)).apply(b.trail(spark, sf)).select("id", "x", "y")


@query("sel_composed_filters", sql("""
    SELECT id FROM customers c
    WHERE split = 'train' AND cluster = 3
      AND EXISTS (SELECT 1 FROM customer_facets f WHERE f.sample_id = c.id
                  AND grp = 'segment' AND label = 'BUILDING')
      AND c.id IN (SELECT sample_id FROM sample_tags WHERE tag = 'click')""",
    "customers", "customer_facets", "sample_tags"))
def sel_composed_filters(spark, sf):
    chosen = Selection(split="train", cluster=3, attrs=("segment:BUILDING",), tag="click")
    return chosen.apply(b.trail(spark, sf)).select("id")


@query("bounded_ids", sql("""
    SELECT id, (SELECT count(*) FROM samples WHERE split <> 'train') AS total,
           (SELECT count(*) FROM samples WHERE split <> 'train') > 100 AS truncated
    FROM samples WHERE split <> 'train' ORDER BY id LIMIT 100""", "samples"))
def bounded_ids(spark, sf):
    held_out = b.doc_samples(spark, sf).where("split <> 'train'").select("id")
    return sel.bounded(held_out, 100)


@query("cards", sql("""
    , f AS (SELECT sample_id, arg_min(text, idx) AS t FROM captions GROUP BY 1)
    SELECT id, filename, split, width, height, t AS caption,
           legibility, rarity, difficulty, clutter
    FROM scored LEFT JOIN f ON f.sample_id = id""",
    "samples", "captions", "axis_values", "scored").replace("\n\n    ,", ","))
def cards(spark, sf):
    c = b.docs(spark, sf, axes=True)
    first = details.first_captions(c.captions).withColumnRenamed("sample_id", "id")
    got = c.samples.join(first, "id", "left").select(*sel.card())
    return got.select("id", "filename", "split", F.col("width").cast("long").alias("width"),
                      F.col("height").cast("long").alias("height"), "caption", "axes.*")


@query("map_points", sql("""
    , m AS (SELECT sample_id, avg(agreement) AS a FROM trail GROUP BY 1)
    SELECT id, x, y, split, coalesce(cluster, 0) AS cluster, round(a, 6) AS agreement
    FROM customers LEFT JOIN m ON sample_id = id WHERE x IS NOT NULL AND y IS NOT NULL""",
    "customers", "trail").replace("\n\n    ,", ","))
def map_points(spark, sf):
    c = b.trail(spark, sf)
    blank = c.samples
    for a in ("legibility", "rarity", "difficulty", "clutter"):
        blank = blank.withColumn(a, F.lit(None).cast("int"))
    got = sel.map_points(c.with_tables(samples=blank.withColumn(
        "axis_detail", F.lit(None).cast("string"))))
    return got.select("id", "x", "y", "split", "cluster", r6("agreement").alias("agreement"))


# --------------------------------------------------------------------------- slices

@query("hard_tail", sql("""
    SELECT metric AS axis, count(*) FILTER (bucket >= 8) AS n FROM buckets GROUP BY metric""",
    "samples", "axis_values", "scored"))
def hard_tail(spark, sf):
    return ag.hard_tail(b.docs(spark, sf, axes=True).samples)


SLICES = """SELECT label, count(*) AS n, round(avg(difficulty), 6) AS difficulty,
    round(avg(rarity), 6) AS rarity, round(avg(clutter), 6) AS clutter,
    round(avg(legibility), 6) AS legibility, round(avg(caption_consistency), 6) AS consistency,
    round(count(*) / (SELECT count(*) FROM samples), 6) AS share
    FROM attributes JOIN scored ON id = sample_id WHERE grp = 'lang' GROUP BY label"""


@query("slice_compare", sql(SLICES, "samples", "attributes", "axis_values", "scored"))
def slice_compare(spark, sf):
    got = ag.slice_comparison(b.docs(spark, sf, axes=True), "lang")
    return got.select("label", "n", *[r6(c).alias(c) for c in (
        "difficulty", "rarity", "clutter", "legibility", "consistency", "share")])


@query("superlatives", sql(f"""
    , t AS ({SLICES})
    SELECT (SELECT label FROM t ORDER BY n DESC, label LIMIT 1) AS largest,
           (SELECT label FROM t ORDER BY n, label LIMIT 1) AS rarest,
           (SELECT label FROM t WHERE difficulty IS NOT NULL
            ORDER BY difficulty DESC, n DESC, label LIMIT 1) AS hardest,
           (SELECT label FROM t WHERE difficulty IS NOT NULL
            ORDER BY coalesce(legibility, 0) DESC, n DESC, label LIMIT 1) AS hardest_to_see""",
    "samples", "attributes", "axis_values", "scored").replace("\n\n    ,", ","))
def superlatives(spark, sf):
    return ag.superlatives(ag.slice_comparison(b.docs(spark, sf, axes=True), "lang"))


@query("capped_categories", sql("""
    , p AS (SELECT label, count(*) AS value FROM attributes WHERE grp = 'source' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS pos, count(*) OVER () AS k FROM p)
    SELECT label, value FROM r WHERE k <= 10 OR pos < 10
    UNION ALL
    SELECT 'other (' || count(*) || ' levels)', CAST(sum(value) AS BIGINT) FROM r
    WHERE k > 10 AND pos >= 10 HAVING count(*) > 0""", "attributes").replace("\n\n    ,", ","))
def capped_categories(spark, sf):
    points = b.doc_attributes(spark, sf).where("grp = 'source'").groupBy("label").agg(
        F.count(F.lit(1)).alias("value"))
    return ag.capped(points, ag.MAX_PIE_POINTS)


@query("distribution_shares", sql("""
    SELECT label, CAST(count(*) AS DOUBLE) AS value,
           round(count(*) / (SELECT count(*) FROM attributes WHERE grp = 'lang'), 6) AS share
    FROM attributes WHERE grp = 'lang' GROUP BY label""", "attributes"))
def distribution_shares(spark, sf):
    got = report.distribution(b.docs(spark, sf), "lang")
    return got.select("label", "value", r6("share").alias("share"))


@query("scaled_measure", sql("""
    SELECT id, round((caption_consistency - (SELECT min(caption_consistency) FROM customers))
        / (SELECT max(caption_consistency) - min(caption_consistency) FROM customers), 6) AS scaled
    FROM customers""", "customers"))
def scaled_measure(spark, sf):
    s = scaled_to_observed(b.trail(spark, sf).samples, "caption_consistency")
    return s.select("id", r6("scaled").alias("scaled"))


@query("table_block", sql("""
    SELECT id, n, (SELECT count(DISTINCT sample_id) FROM trail) AS total_rows FROM (
        SELECT sample_id AS id, count(*) AS n FROM trail GROUP BY 1) ORDER BY n DESC, id LIMIT 200""",
    "trail"))
def table_block(spark, sf):
    rows = b.trail(spark, sf).captions.groupBy(F.col("sample_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    return ag.table_block(rows, [F.col("n").desc(), F.col("id")])


# -------------------------------------------------------------------------- records

@query("first_caption", sql("""
    SELECT sample_id, arg_min(text, idx) AS first_caption FROM captions GROUP BY 1""", "captions"))
def first_caption(spark, sf):
    return details.first_captions(b.turns(spark, sf))


@query("mean_agreement_join", sql("""
    SELECT s.id, round(a, 6) AS mean_agreement FROM samples s LEFT JOIN (
        SELECT sample_id, avg(agreement) AS a FROM captions GROUP BY 1) ON sample_id = s.id""",
    "samples", "captions"))
def mean_agreement_join(spark, sf):
    return details.with_mean_agreement(b.docs(spark, sf)).select(
        "id", r6("mean_agreement").alias("mean_agreement"))


RECORD = """
    , cap AS (SELECT sample_id, string_agg(text, ' | ' ORDER BY idx) AS captions,
                     round(avg(agreement), 6) AS m FROM captions GROUP BY 1),
    tag AS (SELECT sample_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM sample_tags GROUP BY 1),
    vlm AS (SELECT sample_id, string_agg(tag, ' ' ORDER BY tag) AS vlm_tags FROM vlm_tags GROUP BY 1),
    att AS (SELECT sample_id, string_agg(grp || ':' || label, ' ' ORDER BY grp) AS attributes
            FROM attributes GROUP BY 1)
"""


@query("export_record", sql(RECORD + """
    SELECT id, filename, split, coalesce(captions, '') AS captions,
           coalesce(tags, '') AS tags, legibility, rarity, difficulty, clutter, cluster, attributes
    FROM scored s LEFT JOIN cap ON cap.sample_id = id LEFT JOIN tag ON tag.sample_id = id
    LEFT JOIN att ON att.sample_id = id""",
    "samples", "captions", "sample_tags", "vlm_tags", "attributes", "axis_values", "scored"
    ).replace("\n\n    ,", ","))
def export_record(spark, sf):
    got = details.records(b.docs(spark, sf, axes=True))
    return _flat_record(got, "cluster")


def _flat_record(got, *more):
    facets = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws(
        ":", e["key"], e["value"])), " ")
    axes = [F.col("axes")[a].alias(a) for a in ("legibility", "rarity", "difficulty", "clutter")]
    return got.select("id", "filename", "split",
                      F.array_join("captions", " | ").alias("captions"),
                      F.array_join("tags", " ").alias("tags"), *axes, *more,
                      facets.alias("attributes"))


@query("sample_detail", sql(RECORD + """
    SELECT id, filename, split, coalesce(captions, '') AS captions,
           coalesce(tags, '') AS tags, legibility, rarity, difficulty, clutter,
           coalesce(vlm_tags, '') AS vlm_tags, attributes
    FROM scored s LEFT JOIN cap ON cap.sample_id = id LEFT JOIN tag ON tag.sample_id = id
    LEFT JOIN vlm ON vlm.sample_id = id LEFT JOIN att ON att.sample_id = id
    WHERE split = 'test'""",
    "samples", "captions", "sample_tags", "vlm_tags", "attributes", "axis_values", "scored"
    ).replace("\n\n    ,", ","))
def sample_detail(spark, sf):
    c = b.docs(spark, sf, axes=True)
    got = details.sample_details(c, Selection(split="test").apply(c))
    return _flat_record(got, F.array_join("vlm_tags", " ").alias("vlm_tags"))


@query("pair_compare", sql("""
    , ids AS (SELECT user_id AS a_id, CAST(json_extract(props, '$.k') AS BIGINT) AS b_id
              FROM events WHERE event_type = 'purchase'),
    p AS (SELECT DISTINCT a_id, b_id FROM ids WHERE a_id <> b_id),
    facets AS (SELECT a_id, b_id, count(*) AS facets_equal FROM p
        JOIN attributes x ON x.sample_id = a_id
        JOIN attributes y ON y.sample_id = b_id AND x.grp = y.grp AND x.label = y.label GROUP BY ALL),
    tags AS (SELECT a_id, b_id, count(*) AS shared FROM p
        JOIN vlm_tags x ON x.sample_id = a_id JOIN vlm_tags y ON y.sample_id = b_id AND x.tag = y.tag
        GROUP BY ALL)
    SELECT a_id, b_id, s.split AS a_split, t.split AS b_split, s.split = t.split AS same_split,
           CAST(coalesce(facets_equal, 0) AS INT) AS facets_equal,
           CAST(coalesce(shared, 0) AS INT) AS tags_shared
    FROM p JOIN samples s ON s.id = a_id JOIN samples t ON t.id = b_id
    LEFT JOIN facets USING (a_id, b_id) LEFT JOIN tags USING (a_id, b_id)""",
    "samples", "attributes", "vlm_tags").replace("\n\n    ,", ","))
def pair_compare(spark, sf):
    c = b.docs(spark, sf)
    c = c.with_tables(samples=c.samples.withColumn("cluster", F.lit(None).cast("int")))
    pairs = b.table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("a_id"),
        F.get_json_object("props", "$.k").cast("long").alias("b_id")).where("a_id <> b_id").distinct()
    return details.compare_pairs(c, pairs).select(
        "a_id", "b_id", "a_split", "b_split", "same_split", "facets_equal",
        F.size("tags_shared").alias("tags_shared"))


@query("label_path", """
    WITH RECURSIVE tree AS (
        SELECT r_regionkey AS id, r_name AS name, NULL AS parent_id FROM region
        UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM nation
        UNION ALL SELECT 1000 + s_suppkey, s_name, 100 + s_nationkey FROM supplier),
    up AS (
        SELECT id AS leaf, name, parent_id, 0 AS depth FROM tree
        UNION ALL SELECT leaf, t.name, t.parent_id, depth + 1 FROM up JOIN tree t ON t.id = up.parent_id)
    SELECT CAST(leaf AS BIGINT) AS id, string_agg(name, ' > ' ORDER BY depth DESC) AS path
    FROM up GROUP BY leaf""")
def label_path(spark, sf):
    tree = b.table(spark, sf, "region").selectExpr(
        "cast(r_regionkey AS bigint) AS id", "r_name AS name", "cast(NULL AS bigint) AS parent_id")
    tree = tree.union(b.table(spark, sf, "nation").selectExpr(
        "100 + n_nationkey", "n_name", "cast(n_regionkey AS bigint)"))
    tree = tree.union(b.table(spark, sf, "supplier").selectExpr(
        "1000 + s_suppkey", "s_name", "cast(100 + s_nationkey AS bigint)"))
    return details.label_paths(spark, tree).select(
        "id", F.array_join("path", " > ").alias("path"))


@query("reconcile", """
    SELECT count(v.vec_id) AS index_vectors, count(l.doc_id) AS table_rows,
           count(*) FILTER (l.doc_id IS NULL) AS orphan_vectors,
           count(*) FILTER (v.vec_id IS NULL) AS rows_without_vectors,
           count(*) FILTER (l.doc_id IS NULL) + count(*) FILTER (v.vec_id IS NULL) = 0 AS consistent,
           array_to_string(list(v.vec_id ORDER BY v.vec_id) FILTER (l.doc_id IS NULL)[1:5], ' ')
               AS sample_orphan_ids
    FROM embeddings v FULL JOIN labels l ON l.doc_id = v.vec_id""")
def reconcile(spark, sf):
    rows = b.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return details.reconcile(b.vectors(spark, sf), rows).withColumn(
        "sample_orphan_ids", F.array_join("sample_orphan_ids", " "))


ANNOTATED = """
    , marks AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS sample_id,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_partkey, l_suppkey, l_extendedprice) AS copy FROM lineitem),
    annotations AS (SELECT id, sample_id FROM marks WHERE copy = 1)
"""


def _annotations(spark, sf):
    """Line items as regions of parts, one per order line."""
    from pyspark.sql import Window

    line = b.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_extendedprice")
    return line.withColumn("copy", F.row_number().over(w)).where("copy = 1").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("sample_id"))


@query("annotation_pages", "WITH" + ANNOTATED.strip().removeprefix(",") + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS pos,
                 count(*) OVER (PARTITION BY sample_id) AS total FROM annotations)
    SELECT id, sample_id, CAST(pos AS INT) AS pos, total,
           CASE WHEN total > 20 THEN CAST(20 AS BIGINT) END AS next_offset FROM r WHERE pos <= 20""")
def annotation_pages(spark, sf):
    return details.annotation_page(_annotations(spark, sf)).select(
        "id", "sample_id", "pos", "total", "next_offset")


@query("annotation_view", "WITH" + ANNOTATED.strip().removeprefix(",") + """
    SELECT a.id, sample_id, p_name AS filename, s.s_suppkey IS NOT NULL AS has_mask,
           n_name AS label_name
    FROM annotations a JOIN part ON p_partkey = sample_id
    LEFT JOIN supplier s ON s.s_suppkey = a.id
    LEFT JOIN customer c ON c.c_custkey = a.id LEFT JOIN nation ON n_nationkey = c_nationkey""")
def annotation_view(spark, sf):
    c = b.parts(spark, sf)
    masks = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("annotation_id"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    links = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("annotation_id"), F.col("c_nationkey").cast("long").alias("label_id"))
    names = b.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    c = c.with_tables(
        samples=c.samples.withColumn("split", F.lit("train")), annotations=_annotations(spark, sf),
        annotation_masks=masks, annotation_labels=links, object_labels=names)
    return details.annotation_view(c).select("id", "sample_id", "filename", "has_mask", "label_name")


# ---------------------------------------------------------------------------- lists

@query("axis_sorted_page", sql("""
    SELECT id, difficulty, (SELECT count(*) FROM scored) AS total FROM scored
    ORDER BY difficulty DESC NULLS LAST, id LIMIT 60 OFFSET 60""", "samples", "axis_values", "scored"))
def axis_sorted_page(spark, sf):
    got = listing.page(b.docs(spark, sf, axes=True).samples, 2, 60, "difficulty_desc")
    return got.select("id", "difficulty", "total")


@query("axis_page_after", sql("""
    SELECT id, clutter FROM scored WHERE clutter > 4 OR (clutter = 4 AND id > 50) OR clutter IS NULL
    ORDER BY clutter NULLS LAST, id LIMIT 60""", "samples", "axis_values", "scored"))
def axis_page_after(spark, sf):
    got = listing.page_after(b.docs(spark, sf, axes=True).samples, "clutter", False, 4, 50)
    return got.select("id", "clutter")


@query("album_order_page", sql("""
    SELECT p_partkey AS id, position FROM items JOIN part ON p_partkey = sample_id
    WHERE album_id = 7 ORDER BY position, id""", "items"))
def album_order_page(spark, sf):
    c = b.parts(spark, sf)
    return listing.album_order(c.samples, c.album_items, 7).select("id", "position")


@query("rare_examples", sql("""
    SELECT grp, label, sample_id, CAST(pos AS INT) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY grp, label
            ORDER BY confidence DESC NULLS LAST, sample_id) AS pos FROM attributes)
    WHERE pos <= 12""", "attributes"))
def rare_examples(spark, sf):
    return listing.rare_examples(b.doc_attributes(spark, sf)).select("grp", "label", "sample_id", "pos")


@query("newest_activity", """
    SELECT event_id AS id, event_type AS kind, props AS payload FROM events
    ORDER BY event_id DESC LIMIT 50""")
def newest_activity(spark, sf):
    events = b.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
        F.col("props").alias("payload"))
    return listing.newest_activity(events)


# --------------------------------------------------------------------- percentiles

@query("percentile_bucket", """
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(round_even(
        percent_rank() OVER (ORDER BY l_extendedprice) * 10, 0) AS INT) AS bucket FROM lineitem""")
def percentile_bucket(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.lit("price").alias("metric"))
    return percentile_buckets(rows, value="l_extendedprice").drop("metric")


@query("percentile_bucket_extreme", """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_linenumber
        WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN '-inf'::DOUBLE WHEN 5 THEN NULL ELSE l_extendedprice END AS value
        FROM lineitem),
    r AS (SELECT *, percent_rank() OVER (PARTITION BY value IS NULL ORDER BY value) AS p FROM v)
    SELECT l_orderkey, l_linenumber, l_extendedprice,
           CASE WHEN value IS NOT NULL THEN CAST(round_even(p * 10, 0) AS INT) END AS bucket FROM r""")
def percentile_bucket_extreme(spark, sf):
    """Infinite, missing and NaN values among the measured ones."""
    line = F.col("l_linenumber")
    value = F.when(line == 3, F.lit(float("inf"))).when(line == 4, F.lit(float("-inf"))).when(
        line == 5, F.when(F.col("l_orderkey") % 2 == 0, F.lit(float("nan")))).otherwise(F.col("l_extendedprice"))
    rows = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", value.alias("value"), F.lit("it's").alias("metric"))
    return percentile_buckets(rows).drop("metric", "value")
