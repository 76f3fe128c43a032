"""Queries over vectors: neighbours, pairs, leakage, corrections, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions.vector import dot
from siftwork.operators import albums, composed, describe, details, fusion, hubness, layout, leakage, listing
from siftwork.operators import aggregates as ag
from siftwork.operators import evaluation as ev
from siftwork.operators import scenarios as sc
from siftwork.operators import signals, similarity
from siftwork.operators.selection import Selection
from siftwork.plans import bindings as b
from siftwork.plans.bindings import sql
from siftwork.plans.registry import ORACLES, query, r6
from siftwork.session import reliable_checkpoint
from siftwork.sources import builds

# Thresholds fit for nearly orthogonal vectors; the library default starts at 0.85.
LADDER = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45)
LINE = 0.30


def _join(body: str, *fragments: str) -> str:
    """``sql`` with further CTEs: the body starts with a comma."""
    return sql(body.lstrip("\n"), *fragments).replace("\n    ,", ",", 1).replace("\n,", ",", 1)


# ----------------------------------------------------------------------- neighbours

KNN = """
    , near AS (SELECT a_id AS query_id, b_id AS id, score, row_number() OVER (
        PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM sims WHERE a_id <> b_id)
"""


@query("knn", _join("""
    , r AS (SELECT a_id AS query_id, b_id AS id, score, row_number() OVER (
        PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM sims)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "vecs", "sims"))
def knn(spark, sf):
    v = b.vectors(spark, sf)
    got = similarity.knn(v, v.withColumnRenamed("id", "query_id"), 10)
    return got.withColumn("score", r6("score"))


@query("similar_to", _join(KNN + """
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM near
    JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = query_id
    WHERE rank <= 12""", "vecs", "sims"))
def similar_to(spark, sf):
    asked = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"))
    got = similarity.similar_to(b.vectors(spark, sf), asked, 12)
    return got.withColumn("score", r6("score"))


@query("filtered_knn", _join("""
    , r AS (SELECT a_id AS query_id, b_id AS id, score, row_number() OVER (
        PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM sims
        JOIN documents ON doc_id = b_id AND lang = 'en')
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    "vecs", "sims"))
def filtered_knn(spark, sf):
    c = b.docs(spark, sf)
    allowed = Selection(attrs=("lang:en",)).selected_ids(c)
    got = similarity.knn(c.vectors.join(allowed, "id", "left_semi"),
                         c.vectors.withColumnRenamed("id", "query_id"), 5)
    return got.withColumn("score", r6("score"))


@query("pairs_above", _join(f"""
    SELECT a_id, b_id, round(score, 6) AS score FROM sims WHERE a_id < b_id AND score > {LINE}""",
    "vecs", "sims"))
def pairs_above(spark, sf):
    return similarity.pairs_above(b.vectors(spark, sf), LINE).withColumn("score", r6("score"))


#: Both sides too large to hold, in cells of few rows: what a table of any size goes through.
LARGE = {"max_bytes": 1 << 12, "block_rows": 64}
COPIES = """
    , more AS (SELECT id, v FROM vecs UNION ALL SELECT id + 1000000, v FROM vecs WHERE id % 3 = 0
        UNION ALL SELECT 2000000 + i, v FROM vecs, range(150) t(i) WHERE id = 7),
    met AS (SELECT a.id AS a_id, b.id AS b_id, list_dot_product(a.v, b.v) AS score FROM more a, more b)"""


def _with_copies(spark, sf):
    """The vectors, a third of them twice, and one 150 times more."""
    v = b.vectors(spark, sf)
    twice = v.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000)
    often = v.where("id = 7").withColumn("id", F.explode(F.expr("sequence(2000000L, 2000149L)")))
    return v.unionByName(twice).unionByName(often)


@query("knn_large", _join(COPIES + """
    , r AS (SELECT a_id AS query_id, b_id AS id, score, row_number() OVER (
        PARTITION BY a_id ORDER BY round(score, 12) DESC, b_id) AS rank FROM met WHERE a_id <> b_id)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""", "vecs"))
def knn_large(spark, sf):
    v = _with_copies(spark, sf)
    got = similarity.knn(v, v.withColumnRenamed("id", "query_id"), 5, exclude_self=True, **LARGE)
    return got.withColumn("score", r6("score"))


@query("pairs_large", _join(COPIES + f"""
    SELECT a_id, b_id, round(score, 6) AS score FROM met WHERE a_id < b_id AND score > {LINE}""", "vecs"))
def pairs_large(spark, sf):
    return similarity.pairs_above(_with_copies(spark, sf), LINE, **LARGE).withColumn("score", r6("score"))


@query("strongest_pairs", _join(f"""
    SELECT a_id, b_id, round(score, 6) AS score FROM sims WHERE a_id < b_id AND score > {LINE}
    ORDER BY score DESC, a_id, b_id LIMIT 200""", "vecs", "sims"))
def strongest_pairs(spark, sf):
    pairs = similarity.pairs_above(b.vectors(spark, sf), LINE)
    return listing.strongest_pairs(pairs).withColumn("score", r6("score"))


@query("strongest_pairs_shown", _join(f"""
    , top AS (SELECT a_id, b_id, score FROM sims WHERE a_id < b_id AND score > {LINE}
              ORDER BY score DESC, a_id, b_id LIMIT 200)
    SELECT a_id, b_id, round(score, 6) AS score, a.filename AS a_filename, a.split AS a_split,
           b.filename AS b_filename, b.split AS b_split
    FROM top JOIN samples a ON a.id = a_id JOIN samples b ON b.id = b_id""", "samples", "vecs", "sims"))
def strongest_pairs_shown(spark, sf):
    """The list with the rows of both sides."""
    pairs = listing.strongest_pairs(similarity.pairs_above(b.vectors(spark, sf), LINE))
    rows = b.docs(spark, sf).samples.select("id", "filename", "split")
    for side in ("a", "b"):
        shown = rows.select(F.col("id"), *[F.col(c).alias(f"{side}_{c}") for c in ("filename", "split")])
        pairs = details.hydrate(pairs.withColumnRenamed(f"{side}_id", "id"), shown).withColumnRenamed("id", f"{side}_id")
    return pairs.withColumn("score", r6("score"))


@query("pair_ids", _join(f"""
    SELECT DISTINCT unnest([a_id, b_id]) AS id FROM sims WHERE a_id < b_id AND score > {LINE}""",
    "vecs", "sims"))
def pair_ids(spark, sf):
    pairs = similarity.pairs_above(b.vectors(spark, sf), LINE)
    return pairs.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()


ISOLATION = KNN + """
    , iso AS (SELECT query_id AS id, 1 - avg(score) AS isolation FROM near WHERE rank <= 10 GROUP BY 1)
"""


def _isolation(spark, sf):
    return similarity.isolation(b.vectors(spark, sf))


@query("isolation", _join(ISOLATION + "SELECT id, round(isolation, 6) AS isolation FROM iso",
                          "vecs", "sims"))
def isolation(spark, sf):
    return _isolation(spark, sf).withColumn("isolation", r6("isolation"))


@query("most_isolated", _join(ISOLATION + """
    SELECT id, round(isolation, 6) AS isolation FROM iso ORDER BY iso.isolation DESC, id LIMIT 100""",
    "vecs", "sims"))
def most_isolated(spark, sf):
    return listing.most_isolated(_isolation(spark, sf)).withColumn("isolation", r6("isolation"))


@query("nn_stats", _join(ISOLATION + """
    , o AS (SELECT 1 - isolation AS s, row_number() OVER (ORDER BY 1 - isolation) - 1 AS i,
                   count(*) OVER () AS n FROM iso)
    SELECT any_value(n) AS n, round(max(s) FILTER (i = floor(0.05 * (n - 1) + 0.5)), 6) AS p5,
           round(max(s) FILTER (i = floor(0.5 * (n - 1) + 0.5)), 6) AS median,
           round(min(s), 6) AS min FROM o""", "vecs", "sims"))
def nn_stats(spark, sf):
    got = ag.neighbour_stats(_isolation(spark, sf))
    return got.select("n", *[r6(c).alias(c) for c in ("p5", "median", "min")])


@query("sim_floor", _join(KNN + """
    SELECT round(quantile_cont(score, 0.1), 6) AS floor FROM near WHERE rank = 1""", "vecs", "sims"))
def sim_floor(spark, sf):
    return signals.similarity_floor(b.vectors(spark, sf)).select(r6("floor").alias("floor"))


@query("score_distribution", _join(KNN + f"""
    , s AS (SELECT score FROM near WHERE rank <= 10),
    e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 24 AS w FROM s)
    SELECT CAST(i AS INT) AS bin, round(lo + i * w, 6) AS lo, round(lo + (i + 1) * w, 6) AS hi,
           count(score) AS n, (SELECT count(*) FROM s WHERE score < {LINE}) AS below
    FROM e CROSS JOIN range(24) r(i)
    LEFT JOIN s ON least(CAST(trunc((score - lo) / w) AS INT), 23) = i GROUP BY i, lo, w""",
    "vecs", "sims"))
def score_distribution(spark, sf):
    v = b.vectors(spark, sf)
    hits = similarity.knn(v, v.withColumnRenamed("id", "query_id"), 10, exclude_self=True)
    got = ag.score_distribution(hits, LINE)
    return got.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n", "below")


@query("result_neighbours", _join(KNN + """
    SELECT query_id, id, CAST(rank AS INT) AS rank,
           lag(id) OVER q AS prev_id, lead(id) OVER q AS next_id, CAST(rank AS INT) AS position,
           count(*) OVER (PARTITION BY query_id) AS total
    FROM (SELECT * FROM near WHERE rank <= 10) WINDOW q AS (PARTITION BY query_id ORDER BY rank)""",
    "vecs", "sims"))
def result_neighbours(spark, sf):
    v = b.vectors(spark, sf)
    near = similarity.knn(v, v.withColumnRenamed("id", "query_id"), 10, exclude_self=True)
    return fusion.neighbours_in_order(near)


@query("pair_rank", _join(KNN + """
    SELECT query_id AS a_id, id AS b_id, CAST(rank AS INT) AS rank FROM near
    JOIN (SELECT DISTINCT user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
      ON a = query_id AND k = id WHERE rank <= 60""", "vecs", "sims"))
def pair_rank(spark, sf):
    pairs = b.table(spark, sf, "events").select(
        F.col("user_id").alias("a_id"),
        F.get_json_object("props", "$.k").cast("long").alias("b_id")).distinct()
    near = similarity.similar_to(b.vectors(spark, sf), pairs.select(F.col("a_id").alias("id")), 60)
    return near.select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "rank").join(
        pairs, ["a_id", "b_id"])


@query("index_contract", """
    SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids,
           count(*) FILTER (vec_id IS NULL OR embedding IS NULL) AS nulls,
           CAST(min(len(embedding)) AS INT) AS min_dim, CAST(max(len(embedding)) AS INT) AS max_dim,
           max(abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1))
               <= 0.001 AS unit
    FROM embeddings""")
def index_contract(spark, sf):
    got = builds.contract(b.vectors(spark, sf))
    return got.select("rows", "ids", "nulls", "min_dim", "max_dim",
                      (F.col("norm_error") <= builds.NORM_SLACK).alias("unit"))


# -------------------------------------------------------------------------- leakage

LEAK = f"""
    , pairs AS (SELECT a_id, b_id, score, x.split AS a_split, y.split AS b_split FROM sims
        JOIN vecs x ON x.id = a_id JOIN vecs y ON y.id = b_id WHERE a_id < b_id AND score > {LADDER[0]}),
    sides AS (SELECT a_id AS id, a_split AS own, b_split AS other, score FROM pairs
        UNION ALL SELECT b_id, b_split, a_split, score FROM pairs)
"""


def _split_pairs(spark, sf):
    pairs = similarity.pairs_above(b.vectors(spark, sf), LADDER[0])
    return leakage.with_splits(pairs, b.vector_samples(spark, sf))


@query("leak_curve", _join(LEAK + """
    SELECT t AS threshold, (SELECT count(*) FROM pairs WHERE score > t) AS pairs,
           (SELECT count(*) FROM pairs WHERE score > t AND a_split <> b_split) AS cross_split,
           (SELECT count(DISTINCT id) FROM sides WHERE score > t AND other = 'train'
            AND own IN ('test', 'validation')) AS contaminated
    FROM (SELECT unnest([0.20, 0.25, 0.30, 0.35, 0.40, 0.45]::DOUBLE[]) AS t)""", "vecs", "sims"))
def leak_curve(spark, sf):
    return leakage.curve(_split_pairs(spark, sf), LADDER)


@query("leak_ids", _join(LEAK + f"""
    SELECT DISTINCT id FROM sides WHERE score > {LINE} AND other = 'train'
    AND own IN ('test', 'validation')""", "vecs", "sims"))
def leak_ids(spark, sf):
    return leakage.contaminated(_split_pairs(spark, sf), LINE)


@query("leak_summary", _join(LEAK + f"""
    , c AS (SELECT count(DISTINCT id) AS k FROM sides WHERE score > {LINE} AND other = 'train'
            AND own IN ('test', 'validation')),
    h AS (SELECT count(*) AS n FROM vecs WHERE split <> 'train')
    SELECT k AS contaminated, n AS held_out_total, round(k / n, 6) AS fraction FROM c, h""",
    "vecs", "sims"))
def leak_summary(spark, sf):
    got = leakage.contamination_summary(
        _split_pairs(spark, sf), b.vector_samples(spark, sf), LINE)
    return got.withColumn("fraction", r6("fraction"))


@query("leak_by_split", _join(LEAK + f"""
    SELECT least(a_split, b_split) || '~' || greatest(a_split, b_split) AS splits, count(*) AS pairs
    FROM pairs WHERE score > {LINE} AND a_split <> b_split GROUP BY 1""", "vecs", "sims"))
def leak_by_split(spark, sf):
    return leakage.by_split_pair(_split_pairs(spark, sf), LINE)


@query("leak_examples", _join(LEAK + f"""
    SELECT a_id, b_id, round(score, 6) AS score, a_split, b_split, a_split <> b_split AS cross_split
    FROM pairs WHERE score > {LINE}
    ORDER BY a_split <> b_split DESC, pairs.score DESC, a_id, b_id LIMIT 40""", "vecs", "sims"))
def leak_examples(spark, sf):
    return leakage.examples(_split_pairs(spark, sf), LINE).withColumn("score", r6("score"))


@query("pixel_check", _join(LEAK + f"""
    , hashes AS (SELECT doc_id AS id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS h FROM documents),
    m AS (SELECT score, CAST(bit_count(CAST(xor(x.h, y.h) & 9223372036854775807 AS BIGINT))
                 + CASE WHEN xor(x.h, y.h) > 9223372036854775807 THEN 1 ELSE 0 END AS INT) AS distance
          FROM pairs JOIN hashes x ON x.id = a_id JOIN hashes y ON y.id = b_id
          WHERE score > {LINE} AND a_split <> b_split)
    SELECT count(*) AS pairs_measured, count(*) FILTER (distance <= 10) AS duplicate_frames,
           CAST(median(distance) AS DOUBLE) AS median_distance,
           round(corr(score, distance), 6) AS correlation,
           round(count(*) FILTER (distance <= 10) / count(*), 6) AS duplicate_frame_fraction
    FROM m""", "vecs", "sims"))
def pixel_check(spark, sf):
    """Documents stand in for frames: 64 bits of their digest as the hash."""
    hashes = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("cast(conv(substring(md5(text), 1, 16), 16, -10) AS bigint)").alias("dhash"))
    measured = leakage.frame_distances(_split_pairs(spark, sf), hashes, LINE)
    got = leakage.pixel_report(measured, hashes)
    return got.select("pairs_measured", "duplicate_frames", "median_distance",
                      r6("correlation").alias("correlation"),
                      r6("duplicate_frame_fraction").alias("duplicate_frame_fraction"))


@query("null_distance", """
    WITH h AS (SELECT doc_id AS id, md5(text) AS m FROM documents),
    d AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS pos FROM h
          QUALIFY pos < 400),
    bits AS (SELECT pos // 2 AS p, pos % 2 AS side, CAST('0x' || m[1:16] AS UBIGINT) AS x FROM d),
    pairs AS (SELECT bit_count(CAST(a.x AS HUGEINT) # CAST(b.x AS HUGEINT)) AS gap
              FROM bits a JOIN bits b ON a.p = b.p AND a.side = 0 AND b.side = 1)
    SELECT CAST(median(gap) AS DOUBLE) AS null_median FROM pairs""".replace(
        "bit_count(CAST(a.x AS HUGEINT) # CAST(b.x AS HUGEINT))", "bit_count(xor(CAST(a.x AS HUGEINT), CAST(b.x AS HUGEINT)))"))
def null_distance(spark, sf):
    hashes = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("cast(conv(substring(md5(text), 1, 16), 16, -10) AS bigint)").alias("dhash"))
    return leakage.null_distance(hashes)


# ------------------------------------------------------------------ signals, hubness

@query("caption_agreement", _join("""
    SELECT id, label AS sample_id, round(list_dot_product(x.v, c.v), 6) AS agreement
    FROM vecs x JOIN centres c USING (label)""", "vecs", "centres"))
def caption_agreement(spark, sf):
    """Vectors as captions of their label, the label's centre as its image."""
    caps = b.vector_samples(spark, sf).select("id", F.col("label").cast("long").alias("sample_id"))
    centres = b.label_centres(spark, sf).select(F.col("label").cast("long").alias("id"), "embedding")
    got = signals.caption_agreement(caps, b.vectors(spark, sf), centres)
    return got.select("id", F.col("sample_id").cast("int").alias("sample_id"),
                      r6("agreement").alias("agreement"))


@query("caption_consistency", _join("""
    SELECT x.label AS sample_id, count(DISTINCT x.id) AS n, round(avg(score), 6) AS consistency
    FROM sims JOIN vecs x ON x.id = a_id JOIN vecs y ON y.id = b_id
    WHERE a_id <> b_id AND x.label = y.label GROUP BY x.label""", "vecs", "sims"))
def caption_consistency(spark, sf):
    caps = b.vector_samples(spark, sf).select("id", F.col("label").alias("sample_id"))
    got = signals.caption_consistency(caps, b.vectors(spark, sf))
    return got.withColumn("consistency", r6("consistency"))


HUB = """
    , hub AS (SELECT b_id AS id, 0.02 * (max(score / 0.02) + ln(sum(exp(score / 0.02 - m)))) AS h
        FROM (SELECT *, max(score / 0.02) OVER (PARTITION BY b_id) AS m FROM sims WHERE a_id <> b_id)
        GROUP BY b_id)
"""


def _bank(spark, sf):
    """Every vector is a bank entry owned by its own sample."""
    return b.vectors(spark, sf).select("id", F.col("id").alias("sample_id"), "embedding")


@query("hubness", _join(HUB + "SELECT id, round(h, 6) AS h FROM hub", "vecs", "sims"))
def hubness_penalty(spark, sf):
    got = hubness.hubness_penalty(b.vectors(spark, sf), _bank(spark, sf))
    return got.withColumn("h", r6("h"))


@query("adjusted_rank", _join(HUB + """
    , r AS (SELECT a_id AS query_id, b_id AS id, score - 0.3 * h AS s, row_number() OVER (
        PARTITION BY a_id ORDER BY score - 0.3 * h DESC, b_id) AS rank FROM sims JOIN hub ON hub.id = b_id)
    SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "vecs", "sims"))
def adjusted_rank(spark, sf):
    v = b.vectors(spark, sf)
    penalty = hubness.scaled_penalty(hubness.hubness_penalty(v, _bank(spark, sf)))
    got = similarity.knn(v.join(penalty, "id"), v.withColumnRenamed("id", "query_id"), 10,
                         penalty="penalty")
    return got.withColumn("score", r6("score"))


@query("adjusted_rank_large", ORACLES["adjusted_rank"])
def adjusted_rank_large(spark, sf):
    """As adjusted_rank, with neither side held."""
    v = b.vectors(spark, sf)
    penalty = reliable_checkpoint(hubness.scaled_penalty(hubness.hubness_penalty(v, _bank(spark, sf))))
    got = similarity.knn(v.join(penalty, "id"), v.withColumnRenamed("id", "query_id"), 10, penalty="penalty", **LARGE)
    return got.withColumn("score", r6("score"))


@query("bank_captions", _join("""
    , usable AS (SELECT c.id, c.sample_id FROM line_captions c JOIN embeddings e ON e.vec_id = c.sample_id),
    n AS (SELECT count(*) AS n, CASE WHEN count(*) >= 1000 THEN least(3000, count(*) // 4) ELSE 0 END AS take FROM usable)
    SELECT id, sample_id FROM (SELECT u.*, row_number() OVER (ORDER BY md5('20260726:' || id), id) AS r FROM usable u)
    WHERE r <= (SELECT take FROM n)""", "line_captions"))
def bank_captions(spark, sf):
    return hubness.bank_captions(b.line_captions(spark, sf), b.vectors(spark, sf))


ZERO_SHOT = """
    , p AS (SELECT x.id, c.label, 10 * list_dot_product(x.v, c.v) AS logit FROM vecs x, centres c),
    e AS (SELECT id, label, exp(logit - max(logit) OVER (PARTITION BY id)) AS w FROM p),
    q AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS prob FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS pos,
                 prob - lead(prob) OVER (PARTITION BY id ORDER BY prob DESC, label) AS margin FROM q)
    SELECT id, 'topic' AS grp, 'label ' || label AS label, round(prob, 6) AS confidence,
           round(margin, 6) AS margin FROM r WHERE pos = 1 AND margin >= 0.1
"""


@query("zero_shot", _join(ZERO_SHOT, "vecs", "centres"))
def zero_shot(spark, sf):
    """Label centres as prompts, at a logit scale that suits spread vectors."""
    prompts = b.label_centres(spark, sf).select(
        F.lit("topic").alias("grp"), F.concat(F.lit("label "), F.col("label")).alias("label"),
        "embedding")
    got = signals.zero_shot(b.vectors(spark, sf), prompts, scale=10.0)
    return got.withColumn("confidence", r6("confidence")).withColumn("margin", r6("margin"))


# ---------------------------------------------------------------------- composition

def _composed_queries(spark, sf):
    """Customers as askers: what they bought they want, what failed they avoid."""
    events = b.table(spark, sf, "events").select(
        "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    # A user's events name at most a hundred items.
    return events.groupBy(F.col("user_id").alias("query_id")).agg(
        F.lit(None).cast("array<float>").alias("text_vec"),
        F.array_sort(F.collect_set(F.when(F.col("event_type") == "purchase", F.col("k")))).alias(
            "positive_ids"),
        F.array_sort(F.collect_set(F.when(F.col("event_type") == "error", F.col("k")))).alias(
            "negative_ids"))


ASKED = """
    , ev AS (SELECT DISTINCT user_id AS q, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k
             FROM events WHERE event_type IN ('purchase', 'error')),
    pos AS (SELECT q, i, avg(e) AS e FROM ev JOIN (
        SELECT id, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM vecs) ON id = k
        WHERE t = 'purchase' GROUP BY ALL),
    posn AS (SELECT q, sqrt(sum(e * e)) AS n FROM pos GROUP BY q),
    steer AS (SELECT q, list(e / n ORDER BY i) AS v FROM pos JOIN posn USING (q) GROUP BY q),
    away AS (SELECT q, b_id AS id, max(score) AS s, bool_or(a_id = b_id) AS own
             FROM ev JOIN sims ON a_id = k WHERE t = 'error' GROUP BY ALL)
"""


@query("composed", _join(ASKED + """
    , sc AS (SELECT s.q, x.id, list_dot_product(s.v, x.v)
                    - 0.5 * greatest(coalesce(a.s, 0), 0) AS score
             FROM steer s CROSS JOIN vecs x LEFT JOIN away a ON a.q = s.q AND a.id = x.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc)
    SELECT q AS query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank,
           'composed' AS score_basis FROM r WHERE rank <= 24""", "vecs", "sims"))
def composed_search(spark, sf):
    asked = _composed_queries(spark, sf).where(F.size("positive_ids") > 0)
    got = composed.composed_ranking(asked, b.vectors(spark, sf), depth=24)
    return got.withColumn("score", r6("score"))


@query("negative_only", _join(ASKED + """
    , r AS (SELECT q, id, -s AS score, row_number() OVER (PARTITION BY q ORDER BY -s DESC, id) AS rank
            FROM away WHERE NOT own)
    SELECT q AS query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank,
           'composed' AS score_basis FROM r WHERE rank <= 24""", "vecs", "sims"))
def negative_only(spark, sf):
    asked = _composed_queries(spark, sf).where(F.size("negative_ids") > 0).withColumn(
        "positive_ids", F.array().cast("array<long>"))
    got = composed.composed_ranking(asked, b.vectors(spark, sf), depth=24)
    return got.withColumn("score", r6("score"))


@query("by_vector", _join("""
    , q AS (SELECT id, label % 2 = 1 AS neg, v, sqrt(list_dot_product(v, v)) AS norm FROM vecs),
    t AS (SELECT q.id AS query_id, x.id, CASE WHEN neg THEN -1 ELSE 1 END * list_dot_product(q.v, x.v)
              / norm AS score FROM q, vecs x WHERE x.id <> q.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank, 'composed' AS score_basis
    FROM r WHERE rank <= 10""", "vecs"))
def by_vector(spark, sf):
    """Every vector as a region of its own sample; odd labels steer away."""
    asked = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"),
        F.lit(None).cast("array<float>").alias("text_vec"), F.col("vec_id").alias("source_id"),
        F.when(F.col("label") % 2 == 1, "negative").otherwise("positive").alias("role"),
        F.lit("region").alias("kind"))
    return composed.by_vector(asked, b.vectors(spark, sf), 10).withColumn("score", r6("score"))


@query("scenario_traits", _join("""
    , members AS (SELECT doc_id % 10 AS query_id, CAST(doc_id // 10 % 3 AS INT) AS grp, doc_id AS id FROM documents),
    sizes AS (SELECT *, sum(size) OVER (PARTITION BY query_id) AS pool
              FROM (SELECT query_id, grp, count(*) AS size FROM members GROUP BY query_id, grp)),
    traits AS (SELECT sample_id, grp || ':' || label AS name, 0 AS source FROM attributes
               UNION SELECT sample_id, 'vlm:' || tag, 1 FROM vlm_tags),
    inside AS (SELECT query_id, m.grp, name, source, count(*) AS n_in
               FROM members m JOIN traits t ON t.sample_id = m.id GROUP BY ALL),
    rates AS (SELECT *, n_in / size AS p_in, sum(n_in) OVER (PARTITION BY query_id, name) / pool AS p_bg
              FROM inside JOIN sizes USING (query_id, grp))
    SELECT query_id, grp, name, source, n_in, round(p_in, 6) AS p_in, round(p_bg, 6) AS p_bg,
           round(p_in / p_bg, 6) AS lift, round(p_in / p_bg / pow(1.05, source), 6) AS strength
    FROM rates WHERE p_in >= 0.02 AND p_in / p_bg >= 1.02""", "attributes", "vlm_tags"))
def scenario_traits(spark, sf):
    """Traits of given groups, by thresholds low enough for many to pass."""
    c = b.docs(spark, sf)
    members = b.table(spark, sf, "documents").select(
        (F.col("doc_id") % 10).alias("query_id"), F.floor(F.col("doc_id") / 10).alias("tens"),
        F.col("doc_id").alias("id")).select("query_id", (F.col("tens") % 3).cast("int").alias("grp"), "id")
    none = b.table(spark, sf, "documents").where("false").select(F.col("doc_id").alias("sample_id"), "text")
    got = sc.distinctive_traits(members, c.attributes, c.vlm_tags, none,
                                sc.Grouping(share=0.02, lift=1.02, margin=1.05))
    return got.select("query_id", "grp", "name", "source", "n_in", *[
        r6(x).alias(x) for x in ("p_in", "p_bg", "lift", "strength")])


@query("scenarios")
def scenarios(spark, sf):
    c = b.docs(spark, sf)
    asked = _composed_queries(spark, sf).where(F.size("positive_ids") > 0)
    ranking = composed.composed_ranking(asked, c.vectors, depth=sc.DEPTH)
    got = sc.scenarios(ranking, c.vectors, c.attributes, c.vlm_tags, c.captions)
    return got.withColumn("members", F.array_join("members", " "))


@query("pca_map")
def pca_map(spark, sf):
    return layout.project_2d(b.vectors(spark, sf))


@query("kmeans")
def kmeans(spark, sf):
    return layout.cluster(b.vectors(spark, sf))


# --------------------------------------------------------------------------- albums

@query("album_common", _join("""
    , m AS (SELECT album_id, count(*) AS n FROM items GROUP BY 1),
    c AS (SELECT album_id, grp, label, count(*) AS c FROM items JOIN part_facets USING (sample_id)
          GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY album_id, grp ORDER BY c DESC, label) AS pos FROM c)
    SELECT album_id, 'attribute' AS kind, grp, label, round(c / n, 6) AS share
    FROM t JOIN m USING (album_id) WHERE pos = 1 AND c / n >= 0.6
    UNION ALL
    SELECT album_id, 'vlm_tag', NULL, p_type, round(count(*) / any_value(n), 6) AS share
    FROM items JOIN part ON p_partkey = sample_id JOIN m USING (album_id)
    GROUP BY album_id, p_type HAVING count(*) / any_value(n) >= 0.5""", "items", "part_facets"))
def album_common(spark, sf):
    c = b.parts(spark, sf)
    got = albums.common_signals(c.album_items, c.attributes, vlm_tags=c.vlm_tags)
    return got.withColumn("share", r6("share"))


@query("album_different", _join("""
    , m AS (SELECT album_id, count(*) AS n FROM items GROUP BY 1),
    c AS (SELECT album_id, grp, label, count(*) AS c FROM items JOIN part_facets USING (sample_id)
          GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY album_id, grp ORDER BY c DESC, label) AS pos FROM c),
    p AS (SELECT x.album_id, x.grp, x.label AS first_label, x.c / n AS first_share,
                 y.label AS second_label, y.c / n AS second_share
          FROM t x JOIN t y ON x.album_id = y.album_id AND x.grp = y.grp AND x.pos = 1 AND y.pos = 2
          JOIN m ON m.album_id = x.album_id)
    SELECT album_id, grp, first_label, round(first_share, 6) AS first_share, second_label,
           round(second_share, 6) AS second_share
    FROM p WHERE first_share < 0.6 AND first_share + second_share >= 0.5""", "items", "part_facets"))
def album_different(spark, sf):
    c = b.parts(spark, sf)
    got = albums.different_signals(c.album_items, c.attributes)
    return got.withColumn("first_share", r6("first_share")).withColumn(
        "second_share", r6("second_share"))


@query("coherence", _join("""
    , p AS (SELECT x.album_id, count(DISTINCT x.sample_id) AS n, sum(score) AS total
            FROM items x JOIN items y ON x.album_id = y.album_id
            JOIN sims ON a_id = x.sample_id AND b_id = y.sample_id GROUP BY x.album_id)
    SELECT album_id, n, round((total - n) / (n * (n - 1)), 6) AS coherence FROM p WHERE n > 1""",
    "items", "vecs", "sims"))
def coherence(spark, sf):
    c = b.parts(spark, sf)
    return albums.coherence(c.album_items, c.vectors).withColumn("coherence", r6("coherence"))


@query("outliers", _join("""
    , mem AS (SELECT label AS album_id, id, v FROM vecs),
    s AS (SELECT album_id, id, list_dot_product(x.v, c.v) AS score FROM mem x
          JOIN centres c ON c.label = album_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY score, id) AS pos FROM s)
    SELECT album_id, id, round(score, 6) AS score, CAST(pos AS INT) AS pos FROM r WHERE pos <= 3""",
    "vecs", "centres"))
def outliers(spark, sf):
    """Each label as an album of its vectors."""
    items = b.table(spark, sf, "embeddings").select(
        F.col("label").alias("album_id"), F.col("vec_id").alias("sample_id"))
    return albums.outliers(items, b.vectors(spark, sf)).select(
        "album_id", "id", r6("score").alias("score"), "pos")


@query("album_members", _join("""
    , t AS (SELECT 'all' || l_returnflag AS name, l_partkey AS sample_id, min(l_orderkey) AS position
            FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position, sample_id) AS pos,
                 count(*) OVER (PARTITION BY name) AS members FROM t)
    SELECT name AS album_id, sample_id, pos - 1 AS pos, members FROM r""", "items"))
def album_members(spark, sf):
    items = b.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("all"), "l_returnflag").alias("album_id"),
        F.col("l_partkey").alias("sample_id")).agg(F.min("l_orderkey").alias("position"))
    return albums.ordered_members(items).select("album_id", "sample_id", "pos", "members")


# ------------------------------------------------------------------------- describe

DESCRIBED = """
    , chosen AS (SELECT id FROM samples WHERE id IN (
        SELECT sample_id FROM attributes WHERE grp = 'lang' AND label = 'en')),
    sz AS (SELECT (SELECT count(*) FROM chosen) AS n, (SELECT count(*) FROM samples) AS big_n)
"""
FACETS = DESCRIBED + """
    , f AS (SELECT grp, label, count(*) FILTER (sample_id IN (SELECT id FROM chosen)) AS k,
                   count(*) AS big_k FROM attributes WHERE grp <> 'lang' GROUP BY ALL),
    z AS (SELECT f.*, n, big_n, k / n AS set_share, big_k / big_n AS corpus_share,
                 (k / n) / (big_k / big_n) AS lift,
                 CASE WHEN big_k < big_n THEN (k - n * (big_k / big_n)) / sqrt(
                     n * (big_k / big_n) * (1 - big_k / big_n) * ((big_n - n) / (big_n - 1)))
                 ELSE 0 END AS z FROM f, sz)
"""


@query("describe_facets", _join(FACETS + """
    SELECT grp, label, k, big_k, n, big_n, round(set_share, 6) AS set_share,
           round(corpus_share, 6) AS corpus_share, round(lift, 6) AS lift, round(z, 6) AS z FROM z""",
    "samples", "attributes"))
def describe_facets(spark, sf):
    got = describe.facet_lift(b.docs(spark, sf), Selection(attrs=("lang:en",)))
    return got.select("grp", "label", "k", "big_k", "n", "big_n", *[
        r6(c).alias(c) for c in ("set_share", "corpus_share", "lift", "z")])


@query("describe_notable", _join(FACETS + """
    , s AS (SELECT *, CASE WHEN z >= 2 AND k >= 5 THEN 'over'
                           WHEN z <= -2 AND n * corpus_share >= 5 THEN 'under' END AS side FROM z),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY
        CASE WHEN side = 'over' THEN -lift ELSE lift END, grp, label) AS pos FROM s
        WHERE side IS NOT NULL)
    SELECT side, grp, label, CAST(pos AS INT) AS pos FROM r WHERE pos <= 12""",
    "samples", "attributes"))
def describe_notable(spark, sf):
    lifts = describe.facet_lift(b.docs(spark, sf), Selection(attrs=("lang:en",)))
    return describe.notable_facets(lifts).select("side", "grp", "label", "pos")


@query("describe_axes", _join(DESCRIBED + """
    , a AS (SELECT metric, avg(bucket) AS m, avg(bucket) FILTER (id IN (SELECT id FROM chosen)) AS s
            FROM buckets GROUP BY metric)
    SELECT metric AS axis, round(s, 6) AS set_mean, round(m, 6) AS corpus_mean,
           round(s - m, 6) AS delta FROM a WHERE s IS NOT NULL""",
    "samples", "attributes", "axis_values", "scored"))
def describe_axes(spark, sf):
    got = describe.axis_deltas(b.docs(spark, sf, axes=True), Selection(attrs=("lang:en",)))
    return got.select("axis", *[r6(c).alias(c) for c in ("set_mean", "corpus_mean", "delta")])


@query("describe_counts", _join("""
    , c AS (SELECT * FROM customers WHERE id IN (SELECT sample_id FROM sample_tags WHERE tag = 'click'))
    SELECT 'split' AS kind, split AS key, count(*) AS n FROM c GROUP BY split
    UNION ALL (SELECT 'cluster', CAST(cluster AS VARCHAR) AS key, count(*) AS n FROM c GROUP BY cluster
               ORDER BY n DESC, key LIMIT 6)""", "customers", "sample_tags"))
def describe_counts(spark, sf):
    return describe.set_counts(b.trail(spark, sf), Selection(tag="click"))


@query("describe_agreement", _join("""
    SELECT round(avg(agreement) FILTER (split = 'train'), 6) AS mean_agreement,
           round(avg(agreement), 6) AS corpus_mean_agreement
    FROM trail JOIN customers c ON c.id = sample_id""", "trail", "customers"))
def describe_agreement(spark, sf):
    got = describe.set_agreement(b.trail(spark, sf), Selection(split="train"))
    return got.select(r6("mean_agreement").alias("mean_agreement"),
                      r6("corpus_mean_agreement").alias("corpus_mean_agreement"))


@query("describe_guard", sql("""
    SELECT 0 AS set_size, count(*) AS corpus_size, TRUE AS filtered,
           'Nothing matches this selection.' AS message FROM samples""", "samples"))
def describe_guard(spark, sf):
    return describe.describe_guard(b.docs(spark, sf), Selection(tag="no such tag"))


# ----------------------------------------------------------------------- evaluation

EVAL = """
    , own AS (SELECT x.id, x.label, x.v, arg_min(y.id, y.id) AS target FROM vecs x
              JOIN vecs y ON y.label = x.label AND y.id <> x.id GROUP BY ALL),
    ranks AS (SELECT o.id AS query_id, count(*) FILTER (round(s.score, 12) > round(t.score, 12)) AS rank0
              FROM own o JOIN sims t ON t.a_id = o.id AND t.b_id = o.target
              JOIN sims s ON s.a_id = o.id GROUP BY o.id)
"""


def _eval_queries(spark, sf):
    """Each vector asks for the first other vector of its label."""
    v = b.table(spark, sf, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("one"))
    second = v.join(first, "label").where("vec_id > one").groupBy("label").agg(F.min("vec_id").alias("other"))
    firsts = first.join(second, "label", "left").select("label", F.array("one", "other").alias("two"))
    return v.join(firsts, "label").select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.when(F.col("two")[0] == F.col("vec_id"), F.get("two", F.lit(1))).otherwise(
            F.col("two")[0]).alias("target_id")).where(F.col("target_id").isNotNull())


@query("eval_ranks", _join(EVAL + "SELECT * FROM ranks", "vecs", "sims"))
def eval_ranks(spark, sf):
    return ev.semantic_ranks(_eval_queries(spark, sf), b.vectors(spark, sf))


@query("eval_ranks_large", _join(EVAL + "SELECT * FROM ranks", "vecs", "sims"))
def eval_ranks_large(spark, sf):
    """As eval_ranks, with neither side held."""
    return ev.semantic_ranks(_eval_queries(spark, sf), b.vectors(spark, sf), **LARGE)


@query("eval_metrics", _join(EVAL + """
    SELECT 'semantic' AS mode, count(*) AS queries, round(avg((rank0 < 1)::INT), 6) AS recall_at_1,
           round(avg((rank0 < 5)::INT), 6) AS recall_at_5, round(avg((rank0 < 10)::INT), 6) AS recall_at_10,
           round(avg(CASE WHEN rank0 < 10 THEN 1 / (rank0 + 1) ELSE 0 END), 6) AS mrr,
           CAST(median(rank0 + 1) AS DOUBLE) AS median_rank FROM ranks""", "vecs", "sims"))
def eval_metrics(spark, sf):
    ranks = ev.semantic_ranks(_eval_queries(spark, sf), b.vectors(spark, sf))
    got = ev.retrieval_metrics(ranks, True, "semantic")
    return got.select("mode", "queries", *[r6(c).alias(c) for c in (
        "recall_at_1", "recall_at_5", "recall_at_10", "mrr")], "median_rank")


@query("overlap_at_k", _join(KNN + HUB + """
    , adj AS (SELECT a_id AS query_id, b_id AS id, row_number() OVER (
        PARTITION BY a_id ORDER BY score - 0.3 * h DESC, b_id) AS rank
        FROM sims JOIN hub ON hub.id = b_id WHERE a_id <> b_id),
    o AS (SELECT n.query_id, count(a.id) / 10 AS overlap FROM near n
          LEFT JOIN (SELECT * FROM adj WHERE rank <= 10) a ON a.query_id = n.query_id AND a.id = n.id
          WHERE n.rank <= 10 GROUP BY 1)
    SELECT count(*) AS queries, round(avg(overlap), 6) AS mean_overlap, min(overlap) AS min_overlap,
           round(avg((overlap = 1)::INT), 6) AS identical_share FROM o""", "vecs", "sims"))
def overlap_at_k(spark, sf):
    v = b.vectors(spark, sf)
    asked = v.withColumnRenamed("id", "query_id")
    penalty = hubness.scaled_penalty(hubness.hubness_penalty(v, _bank(spark, sf)))
    plain = similarity.knn(v, asked, 10, exclude_self=True)
    adjusted = similarity.knn(v.join(penalty, "id"), asked, 10, exclude_self=True, penalty="penalty")
    got = ev.overlap_summary(ev.overlap_at_k(plain, adjusted))
    return got.select("queries", r6("mean_overlap").alias("mean_overlap"), "min_overlap",
                      r6("identical_share").alias("identical_share"))


@query("sample_queries", _join("""
    SELECT id, sample_id FROM (
        SELECT t.id, t.sample_id, row_number() OVER (ORDER BY md5('42:' || t.id), t.id) AS r
        FROM captions t JOIN embeddings e ON e.vec_id = t.sample_id) WHERE r <= 1000""", "captions"))
def sample_queries(spark, sf):
    caps = b.turns(spark, sf)
    return ev.sample_queries(caps, caps.select("id"), b.vectors(spark, sf)).select("id", "sample_id")


@query("centre_scores", _join("""
    SELECT id, label, round(list_dot_product(x.v, c.v), 6) AS score
    FROM vecs x JOIN centres c USING (label)""", "vecs", "centres"))
def centre_scores(spark, sf):
    v = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    centres = b.label_centres(spark, sf).withColumnRenamed("embedding", "centre")
    return v.join(centres, "label").select(
        "id", "label", r6(dot(F.col("embedding"), F.col("centre"))).alias("score"))
