"""Queries over text: clean-up functions, keyword ranking, fusion, axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import axes, evaluation, fusion, lexical, listing, postings
from siftwork.operators.similarity import isolation, knn
from siftwork.operators.selection import Selection
from siftwork.plans import bindings as b
from siftwork.plans import search as sp
from siftwork.plans.bindings import sql
from siftwork.plans.corpus_queries import STOP_SQL
from siftwork.plans.registry import ORACLES, query, r6
from siftwork.plans.vector_queries import _join
from siftwork.session import reliable_checkpoint, scratch

TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
BARE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"

# ------------------------------------------------------------------------ functions


@query("text_functions", sql(rf"""
    SELECT id,
           coalesce(nullif(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]',
               ' ', 'g'), '\s+', ' ', 'g')), ''), text) AS normalized,
           array_to_string({TOKENS.format('text')}, ' ') AS folded,
           array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z'']+'),
               lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})), ' ') AS vocabulary,
           lower(trim(text)) AS tag,
           substr({BARE.format('text')}, 1, 3) AS stem3,
           regexp_replace(trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), '^(?:a|an) (.)', '\1')
               AS canonical,
           array_to_string(list_filter(list_transform(string_split(text, '.'),
               lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), '|') AS phrases
    FROM captions""", "captions"))
def text_functions(spark, sf):
    t = F.col("text")
    return b.turns(spark, sf).select(
        "id", tx.normalize_query(t).alias("normalized"),
        F.array_join(tx.index_tokens(t), " ").alias("folded"),
        F.array_join(tx.vocabulary(t), " ").alias("vocabulary"), tx.tag_name(t).alias("tag"),
        tx.facet_stem(t).alias("stem3"), tx.canonical_name(t).alias("canonical"),
        F.array_join(tx.detector_phrases(t), "|").alias("phrases"))


@query("match_terms", sql(rf"""
    , w AS (SELECT query_id, {WORDS.format('text')} AS ws FROM queries),
    c AS (SELECT query_id, ws, list_filter(ws, lambda w: {BARE.format('w')} <> ''
              AND {BARE.format('w')} NOT IN ({STOP_SQL})) AS content FROM w)
    SELECT query_id, array_to_string(CASE WHEN len(content) = 0 THEN ws ELSE content END, ' ') AS terms
    FROM c""", "queries").replace("\n\n    ,", ","))
def match_terms(spark, sf):
    return b.page_queries(spark, sf).select(
        "query_id", F.array_join(tx.match_terms(F.col("text")), " ").alias("terms"))


# -------------------------------------------------------------------------- keyword

def lexical_sql(captions: str) -> str:
    """BM25 with the whole conjunction required, over a captions relation."""
    return rf"""
    , toks AS (SELECT id AS caption_id, sample_id, {TOKENS.format('text')} AS t FROM {captions}),
    post AS (SELECT caption_id, sample_id, len(t) AS length, unnest(t) AS token,
                    generate_subscripts(t, 1) - 1 AS pos FROM toks),
    stat AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
    w AS (SELECT query_id, {WORDS.format('text')} AS ws FROM queries),
    c AS (SELECT query_id, ws, list_filter(ws, lambda w: {BARE.format('w')} <> ''
              AND {BARE.format('w')} NOT IN ({STOP_SQL})) AS content FROM w),
    term AS (SELECT query_id, unnest(CASE WHEN len(content) = 0 THEN ws ELSE content END) AS word FROM c),
    phr AS (SELECT query_id, array_to_string({TOKENS.format('word')}, ' ') AS phrase, count(*) AS times
            FROM term WHERE len({TOKENS.format('word')}) > 0 GROUP BY ALL),
    want AS (SELECT phrase, len(string_split(phrase, ' ')) AS width, unnest(string_split(phrase, ' ')) AS token,
                    generate_subscripts(string_split(phrase, ' '), 1) - 1 AS off
             FROM (SELECT DISTINCT phrase FROM phr)),
    hit AS (SELECT phrase, caption_id, sample_id, length, count(*) AS tf FROM (
                SELECT phrase, caption_id, sample_id, length, pos - off AS start FROM post JOIN want USING (token)
                GROUP BY phrase, caption_id, sample_id, length, pos - off, width HAVING count(*) = width)
            GROUP BY ALL),
    df AS (SELECT phrase, count(*) AS df FROM hit GROUP BY 1),
    need AS (SELECT query_id, count(*) AS k FROM phr GROUP BY 1),
    bm AS (SELECT query_id, caption_id, sample_id, round(sum(times
               * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)
               * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
           FROM phr JOIN df USING (phrase) JOIN hit USING (phrase) JOIN need USING (query_id), stat
           GROUP BY query_id, caption_id, sample_id, k HAVING count(*) = k)
"""


KEYWORD = lexical_sql("line_captions") + """
    , best AS (SELECT query_id, sample_id AS id, max(score) AS score FROM bm GROUP BY ALL),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best)
"""


@query("bm25_and", _join(lexical_sql("line_captions") + """
    SELECT query_id, caption_id, sample_id, round(score, 6) AS score FROM bm""",
    "line_captions", "queries"))
def bm25_and(spark, sf):
    got = lexical.bm25_captions(b.line_captions(spark, sf), b.page_queries(spark, sf))
    return got.withColumn("score", r6("score"))


@query("bm25_from_postings", ORACLES["bm25_and"])
def bm25_from_postings(spark, sf):
    """A third of the captions is indexed, the others are appended in two turns."""
    caps, path = b.line_captions(spark, sf), scratch(spark)
    for part in range(3):
        index = postings.append(caps.where(F.pmod("sample_id", F.lit(3)) == part), path)
    got = postings.bm25_captions(index, b.page_queries(spark, sf))
    return got.withColumn("score", r6("score"))


@query("bm25_documents", _join(
    lexical_sql("(SELECT doc_id AS id, doc_id AS sample_id, text FROM documents)") + """
    SELECT query_id, caption_id, sample_id, round(score, 6) AS score FROM bm""", "queries"))
def bm25_documents(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("sample_id"), "text")
    got = lexical.bm25_captions(docs, b.page_queries(spark, sf))
    return got.withColumn("score", r6("score"))


@query("keyword_samples", _join(KEYWORD + """
    SELECT query_id, id, CAST(rank AS INT) AS rank FROM kw WHERE rank <= 300""",
    "line_captions", "queries"))
def keyword_samples(spark, sf):
    got = lexical.keyword_ranking(b.line_captions(spark, sf), b.page_queries(spark, sf), 300)
    return got.select("query_id", "id", "rank")


@query("keyword_from_postings", _join(KEYWORD + """
    SELECT query_id, id, CAST(rank AS INT) AS rank FROM kw WHERE rank <= 20""", "line_captions", "queries"))
def keyword_from_postings(spark, sf):
    """The best twenty, cut by block bounds."""
    index = postings.build(b.line_captions(spark, sf), scratch(spark))
    return postings.keyword_ranking(index, b.page_queries(spark, sf), 20).select("query_id", "id", "rank")


@query("keyword_filtered", _join(KEYWORD + """
    , fil AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
              FROM kw JOIN samples s USING (id) WHERE s.split = 'train')
    SELECT query_id, id, CAST(rank AS INT) AS rank FROM fil WHERE rank <= 20""",
    "samples", "line_captions", "queries"))
def keyword_filtered(spark, sf):
    c = b.lines(spark, sf)
    allowed = Selection(split="train").selected_ids(c)
    got = lexical.keyword_ranking(c.captions, b.page_queries(spark, sf), 20, allowed=allowed)
    return got.select("query_id", "id", "rank")


TAG_LANE = """
    , tw AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(text), '\\s+')) AS tag FROM queries),
    th AS (SELECT DISTINCT query_id, sample_id AS id FROM tw JOIN vlm_tags USING (tag)),
    al AS (SELECT query_id, id, 0 AS source, score FROM kw
           UNION ALL SELECT query_id, id, 1, 0 FROM th WHERE (query_id, id) NOT IN (SELECT query_id, id FROM kw)),
    lane AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, score DESC, id) AS pos FROM al)
"""


@query("keyword_with_tags", _join(KEYWORD.replace(
    "queries)", "queries)") + TAG_LANE + """
    SELECT query_id, id, CAST(pos AS INT) AS rank, source FROM lane WHERE pos <= 300""",
    "line_captions", "queries", "vlm_tags").replace("FROM queries", "FROM asked").replace(
    "vlm_tags AS (", "asked AS (SELECT query_id, text || ' Good' AS text FROM queries),\n    vlm_tags AS ("))
def keyword_with_tags(spark, sf):
    """Titles that also name a model tag: tag hits follow the caption hits."""
    c = b.lines(spark, sf)
    asked = b.page_queries(spark, sf).withColumn("text", F.concat("text", F.lit(" Good")))
    got = lexical.keyword_ranking(c.captions, asked, 300, vlm_tags=c.vlm_tags)
    return got.select("query_id", "id", "rank", "source")


@query("bm25_stemmed")
def bm25_stemmed(spark, sf):
    got = lexical.bm25_captions(b.line_captions(spark, sf), b.page_queries(spark, sf), stem=True)
    return got.withColumn("score", r6("score"))


OWN = r"""
    queries AS (SELECT id AS query_id, text FROM captions)
"""


@query("held_out_pool", _join(lexical_sql("captions") + """
    , m AS (SELECT query_id, count(DISTINCT sample_id) AS pool FROM bm
            WHERE query_id <> caption_id GROUP BY 1)
    SELECT query_id, coalesce(pool, 0) AS pool FROM queries LEFT JOIN m USING (query_id)""",
    "captions").replace("toks AS", OWN.strip() + ",\n    toks AS", 1))
def held_out_pool(spark, sf):
    """Every turn asks for the others that say all of its words."""
    caps = b.turns(spark, sf)
    asked = caps.select(F.col("id").alias("query_id"), "text")
    own = asked.select("query_id", F.col("query_id").alias("caption_id"))
    return lexical.pool_sizes(lexical.bm25_captions(caps, asked, exclude=own), asked)


@query("lexical_pool", _join(KEYWORD + """
    SELECT query_id, coalesce(pool, 0) AS pool FROM queries LEFT JOIN (
        SELECT query_id, count(DISTINCT sample_id) AS pool FROM bm GROUP BY 1) USING (query_id)""",
    "line_captions", "queries"))
def lexical_pool(spark, sf):
    return lexical.caption_pools(b.line_captions(spark, sf), b.page_queries(spark, sf))


@query("term_stats", _join(rf"""
    , toks AS (SELECT id, sample_id, {TOKENS.format('text')} AS t FROM line_captions),
    post AS (SELECT id, sample_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
    ask AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(text), '\s+')) AS term FROM queries),
    one AS (SELECT query_id, term, {TOKENS.format('term')} AS t FROM ask
            WHERE term <> '' AND term NOT IN ({STOP_SQL})),
    phr AS (SELECT t, unnest(t) AS token, generate_subscripts(t, 1) AS off FROM (
                SELECT DISTINCT t FROM one WHERE len(t) > 0)),
    have AS (SELECT DISTINCT t, sample_id FROM (
                SELECT t, id, sample_id FROM post JOIN phr USING (token)
                GROUP BY t, id, sample_id, pos - off HAVING count(*) = len(t)))
    SELECT query_id, term, count(sample_id) AS samples,
           round_even(count(sample_id) / (SELECT count(*) FROM samples), 4) AS fraction,
           count(sample_id) / (SELECT count(*) FROM samples) >= 0.2 AS common
    FROM one LEFT JOIN have USING (t) WHERE len(t) > 0 GROUP BY query_id, term""",
    "samples", "line_captions", "queries"))
def term_stats(spark, sf):
    c = b.lines(spark, sf)
    n = c.samples.agg(F.count(F.lit(1)).alias("n"))
    return lexical.term_stats(c.captions, b.page_queries(spark, sf), n)


# --------------------------------------------------------------------------- hybrid

HYBRID = KEYWORD + """
    , sem AS (SELECT query_id, b_id AS id, score, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, b_id) AS rank
        FROM sims JOIN queries ON query_id % (SELECT count(*) FROM vecs) = a_id),
    fus AS (SELECT query_id, id, s.rank AS semantic_rank, k.rank AS keyword_rank,
                   coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + k.rank), 0) AS score
            FROM (SELECT * FROM sem WHERE rank <= 300) s
            FULL JOIN (SELECT * FROM kw WHERE rank <= 300) k USING (query_id, id)),
    rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
                semantic_rank NULLS LAST, keyword_rank NULLS LAST) AS rank FROM fus)
"""
HYBRID_FRAGMENTS = ("line_captions", "queries", "vecs", "sims")


def _with_vector(spark, sf, rows, number):
    """Each row with a vector: the one of its number, counted round the vector table."""
    v = b.vectors(spark, sf)
    at = F.pmod(F.col(number), F.lit(v.count()))
    return rows.withColumn("_at", at).join(v.withColumnRenamed("id", "_at"), "_at").drop("_at")


def _vector_queries(spark, sf):
    return _with_vector(spark, sf, b.page_queries(spark, sf), "query_id")


def _lanes(spark, sf):
    asked = _vector_queries(spark, sf)
    semantic = knn(b.vectors(spark, sf), asked.select("query_id", "embedding"), 300)
    keyword = lexical.keyword_ranking(
        b.line_captions(spark, sf), b.page_queries(spark, sf), 300)
    return semantic, keyword


@query("hybrid_rrf", _join(HYBRID + """
    SELECT query_id, id, CAST(semantic_rank AS INT) AS semantic_rank,
           CAST(keyword_rank AS INT) AS keyword_rank, round(score, 9) AS score,
           CAST(rank AS INT) AS rank FROM rrf WHERE rank <= 300""", *HYBRID_FRAGMENTS))
def hybrid_rrf(spark, sf):
    got = fusion.reciprocal_rank_fusion(*_lanes(spark, sf), depth=300)
    return got.select("query_id", "id", "semantic_rank", "keyword_rank",
                      F.round("score", 9).alias("score"), "rank")


@query("hybrid_from_postings", ORACLES["hybrid_rrf"])
def hybrid_from_postings(spark, sf):
    """hybrid_rrf with its keyword lane from the posting table."""
    index = postings.build(b.line_captions(spark, sf), scratch(spark))
    keyword = postings.keyword_ranking(index, b.page_queries(spark, sf), 300)
    got = fusion.reciprocal_rank_fusion(_lanes(spark, sf)[0], keyword, depth=300)
    return got.select("query_id", "id", "semantic_rank", "keyword_rank", F.round("score", 9).alias("score"), "rank")


@query("match_paths", _join(HYBRID + """
    SELECT query_id, id, array_to_string(list_filter([
        CASE WHEN keyword_rank IS NOT NULL THEN 'keyword:' || keyword_rank END,
        CASE WHEN semantic_rank IS NOT NULL THEN 'semantic:' || semantic_rank END],
        lambda x: x IS NOT NULL), ' ') AS paths FROM fus""", *HYBRID_FRAGMENTS))
def match_paths(spark, sf):
    semantic, keyword = _lanes(spark, sf)
    got = fusion.match_paths(semantic=semantic, keyword=keyword)
    return got.select("query_id", "id", F.array_join(F.transform(
        "paths", lambda p: F.concat_ws(":", p["path"], p["rank"])), " ").alias("paths"))


@query("search_page", _join(HYBRID + """
    SELECT query_id, id, CAST(rank AS INT) AS rank,
           60 < least(count(*) OVER (PARTITION BY query_id), 300) AS has_more
    FROM rrf WHERE rank <= 300 AND id IN (SELECT doc_id FROM documents)
    QUALIFY rank <= 60""", *HYBRID_FRAGMENTS))
def search_page(spark, sf):
    """First page of hybrid search with the full result row, cut to its keys."""
    c = b.lines(spark, sf).with_tables(vlm_tags=None)
    got = sp.search(c, _vector_queries(spark, sf), "hybrid", stem=False)
    return got.select("query_id", "id", "rank", "has_more")


@query("merged_lists", _join(HYBRID + """
    , al AS (SELECT query_id, id, 0 AS source, rank FROM kw WHERE rank <= 300
        UNION ALL SELECT query_id, id, 1, rank FROM sem s
        WHERE rank <= 300 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = s.query_id
                                          AND kw.id = s.id AND kw.rank <= 300)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, rank) AS pos FROM al)
    SELECT query_id, id, source, CAST(pos AS INT) AS rank FROM r WHERE pos <= 50""", *HYBRID_FRAGMENTS))
def merged_lists(spark, sf):
    semantic, keyword = _lanes(spark, sf)
    return fusion.merge_lists(keyword, semantic, 50)


@query("rerank_by_axis", _join(HYBRID + """
    , r AS (SELECT query_id, id, round(score, 9) AS score, clutter, row_number() OVER (
                PARTITION BY query_id ORDER BY clutter DESC NULLS LAST, id) AS rank
            FROM rrf JOIN scored USING (id) WHERE rrf.rank <= 300)
    SELECT query_id, id, score, clutter, CAST(rank AS INT) AS rank FROM r""",
    "samples", "axis_values", "scored", *HYBRID_FRAGMENTS))
def rerank_by_axis(spark, sf):
    # Each is written before they meet: else the search fills all cores while a broadcast of the samples waits.
    lanes = [reliable_checkpoint(lane) for lane in _lanes(spark, sf)]
    fused = fusion.reciprocal_rank_fusion(*lanes, depth=300)
    samples = reliable_checkpoint(b.docs(spark, sf, axes=True).samples.select("id", "clutter"))
    got = listing.rerank_by_axis(fused, samples, "clutter_desc")
    return got.select("query_id", "id", F.round("score", 9).alias("score"), "clutter", "rank")


@query("benchmark_modes", _join(lexical_sql("captions") + """
    , ask AS (SELECT q.id AS query_id, q.sample_id AS target, v, len(list_filter(
                  string_split_regex(q.text, '\\s+'), lambda w: w <> '')) AS words
              FROM captions q JOIN vecs ON vecs.id = (q.sample_id + q.idx) % (SELECT count(*) FROM vecs)),
    best AS (SELECT query_id, sample_id AS id, max(score) AS score FROM bm
             WHERE query_id <> caption_id GROUP BY ALL),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best),
    sc AS (SELECT query_id, target, x.id, list_dot_product(ask.v, x.v) AS score FROM ask, vecs x),
    sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc),
    srank AS (SELECT s.query_id, count(*) FILTER (round(s.score, 12) > round(t.score, 12)) AS r FROM sc s
              JOIN sc t ON t.query_id = s.query_id AND t.id = t.target GROUP BY s.query_id),
    krank AS (SELECT ask.query_id, coalesce(any_value(kw.rank) - 1, 11) AS r FROM ask
              LEFT JOIN kw ON kw.query_id = ask.query_id AND kw.id = target AND kw.rank <= 10 GROUP BY ALL),
    fus AS (SELECT query_id, id, s.rank AS sr, k.rank AS kr,
                   coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + k.rank), 0) AS score
            FROM (SELECT * FROM sem WHERE rank <= 300) s
            FULL JOIN (SELECT * FROM kw WHERE rank <= 300) k USING (query_id, id)),
    rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sr NULLS LAST,
                kr NULLS LAST) AS rank FROM fus),
    hrank AS (SELECT ask.query_id, coalesce(any_value(rrf.rank) - 1, 11) AS r FROM ask
              LEFT JOIN rrf ON rrf.query_id = ask.query_id AND rrf.id = target AND rrf.rank <= 10 GROUP BY ALL),
    al AS (SELECT 'semantic' AS mode, r FROM srank UNION ALL SELECT 'keyword', r FROM krank
           UNION ALL SELECT 'hybrid', r FROM hrank)
    SELECT mode, count(*) AS queries, round(avg((r < 1)::INT), 6) AS recall_at_1,
           round(avg((r < 5)::INT), 6) AS recall_at_5, round(avg((r < 10)::INT), 6) AS recall_at_10,
           round(avg(CASE WHEN r < 10 THEN 1 / (r + 1) ELSE 0 END), 6) AS mrr,
           CASE WHEN mode = 'semantic' OR median(r + 1) <= 10 THEN CAST(median(r + 1) AS DOUBLE) END AS median_rank,
           (SELECT round(avg(words), 6) FROM ask) AS mean_query_words
    FROM al GROUP BY mode""", "captions", "vecs", "sims").replace(
        "toks AS", OWN.strip() + ",\n    toks AS", 1))
def benchmark_modes(spark, sf):
    """Turns as queries for their conversation, by text and by a vector."""
    caps = b.turns(spark, sf)
    v = b.vectors(spark, sf)
    linked = caps.withColumn("vec", F.col("sample_id") + F.col("idx"))
    asked = _with_vector(spark, sf, linked, "vec").select(
        F.col("id").alias("query_id"), "text", F.col("sample_id").alias("target_id"), "embedding")
    got = evaluation.benchmark(asked, caps, v)
    return got.select("mode", "queries", *[r6(c).alias(c) for c in (
        "recall_at_1", "recall_at_5", "recall_at_10", "mrr")], "median_rank",
        r6("mean_query_words").alias("mean_query_words"))


@query("on_target", _join("""
    , near AS (SELECT query_id, b_id AS id, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, b_id) AS rank
        FROM sims JOIN queries ON query_id % (SELECT count(*) FROM vecs) = a_id),
    f AS (SELECT sample_id, arg_min(text, idx) AS t FROM captions GROUP BY 1),
    wd AS (SELECT sample_id, string_split_regex(regexp_replace(lower(t), '[.,]', ' ', 'g'), '\\s+') AS ws FROM f),
    q AS (SELECT query_id, string_split_regex(regexp_replace(lower(text), '[.,]', ' ', 'g'), '\\s+') AS ws
          FROM queries)
    SELECT query_id, round(avg(CASE WHEN coalesce(list_has_any(wd.ws, q.ws), FALSE) THEN 1 ELSE 0 END), 6)
        AS on_target
    FROM near JOIN q USING (query_id) LEFT JOIN wd ON sample_id = id WHERE rank <= 10 GROUP BY 1""",
    "captions", "queries", "vecs", "sims"))
def on_target(spark, sf):
    from siftwork.operators.details import first_captions

    asked = _vector_queries(spark, sf)
    ranking = knn(b.vectors(spark, sf), asked.select("query_id", "embedding"), 10)
    words = F.split(F.regexp_replace(F.lower("text"), "[.,]", " "), r"\s+")
    got = evaluation.on_target_rate(
        ranking, first_captions(b.turns(spark, sf)), asked.select("query_id", words.alias("words")))
    return got.withColumn("on_target", r6("on_target"))


# ----------------------------------------------------------------------------- axes

SIGNALS = rf"""
    , wl AS (SELECT id, sample_id, list_filter(regexp_extract_all(lower(text), '[a-z'']+'),
                 lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})) AS ws FROM line_captions),
    ex AS (SELECT id, sample_id, unnest(list_distinct(ws)) AS word FROM wl),
    idf AS (SELECT word, ln((SELECT count(DISTINCT sample_id) FROM line_captions) / (1 + count(*))) AS idf
            FROM ex GROUP BY word),
    sw AS (SELECT DISTINCT sample_id, word FROM ex),
    rk AS (SELECT sample_id, idf, row_number() OVER (PARTITION BY sample_id ORDER BY idf DESC, word) AS pos
           FROM sw JOIN idf USING (word)),
    rar AS (SELECT sample_id, avg(idf) AS word_rarity FROM rk WHERE pos <= 3 GROUP BY 1),
    voc AS (SELECT sample_id, CAST(count(*) AS DOUBLE) AS vocab FROM sw GROUP BY 1),
    sig AS (SELECT sample_id, word_rarity, coalesce(vocab, 0) AS vocab, length_sd FROM (
                SELECT sample_id, stddev_pop(len(ws)) AS length_sd FROM wl GROUP BY 1)
            LEFT JOIN rar USING (sample_id) LEFT JOIN voc USING (sample_id))
"""


@query("vocab_signals", _join(SIGNALS + """
    SELECT sample_id, round(word_rarity, 6) AS word_rarity, vocab, round(length_sd, 6) AS length_sd FROM sig""",
    "line_captions"))
def vocab_signals(spark, sf):
    got = lexical.vocabulary_signals(b.line_captions(spark, sf))
    return got.select("sample_id", r6("word_rarity").alias("word_rarity"), "vocab",
                      r6("length_sd").alias("length_sd"))


@query("axes", _join(SIGNALS + """
    , nr AS (SELECT a_id AS id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS pos
             FROM sims WHERE a_id <> b_id),
    iso AS (SELECT id, 1 - avg(score) AS isolation FROM nr WHERE pos <= 10 GROUP BY 1),
    agr AS (SELECT sample_id AS id, avg(agreement) AS agreement FROM captions GROUP BY 1),
    comp AS (
        SELECT sample_id AS id, 'rarity' AS axis, 'word_rarity' AS m, round(word_rarity, 9) AS value FROM sig
        UNION ALL SELECT id, 'rarity', 'isolation', round(isolation, 9) FROM iso
        UNION ALL SELECT id, 'difficulty', 'agreement', -round(agreement, 9) FROM agr
        UNION ALL SELECT sample_id, 'clutter', 'vocab', vocab FROM sig
        UNION ALL SELECT sample_id, 'clutter', 'length_sd', round(length_sd, 9) FROM sig),
    pb AS (SELECT *, round_even(percent_rank() OVER (PARTITION BY m ORDER BY value) * 10, 0) / 10 AS p
           FROM comp WHERE value IS NOT NULL),
    ax AS (SELECT id, axis, avg(p) AS value, string_agg(CASE m WHEN 'word_rarity' THEN 'rare wording'
               WHEN 'isolation' THEN 'unlike its neighbours' WHEN 'agreement' THEN 'weak caption match'
               WHEN 'vocab' THEN 'many things named' ELSE 'uneven captions' END, ', '
               ORDER BY p DESC, m DESC) FILTER (p >= 0.7) AS why FROM pb GROUP BY ALL)
    SELECT id, axis, CAST(round_even(percent_rank() OVER (PARTITION BY axis ORDER BY value) * 10, 0) AS INT)
        AS score, why FROM ax""", "line_captions", "captions", "vecs", "sims"))
def score_axes(spark, sf):
    """Measures rounded first: a last-bit difference would move a tied rank."""
    signals = lexical.vocabulary_signals(b.line_captions(spark, sf)).withColumnRenamed("sample_id", "id")
    agreement = b.turns(spark, sf).groupBy(F.col("sample_id").alias("id")).agg(
        F.avg("agreement").alias("agreement"))
    measures = signals.join(isolation(b.vectors(spark, sf)), "id", "full_outer").join(
        agreement, "id", "full_outer")
    rounded = measures.select("id", "vocab", *[F.round(c, 9).alias(c) for c in (
        "word_rarity", "length_sd", "isolation", "agreement")])
    return axes.score_axes(rounded).select("id", "axis", "score", "why")
