import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.functions.porter import stem
from siftwork.session import spread
from siftwork.operators import fusion, lexical


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("A Dog, running!", "a dog running"), ("Épée  d'Été", "épée d été"), ("?!", "?!"), ("dog", "dog")])
def test_normalize_query(spark, raw, want):
    assert one(spark, tx.normalize_query, raw) == want
    assert one(spark, tx.normalize_query, want) == want


@pytest.mark.parametrize("raw, want", [
    ("a man on the bench", ["man", "bench"]), ("the two", ["the", "two"]),
    ('say "dog" now', ["say", '"dog"', "now"]), ("The Dog's ball", ["Dog's", "ball"])])
def test_match_terms(spark, raw, want):
    assert one(spark, tx.match_terms, raw) == want


def test_small_text_functions(spark):
    assert one(spark, tx.canonical_name, "  A   Dog ") == "dog"
    assert one(spark, tx.canonical_name, "an") == "an"
    assert one(spark, tx.detector_phrases, " a dog. . red  car.") == ["a dog", "red car"]
    assert one(spark, lambda c: tx.detector_phrases(c, "object"), " . ") == ["object"]
    assert one(spark, tx.tag_name, "  ") is None and one(spark, tx.tag_name, " Bad ") == "bad"
    assert one(spark, tx.facet_stem, "Field/Park") == "fie"
    assert one(spark, tx.parse_id_entries, "7, a.jpg\r\n\n7 ,9") == ["7", "a.jpg", "9"]
    assert one(spark, tx.index_tokens, "Élan d'or 3x") == ["elan", "d", "or", "3x"]


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("runs", "run"), ("hopping", "hop"),
    ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("happy", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopeful", "hope"),
    ("revival", "reviv"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"),
    ("falling", "fall"), ("filing", "file"), ("sky", "sky"), ("yellow", "yellow"), ("été", "été")])
def test_porter(word, want):
    assert stem(word) == want


@pytest.fixture(scope="module")
def captions(spark):
    return spark.createDataFrame([
        (1, 10, "a dog runs on the grass"), (2, 10, "brown dog running"), (3, 20, "a cat sleeps"),
        (4, 30, "two dogs run"), (5, 40, "ice-cream van by the sea"), (6, 50, "cream ice"),
        (7, 60, "Café terrace")], "id long, sample_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def ids(df):
    return sorted((r.query_id, r.sample_id) for r in df.collect())


def test_conjunction_phrases_and_folding(spark, captions):
    q = ask(spark, "dog grass", "dog zebra", "ice-cream", "cafe", "the dog on")
    assert ids(lexical.bm25_captions(captions, q)) == [(1, 10), (3, 40), (4, 60), (5, 10), (5, 10)]


def test_stemming_widens_forms_only(spark, captions):
    got = lexical.bm25_captions(captions, ask(spark, "run dog"), stem=True)
    assert sorted(r.caption_id for r in got.collect()) == [1, 2, 4]
    assert lexical.bm25_captions(captions, ask(spark, "run dog")).count() == 0


def test_held_out_caption_does_not_retrieve_itself(spark, captions):
    q = ask(spark, "dog")
    own = spark.createDataFrame([(1, 1)], "query_id long, caption_id long")
    got = lexical.bm25_captions(captions, q, exclude=own).collect()
    assert [r.caption_id for r in got] == [2]
    assert lexical.pool_sizes(lexical.bm25_captions(captions, ask(spark, "dog", "unicorn")),
                              ask(spark, "dog", "unicorn")).orderBy("query_id").collect()[1].pool == 0


def test_filter_inside_and_tag_hits_after(spark, captions):
    allowed = spark.createDataFrame([(20,), (10,)], "id long")
    tags = spark.createDataFrame([(20, "dog"), (10, "dog"), (30, "dog")], "sample_id long, tag string")
    got = lexical.keyword_ranking(captions, ask(spark, "Dog"), 10, allowed=allowed, vlm_tags=tags)
    assert [(r.id, r.source) for r in got.orderBy("rank").collect()] == [(10, 0), (20, 1)]


def test_term_stats(spark, captions):
    n = spark.createDataFrame([(6,)], "n long")
    got = {r.term: (r.samples, r.common) for r in lexical.term_stats(
        captions, ask(spark, "The dog zebra dog"), n).collect()}
    assert got == {"dog": (1, False), "zebra": (0, False)}


def test_term_stats_move_no_postings(spark, captions, monkeypatch):
    def moved(*_):
        raise AssertionError("postings of all captions")
    monkeypatch.setattr(lexical, "phrase_hits", moved)
    n = spark.createDataFrame([(6,)], "n long")
    got = {r.term: r.samples for r in lexical.term_stats(captions, ask(spark, "The dog zebra dog"), n).collect()}
    assert got == {"dog": 1, "zebra": 0}


def test_rrf_ties_follow_semantic_then_keyword(spark):
    rank = "query_id long, id long, rank int"
    sem = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], rank)
    kw = spark.createDataFrame([(1, 7, 1), (1, 6, 2)], rank)
    got = fusion.reciprocal_rank_fusion(sem, kw).orderBy("rank").collect()
    assert [r.id for r in got] == [6, 5, 7]
    assert got[0].score == pytest.approx(2 / 62)


def test_pages_partition_the_ranking(spark):
    ranking = spark.range(0, 310).selectExpr(
        "1L AS query_id", "id", "cast(id + 1 AS int) AS rank", "0D AS score")
    pages = [fusion.window_of(ranking, o, 60).collect() for o in range(0, 360, 60)]
    seen = [r.id for p in pages for r in p]
    assert sorted(seen) == list(range(300)) and len(set(seen)) == 300
    assert all(r.has_more for r in pages[3]) and not any(r.has_more for r in pages[4])
    assert all(r.depth_reached for r in pages[4])


def test_stemming_filters_postings_before_they_move(spark):
    caps = spark.createDataFrame([(1, 1, "runs running runner"), (2, 2, "a run in the park"), (3, 3, "parked cars")],
                                 "id long, sample_id long, text string")
    asked = spark.createDataFrame([(1, "running"), (2, "parks cars")], "query_id long, text string")
    phrases = lexical.query_phrases(asked, stem=True)
    hits = lexical.phrase_hits(caps, phrases, stem=True)
    got = {(r.phrase, r.caption_id): r.tf for r in hits.collect()}
    assert got == {("run", 1): 2, ("run", 2): 1, ("park", 2): 1, ("park", 3): 1, ("car", 3): 1}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("Exchange hashpartitioning(caption_id") < plan.index("posexplode")
    assert "stem_column" not in plan


def test_release_empties_the_shared_folder(spark, tmp_path):
    import os

    from siftwork import session
    saved = session.reliable_checkpoint(spark.range(3))
    folder = session.checkpoint_folder(spark).removeprefix("file://") + "/tables"
    assert saved.count() == 3 and os.listdir(folder)
    kept = dict(session._written)
    session._written[spark.sparkContext.applicationId] = kept[spark.sparkContext.applicationId][-1:]
    session.release(spark)
    assert kept[spark.sparkContext.applicationId][-1] not in os.listdir(folder)


def test_matching_moves_no_postings_and_cuts_keep_the_best(spark, monkeypatch):
    """Captions stream past the queries: what a task hands on is matches, and, to a depth, few of them."""
    from siftwork.operators import phrase_index as px

    texts = ["red dog", "dog red red", "dog", "red-dog dog", "a cat", None, "", "dog red dog red"]
    caps = spark.createDataFrame([(i, i // 3, texts[i * 7 % len(texts)]) for i in range(240)],
                                 "id long, sample_id long, text string").repartition(6)
    asked = ask(spark, "dog red", "red the dog", "dog", "red-dog", "Dog dog", "zebra dog", "dog")
    plain = lexical._bm25_by_hits(caps, asked, lexical.query_phrases(asked), False, None, None)
    got = lexical.bm25_captions(caps, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 300
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = lexical.keyword_ranking(caps, asked, 5, scored=plain)
    monkeypatch.setattr(px, "STEP", 16)
    monkeypatch.setattr(lexical, "HELD_BYTES", 400)  # several passes
    monkeypatch.setattr(px.Best.__init__, "__defaults__", (32,))
    cut = lexical.keyword_ranking(caps, asked, 5)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))
    stems = lexical.bm25_captions(caps, asked, stem=True)
    assert sorted(map(tuple, stems.collect())) == sorted(map(tuple, lexical._bm25_by_hits(
        caps, asked, lexical.query_phrases(asked, True), True, None, None).collect()))


def test_only_the_first_samples_of_a_tag_are_listed(spark, captions):
    tags = spark.createDataFrame([(i, "dog") for i in range(100)] + [(5, "dog")], "sample_id long, tag string")
    got = lexical.keyword_ranking(captions, ask(spark, "Dog", "zebra dog"), 4, vlm_tags=tags)
    assert [(r.query_id, r.id, r.source) for r in got.orderBy("query_id", "rank").collect()] == [
        (1, 10, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)]


@pytest.mark.parametrize("common", [1, 4, 100])
def test_vocabulary_signals_of_common_and_rare_words(spark, monkeypatch, common):
    monkeypatch.setattr(lexical, "COMMON_WORDS", common)
    texts = [(1, "The red fox, the red hen"), (1, "a fox's den"), (2, "red red red"), (2, "hen of it"), (3, "Of an a"),
             (4, "under blue fox hen red"), (5, None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "id long, sample_id long, text string")
    got = {r.sample_id: r for r in lexical.vocabulary_signals(df).collect()}
    words = [[w for w in re.findall("[a-z']+", (t or "").lower()) if len(w) > 2 and w not in tx.STOPWORDS] for _, t in texts]
    held = Counter(w for ws in words for w in set(ws))
    for sample in (1, 2, 3, 4):
        mine = {w for (s, _), ws in zip(texts, words, strict=True) if s == sample for w in ws}
        top = sorted((math.log(5 / (1 + held[w])) for w in mine), reverse=True)[:3]
        assert got[sample].vocab == len(mine)
        assert got[sample].word_rarity == (pytest.approx(sum(top) / len(top)) if top else None)
    assert set(got) == {1, 2, 3, 4, 5} and got[5].vocab == 0


def test_distinct_vocabulary_is_the_vocabulary_once(spark):
    df = spark.createDataFrame([("It's the 'red' Fox_fox, foxes don't; an ox",), ("",), (None,), ("x''y ''' of OFF",)], "t string")
    rows = df.select(tx.distinct_vocabulary(F.col("t")).alias("d"), F.array_distinct(tx.vocabulary(F.col("t"))).alias("v"))
    assert all(r.d == r.v for r in rows.collect())


def test_pools_are_counted_once_for_equal_queries(spark):
    """Members are joined to a count, never to matches; a text that is spread already is not moved again."""
    caps = spark.createDataFrame([(i, i // 3, ["red dog", "dog dog", "a red-dog", "cat"][i % 4]) for i in range(60)],
                                 "id long, sample_id long, text string")
    asked = ask(spark, "dog", "Dog", "red dog", "dog dog", "zebra", "the dog")
    want = {r.query_id: r.pool for r in lexical.pool_sizes(lexical.bm25_captions(caps, asked), asked).collect()}
    got = lexical.caption_pools(caps, asked)
    assert {r.query_id: r.pool for r in got.collect()} == want and max(want.values()) > 10
    small = spark.range(60).select(F.concat(F.lit("red dog "), "id").alias("text"))
    lines = spread(small).select(F.explode(F.split("text", " ")).alias("text")).where("text <> ''")
    assert spread(lines.select("text"))._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
