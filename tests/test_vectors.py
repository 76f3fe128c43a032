import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from siftwork.functions.vector import unit
from siftwork.operators import albums, ball_tree, composed, hubness, leakage, signals, similarity
from siftwork.operators import vector_blocks as vb

# The second setting leaves no side small enough to hold, so blocks must join.
WAYS = [{"max_bytes": vb.BROADCAST_BYTES}, {"max_bytes": 800, "block_rows": 40}]


def vec(*xs):
    v = np.array(xs, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.fixture(scope="module")
def planted(spark):
    """Clustered unit vectors, a third of them near copies of one."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    owner = np.where(np.arange(240) % 3 == 0, 0, rng.integers(0, 6, 240))
    m = centres[owner] + rng.normal(scale=np.where(owner == 0, 0.02, 0.4)[:, None], size=(240, 8))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    df = frame(spark, [(int(i * 10), v.tolist()) for i, v in enumerate(m)])
    return df.repartition(5).cache(), m.astype(float)


def test_index_of_four(spark):
    df = frame(spark, [(10, vec(1, 0, 0)), (20, vec(.9, .1, 0)), (30, vec(0, 1, 0)), (40, vec(0, 0, 1))])
    q = spark.createDataFrame([(1, vec(1, 0, 0))], "query_id long, embedding array<float>")
    got = [r.id for r in similarity.knn(df, q, 3).orderBy("rank").collect()]
    assert got[:2] == [10, 20]
    only = df.where("id IN (30, 40)")
    assert {r.id for r in similarity.knn(only, q, 3).collect()} == {30, 40}
    near = similarity.similar_to(df, df.where("id = 10").select("id"), 2)
    assert 10 not in [r.id for r in near.collect()]
    assert [(r.a_id, r.b_id) for r in similarity.pairs_above(df, 0.9).collect()] == [(10, 20)]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("t", [0.3, 0.9, 0.995])
def test_pairs_match_brute_force(planted, way, t):
    df, m = planted
    got = {(r.a_id, r.b_id): r.score for r in similarity.pairs_above(df, t, **way).collect()}
    s = m @ m.T
    i, j = np.nonzero(np.triu(s, 1) > t)
    assert set(got) == {(int(a) * 10, int(b) * 10) for a, b in zip(i, j)}
    assert all(abs(got[(a * 10, b * 10)] - s[a, b]) < 1e-9 for a, b in zip(i, j))
    assert similarity.pairs_above(df, t, **way).count() == len(got)  # each pair once


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_matches_brute_force(planted, way, exclude_self):
    df, m = planted
    got = similarity.knn(df, df.withColumnRenamed("id", "query_id"), 7,
                         exclude_self=exclude_self, **way).toPandas()
    s = m @ m.T
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    want = np.sort(s, axis=1)[:, ::-1][:, :7]
    scores = got.sort_values(["query_id", "rank"]).score.to_numpy().reshape(-1, 7)
    assert np.abs(scores - want).max() < 1e-9


@pytest.mark.parametrize("way", WAYS)
def test_penalty_ranks_and_returns_the_adjusted_score(planted, way):
    df, m = planted
    pen = df.withColumn("penalty", (F.col("id") % 70) / 100.0)
    got = similarity.knn(pen, df.withColumnRenamed("id", "query_id"), 5, penalty="penalty", **way).toPandas()
    s = m @ m.T - (np.arange(240) * 10 % 70 / 100.0)[None, :]
    scores = got.sort_values(["query_id", "rank"]).score.to_numpy().reshape(-1, 5)
    assert np.abs(scores - np.sort(s, axis=1)[:, ::-1][:, :5]).max() < 1e-9


@pytest.mark.parametrize("way", WAYS)
def test_exact_ranks(planted, way):
    df, m = planted
    s = m @ m.T
    q = [(int(i * 10), m[i].tolist(), float(s[i, (i + 1) % 240])) for i in range(240)]
    asked = df.sparkSession.createDataFrame(q, "query_id long, embedding array<double>, own double")
    got = {r.query_id: r.rank0 for r in similarity.exact_ranks(df, asked, **way).collect()}
    assert got == {i * 10: int((s[i] > s[i, (i + 1) % 240] + 1e-12).sum()) for i in range(240)}


# ----------------------------------------------------------------------- ball tree

@pytest.fixture(scope="module")
def islands(spark):
    """Twelve tight clusters, one direction 200 times, vectors of other lengths, and zeros."""
    rng = np.random.default_rng(3)
    centres = np.eye(12)
    m = centres[np.arange(600) % 12] + rng.normal(scale=0.02, size=(600, 12))
    m = np.concatenate([m, np.tile(m[:1], (200, 1)), 3 * m[1:30], np.zeros((5, 12))])
    return frame(spark, [(i, v.tolist()) for i, v in enumerate(m)]).repartition(4).cache(), m.astype(np.float32).astype(float)


def test_tree_splits_until_leaves_fit(islands):
    df, m = islands
    homes, tree = ball_tree.build(df, 40)
    sizes = {r.cell: r["count"] for r in homes.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == len(m) and set(sizes) == set(tree.leaves.tolist())
    assert all(n <= 40 or tree.reach[c] <= np.pi for c, n in sizes.items())
    assert sum(n > 40 for n in sizes.values()) <= 2  # the copies, and what lies with them
    # Bounds hold for every query and every row.
    ids = {r.id: r.cell for r in homes.select("id", "cell").collect()}
    least, most, _ = tree.bounds(m)
    at = {c: i for i, c in enumerate(tree.leaves.tolist())}
    column = np.array([at[ids[i]] for i in range(len(m))])
    scores = m @ m.T
    assert np.all(scores <= most[:, column]) and np.all(scores >= least[:, column])


def test_tree_stops_at_its_budget(islands):
    _, tree = ball_tree.build(islands[0], 5, tree_bytes=8 * 12 * 70)
    assert len(tree.pivots) <= 70


def test_visits_leave_homes_in_one_copy_and_skip_leaves(islands, monkeypatch):
    df, m = islands
    asked = {}
    visit = ball_tree.visit

    def counted(tree, homes, routed, kernel, schema, rows):
        n = routed.agg(F.sum(F.size("targets"))).first()[0]
        asked.setdefault("share", []).append(n / (routed.count() * len(tree.leaves)))

        def copies(visitors, table, held):
            ids = vb.longs(table["id"])
            assert len(set(ids.tolist())) == len(ids) and len(ids) <= tree.rows.max()
            yield from kernel(visitors, table, held)
        return visit(tree, homes, routed, copies, schema, rows)
    monkeypatch.setattr(ball_tree, "visit", counted)
    got = similarity.knn(df, df.withColumnRenamed("id", "query_id"), 3, max_bytes=8, block_rows=40).toPandas()
    want = -np.sort(-(m @ m.T), axis=1)[:, :3]
    assert np.abs(got.sort_values(["query_id", "rank"]).score.to_numpy().reshape(-1, 3) - want).max() < 1e-9
    assert sum(asked["share"]) < 0.6  # of all leaves, in both visits


@pytest.mark.parametrize("penalised", [False, True])
def test_ranks_count_whole_leaves(islands, penalised):
    df, m = islands
    off = np.where(np.arange(len(m)) % 50 == 0, np.nan, np.arange(len(m)) % 7 / 10) if penalised else np.zeros(len(m))
    corpus = df.withColumn("penalty", F.when(F.lit(penalised) & (F.col("id") % 50 == 0), float("nan")).otherwise(
        (F.col("id") % 7 / 10) if penalised else F.lit(0.0)))
    s = np.round(m @ m.T - off[None, :], 12)
    own = np.where(np.isnan(s[np.arange(len(m)), (np.arange(len(m)) + 12) % len(m)]), 0.5, s[np.arange(len(m)), (np.arange(len(m)) + 12) % len(m)])
    asked = df.sparkSession.createDataFrame([(i, m[i].tolist(), float(own[i])) for i in range(len(m))],
                                            "query_id long, embedding array<double>, own double")
    got = {r.query_id: r.rank0 for r in similarity.exact_ranks(corpus, asked, "penalty", max_bytes=8, block_rows=40).collect()}
    assert got == {i: int((s[i] > np.round(own[i], 12)).sum()) for i in range(len(m))}


def test_trees_of_nothing(spark):
    none = frame(spark, [])
    some = frame(spark, [(1, vec(1, 0))]).withColumnRenamed("id", "query_id")
    assert similarity._knn_blocks(none, some, 2, False, None, 4).count() == 0
    assert similarity.pairs_above(none, 0.5, max_bytes=8).count() == 0


def test_isolation_of_tiny_sets(spark):
    one = frame(spark, [(1, vec(1, 0))])
    assert similarity.isolation(one).count() == 0
    two = frame(spark, [(1, vec(1, 0)), (2, vec(1, 1))])
    got = {r.id: r.isolation for r in similarity.isolation(two).collect()}
    assert got[1] == pytest.approx(1 - np.sqrt(0.5), abs=1e-6)


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.u for r in df.select(unit(F.col("v")).alias("u")).collect()] == [[0, 0], [0.6, 0.8]]


# ------------------------------------------------------------------------- hubness

def hub_case(spark):
    v = frame(spark, [(10, vec(1, 1, 0)), (20, vec(1, 0, 0)), (30, vec(0, 1, 0)), (40, vec(0, 0, 1))])
    arc = [vec(np.cos(a), np.sin(a), 0) for a in np.linspace(0.1, 1.4, 5)]
    bank = spark.createDataFrame([(i, 900 + i, a) for i, a in enumerate(arc)],
                                 "id long, sample_id long, embedding array<float>")
    return v, bank


@pytest.mark.parametrize("way", [{}, {"max_bytes": 16, "block_rows": 2}])
def test_hub_is_held_back(spark, way):
    v, bank = hub_case(spark)
    h = {r.id: r.h for r in hubness.hubness_penalty(v, bank, 0.5, **way).collect()}
    assert h[10] > h[20] > h[40]
    m = np.array([r.embedding for r in v.orderBy("id").collect()])
    b = np.array([r.embedding for r in bank.orderBy("id").collect()])
    want = 0.5 * np.log(np.exp((b @ m.T) / 0.5).sum(axis=0))
    assert np.allclose([h[i] for i in (10, 20, 30, 40)], want, atol=1e-6)


def test_own_bank_entries_do_not_count(spark):
    v, bank = hub_case(spark)
    mine = bank.withColumn("sample_id", F.lit(10).cast("long"))
    h = {r.id: r.h for r in hubness.hubness_penalty(v, mine, 0.5).collect()}
    assert h[10] == 0.0 and h[20] > 0
    assert hubness.scaled_penalty(v, beta=0) is None


# ------------------------------------------------------------------------ composed

def concept_space(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(3):
        for i in range(8):
            v = rng.normal(scale=0.05, size=8)
            v[c] += 1
            rows.append((c * 100 + i, vec(*v)))
    return frame(spark, rows)


def asked(spark, text, pos, neg):
    return spark.createDataFrame(
        [(1, text, pos, neg)],
        "query_id long, text_vec array<float>, positive_ids array<long>, negative_ids array<long>")


WAYS_COMPOSED = [{}, {"max_bytes": 64, "block_rows": 5}]


@pytest.mark.parametrize("way", WAYS_COMPOSED)
def test_text_and_example_blend(spark, way):
    v = concept_space(spark)
    q = asked(spark, vec(1, 0, 0, 0, 0, 0, 0, 0), [100], [])
    got = composed.composed_ranking(q, v, **way).orderBy("rank").collect()
    assert len(got) == 24 and {r.id // 100 for r in got[:16]} == {0, 1}
    assert got[0].score_basis == "composed"


@pytest.mark.parametrize("way", WAYS_COMPOSED)
def test_negative_pushes_away(spark, way):
    v = concept_space(spark)
    plain = composed.composed_ranking(asked(spark, None, [0, 100], []), v, **way)
    pushed = composed.composed_ranking(asked(spark, None, [0, 100], [101]), v, **way)
    before = {r.id: r.score for r in plain.collect()}
    after = {r.id: r.score for r in pushed.collect()}
    m = {r.id: np.array(r.embedding, dtype=float) for r in v.collect()}
    for i in after:
        want = before[i] - 0.5 * max(0.0, float(m[i] @ m[101]))
        assert after[i] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("way", WAYS_COMPOSED)
def test_negatives_alone_rank_by_distance_and_never_return(spark, way):
    v = concept_space(spark)
    got = composed.composed_ranking(asked(spark, None, [], [0, 1]), v, **way).orderBy("rank").collect()
    ids = [r.id for r in got]
    assert 0 not in ids and 1 not in ids and len(ids) == 22
    assert all(i // 100 == 0 for i in ids[-6:])


def test_filters_act_inside_the_ranking(spark):
    v = concept_space(spark)
    allowed = v.where("id >= 200").select("id")
    got = composed.composed_ranking(asked(spark, None, [0], []), v, depth=5, allowed=allowed).collect()
    assert len(got) == 5 and all(r.id >= 200 for r in got)


def test_missing_examples_are_named(spark):
    v = concept_space(spark)
    got = composed.missing_examples(asked(spark, None, [0, 999], [77]), v).collect()
    assert {r.id for r in got} == {999, 77}


def test_query_by_vector_drops_its_source(spark):
    v = concept_space(spark)
    q = v.where("id IN (0, 100)").select(
        F.col("id").alias("query_id"), F.col("embedding").alias("vec"),
        F.lit(None).cast("array<float>").alias("text_vec"), F.col("id").alias("source_id"),
        F.lit("positive").alias("role"), F.lit("segment").alias("kind"))
    got = composed.by_vector(q, v, 7).collect()
    assert all(r.id != r.query_id and r.id // 100 == r.query_id // 100 for r in got)
    assert {r.score_basis for r in got} == {"segment_cosine"} and len(got) == 14


# ------------------------------------------------------------------------- signals

def test_margin_gate_abstains(spark):
    v = frame(spark, [(1, vec(1, 0)), (2, vec(1, 1))])
    prompts = spark.createDataFrame(
        [("g", "a", vec(1, 0)), ("g", "b", vec(0, 1)), ("only", "x", vec(1, 0))],
        "grp string, label string, embedding array<float>")
    assert "Exchange" not in signals.zero_shot(v, prompts)._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.grp): r for r in signals.zero_shot(v, prompts).collect()}
    assert got[(1, "g")].label == "a" and (2, "g") not in got
    assert got[(2, "only")].margin == 1.0 and got[(2, "only")].confidence == pytest.approx(1.0)


def test_a_bank_in_tiles_is_the_whole_bank(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, (40, 3)).astype(float)  # few directions, so that labels tie
    v = frame(spark, [(i, vec(*p)) if p.any() else (i, None) for i, p in enumerate(points)])
    prompts = spark.createDataFrame([(g, f"{g}{k % 9}", vec(*(rng.integers(-3, 4, 3) + 0.5))) for g in "ab" for k in range(13)]
                                    + [("only", "x", vec(1, 0, 0))], "grp string, label string, embedding array<float>")
    rows = lambda: {(r.id, r.grp): (r.label, round(r.confidence, 9), round(r.margin, 9)) for r in signals.zero_shot(
        v, prompts, min_margin=0.0, scale=3.0).collect()}
    whole = rows()
    monkeypatch.setattr(signals, "PROMPTS_HELD", 5)
    assert whole and rows() == whole
    assert signals.zero_shot(v, prompts.limit(0)).count() == 0


def test_caption_agreement_skips_missing_vectors(spark):
    caps = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, sample_id long")
    cv = frame(spark, [(1, vec(1, 0)), (3, vec(0, 1))])
    v = frame(spark, [(10, vec(1, 1))])
    got = signals.caption_agreement(caps, cv, v).collect()
    assert [(r.id, round(r.agreement, 4)) for r in got] == [(1, 0.7071)]


def test_consistency_is_mean_pairwise_cosine(spark):
    caps = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20)], "id long, sample_id long")
    cv = frame(spark, [(1, vec(1, 0)), (2, vec(0, 1)), (3, vec(1, 1)), (4, vec(1, 0))])
    got = signals.caption_consistency(caps, cv).collect()
    assert len(got) == 1 and got[0].consistency == pytest.approx((0 + 2 * np.sqrt(.5)) / 3, abs=1e-6)


# ------------------------------------------------------------------------- leakage

def test_threshold_is_strict_and_side_is_held_out(spark):
    pairs = spark.createDataFrame(
        [(1, 2, 0.97, "train", "test"), (3, 4, 0.90, "validation", "train"),
         (5, 6, 0.95, "test", "validation"), (7, 8, 0.99, "train", "train")],
        "a_id long, b_id long, score double, a_split string, b_split string")
    assert [r.id for r in leakage.contaminated(pairs, 0.90).collect()] == [2]
    assert {r.id for r in leakage.contaminated(pairs, 0.89).collect()} == {2, 3}
    assert [r.id for r in leakage.contaminated(pairs, 0.85, ("validation",)).collect()] == [3]
    curve = {r.threshold: (r.pairs, r.cross_split, r.contaminated)
             for r in leakage.curve(pairs).collect()}
    assert curve[0.85] == (4, 3, 2) and curve[0.90] == (3, 2, 1) and curve[0.99] == (0, 0, 0)
    shown = leakage.examples(pairs, 0.85).collect()
    assert [r.a_id for r in shown] == [1, 5, 3, 7]
    assert {r.splits: r.pairs for r in leakage.by_split_pair(pairs, 0.85).collect()} == {
        "test~train": 1, "train~validation": 1, "test~validation": 1}


def test_ragged_and_missing_vectors_are_refused_at_the_seam():
    import pyarrow as pa

    from siftwork.operators import vector_blocks
    for rows in ([[1.0, 2.0], [1.0]], [[1.0], None]):
        with pytest.raises(ValueError, match="one width"):
            vector_blocks.matrix(pa.array(rows))
    assert vector_blocks.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).shape == (2, 2)


def test_coherence_at_full_width(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    items = spark.createDataFrame([(i % 2, i) for i in range(40)], "album_id long, sample_id long")
    got = {r.album_id: r.coherence for r in albums.coherence(items, vectors).collect()}
    for album in (0, 1):
        own = x[album::2]
        pairs = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert got[album] == pytest.approx(pairs.mean())


def test_visitors_come_once_to_a_tile_of_many_leaves(spark, monkeypatch):
    """Vectors that fill the space name all leaves; copies of visitors follow tiles, and hits that cannot
    rank stay in their task."""
    m = np.random.default_rng(8).normal(size=(400, 8))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    homes, tree = ball_tree.build(df, 8)
    routed = ball_tree.routes(tree, df, lambda batch, least, most, angles, t: (np.ones(most.shape, bool), {})).cache()
    copies = []
    streamed = ball_tree._streamed
    monkeypatch.setattr(ball_tree, "_streamed", lambda *a: copies.append(1) or (lambda batches: (
        pa.record_batch({"n": [sum(int(s) for s in b["_side"].to_pylist())]}) for b in batches)))
    sent = ball_tree.visit(tree, homes, routed, None, "n long", 1000).agg(F.sum("n")).first()[0]
    assert copies and len(tree.leaves) > 20 and sent == 400
    monkeypatch.setattr(ball_tree, "_streamed", streamed)
    got = similarity.knn(df, df.withColumnRenamed("id", "query_id"), 3, max_bytes=8, block_rows=8)
    want = np.argsort(-(m.astype(np.float32).astype(float) @ m.astype(np.float32).astype(float).T), axis=1)[:, :3]
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == {
        (i, j + 1): want[i, j] for i in range(400) for j in range(3)}
    hits = spark.createDataFrame([(q, i, float(i)) for q in range(3) for i in range(50)],
                                 "query_id long, id long, score double").coalesce(1)
    assert similarity.best_in_tasks(hits, 2, most=20).count() == 6


def test_scores_held_at_once_do_not_grow_with_the_other_side():
    assert all(similarity.chunk(n) * n <= max(n, ball_tree.SCORES) for n in (1, 8192, 131072, 10**7))
    assert similarity.chunk(0) == 512


def test_composed_queries_hand_on_their_depth_only(planted, monkeypatch):
    """Evidence that cannot be held: rows leave a task by query, block and depth, not by pair."""
    df, m = planted
    asked = df.select((F.col("id") + 1).alias("query_id"), F.lit(None).cast("array<float>").alias("text_vec"),
                      F.array(F.col("id")).alias("positive_ids"), F.array((F.col("id") + 70) % 2400).alias("negative_ids"))
    sent, past = [], composed._past_blocks
    monkeypatch.setattr(composed, "_past_blocks", lambda *a: sent.append(past(*a)) or sent[0])
    got = composed.composed_ranking(asked, df, depth=4, max_bytes=64, block_rows=100).collect()
    assert sent[0].count() <= 240 * 3 * 4
    want = composed.composed_ranking(asked, df, depth=4).collect()
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in got) == sorted(
        (r.query_id, r["rank"], r.id, round(r.score, 9)) for r in want) and len(got) == 960


@pytest.mark.parametrize("way", WAYS)
def test_items_without_a_finite_penalty_take_no_place(planted, way):
    df, m = planted
    off = np.where(np.arange(len(m)) % 5 == 0, np.nan, np.arange(len(m)) % 3 / 10)
    pen = df.withColumn("penalty", F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("id") / 10 % 3 / 10))
    got = similarity.knn(pen, df.withColumnRenamed("id", "query_id"), 5, penalty="penalty", **way).toPandas()
    s = np.round(m @ m.T, 12) - off[None, :]
    want = -np.sort(-s[:, np.isfinite(off)], axis=1)[:, :5]
    assert np.abs(got.sort_values(["query_id", "rank"]).score.to_numpy().reshape(-1, 5) - want).max() < 1e-9


@pytest.mark.parametrize("copies", [False, True])
def test_best_scores_few_pairs_in_double_precision(monkeypatch, copies):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 32))
    if copies:
        m = m[rng.integers(0, 40, len(m))]  # more ties than a row has room for
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).astype(float)
    ids, off, scored = rng.permutation(len(m)), rng.integers(0, 3, len(m)) / 8, []
    dots = similarity.pair_dots
    monkeypatch.setattr(similarity, "pair_dots", lambda q, c, r, at: scored.append(len(r)) or dots(q, c, r, at))
    monkeypatch.setattr(similarity, "_PIECE", 500)
    best = similarity.Best(ids[:200], m[:200], 6, True)
    for lo in (0, 1700):
        best.meet(ids[lo:lo + 1700], m[lo:lo + 1700], off[lo:lo + 1700])
    s = np.round(m[:200] @ m.T, 12) - off[None, :]
    s[np.arange(200), np.arange(200)] = -np.inf
    for i in range(200):
        order = np.lexsort((ids, -s[i]))[:6]
        assert best.ids[i].tolist() == ids[order].tolist()
        assert np.abs(best.scores[i] - s[i][order]).max() < 1e-9
    assert copies or sum(scored) < s.size / 50


def test_floor_asks_for_neighbours_once(planted, monkeypatch):
    df, _ = planted
    passed = df.sparkSession.sparkContext.accumulator(0)

    def counted(*args, **options):
        near = similarity.knn(*args, **options)

        def run(batches):
            for batch in batches:
                passed.add(len(batch))
                yield batch
        return near.mapInArrow(run, near.schema)
    monkeypatch.setattr(signals, "knn", counted)
    signals.similarity_floor(df).collect()
    assert passed.value == 240


def test_long_lists_of_many_queries_hold_the_corpus(planted, monkeypatch):
    df, _ = planted
    asked = df.withColumnRenamed("id", "query_id")
    sent = similarity._knn_held_queries
    monkeypatch.setattr(similarity, "_knn_held_queries", None)
    got = similarity.knn(df, asked, 60, max_bytes=1 << 17)  # lists of 230 kB
    monkeypatch.setattr(similarity, "_knn_held_queries", sent)
    want = similarity.knn(df, asked, 60)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 240 * 60


@pytest.mark.parametrize("dense", [1 << 30, 0])
def test_whole_tiles_and_single_leaves_give_the_same(spark, monkeypatch, dense):
    """Visitors that meet a tile at once see only the leaves they name, whatever the penalty."""
    draw = np.random.default_rng(11)
    m = draw.normal(size=(240, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[40:60] = m[40]
    penalty = draw.uniform(0, 0.5, 240)
    df = spark.createDataFrame([(i, v.tolist(), float(p)) for i, (v, p) in enumerate(zip(m, penalty, strict=True))],
                               "id long, embedding array<double>, penalty double")
    monkeypatch.setattr(ball_tree, "DENSE", dense)
    large = {"max_bytes": 64, "block_rows": 8}
    s = np.round(m @ m.T, 12)
    got = {(r.a_id, r.b_id) for r in similarity.pairs_above(df, 0.8, **large).collect()}
    assert got == {(i, j) for i in range(240) for j in range(i + 1, 240) if s[i, j] > 0.8}
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    a = s - penalty[None, :]
    rows = similarity.knn(df, asked, 3, exclude_self=True, penalty="penalty", **large).collect()
    want = {(i, rank + 1): j for i in range(240) for rank, j in enumerate(
        sorted((j for j in range(240) if j != i), key=lambda j: (-a[i, j], j))[:3])}
    assert {(r.query_id, r.rank): r.id for r in rows} == want
    own = asked.withColumn("own", F.lit(0.1))
    above = {r.query_id: r.rank0 for r in similarity.exact_ranks(df, own, "penalty", **large).collect()}
    assert above == {i: int((np.round(a[i], 12) > 0.1).sum()) for i in range(240)}


def test_a_tree_takes_few_levels_and_its_tiles_many_tasks(spark, monkeypatch):
    """Rows ever closer together split off a few at a time; one tile is dealt to all cores."""
    steps = np.repeat(np.arange(600), 1) * 1e-3
    m = np.stack([np.cos(np.exp(-steps * 12)), np.sin(np.exp(-steps * 12))], axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    levels, measure = [], ball_tree._measure
    monkeypatch.setattr(ball_tree, "_measure", lambda *a: levels.append(1) or measure(*a))
    homes, tree = ball_tree.build(df, 2)
    assert len(levels) <= 20
    monkeypatch.setattr(ball_tree, "LEAST_CROWD", 10)
    routed = ball_tree.routes(tree, df, lambda batch, least, most, angles, t: (np.ones(most.shape, bool), {})).cache()

    def kernel(visitors, table, hm):
        yield pa.record_batch({"task": np.full(1, TaskContext.get().partitionId())})

    assert ball_tree.visit(tree, homes, routed, kernel, "task long", 1000).distinct().count() > 1
