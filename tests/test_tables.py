import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.corpus import SCHEMAS, Corpus
from siftwork.functions import geometry as geo
from siftwork.operators import aggregates as ag
from siftwork.operators import albums, axes, curation, describe, details, listing, order_stats
from siftwork.operators import selection as sel
from siftwork.operators.selection import Selection


def rows(spark, name, data):
    """Rows given as dicts, absent columns NULL."""
    names = SCHEMAS[name].fieldNames()
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], SCHEMAS[name])


@pytest.fixture(scope="module")
def smoke(spark):
    scores = [(1, 8, 2, 3), (5, 5, 5, 5), (9, 1, 9, 7)]
    samples = [dict(id=i, filename=f"{s}_{i}.jpg", split=s, cluster=i, x=i / 10, y=0.5, legibility=a[0],
                    rarity=a[1], difficulty=a[2], clutter=a[3], caption_consistency=0.1 * i)
               for i, s, a in zip((1, 2, 3), ("train", "train", "test"), scores)]
    samples.append(dict(id=4, filename="new_4.jpg", split="test"))
    return Corpus(
        samples=rows(spark, "samples", samples),
        captions=rows(spark, "captions", [
            dict(id=1, sample_id=1, idx=0, text="a dog", agreement=0.1),
            dict(id=2, sample_id=1, idx=1, text="two dogs", agreement=0.3),
            dict(id=3, sample_id=2, idx=1, text="later", agreement=None),
            dict(id=4, sample_id=2, idx=0, text="a cat", agreement=0.2)]),
        attributes=rows(spark, "attributes", [
            dict(sample_id=1, grp="setting", label="indoor", confidence=0.9),
            dict(sample_id=1, grp="time", label="night", confidence=0.8),
            dict(sample_id=2, grp="setting", label="indoor", confidence=0.7)]),
        sample_tags=rows(spark, "sample_tags", [dict(sample_id=1, tag="t"), dict(sample_id=3, tag="t")]))


def chosen(smoke, **kw):
    return sorted(r.id for r in Selection(**kw).apply(smoke).collect())


def test_selection_vocabulary(smoke):
    assert chosen(smoke, split="train") == [1, 2]
    assert chosen(smoke, tag="t") == [1, 3]
    assert chosen(smoke, attrs=("setting:indoor",)) == [1, 2]
    assert chosen(smoke, attrs=("setting:indoor", "time:night")) == [1]
    assert chosen(smoke, attrs=("time:night", "setting:indoor", "nonsense")) == [1]
    assert chosen(smoke, axes={"difficulty": (5, None)}) == [2, 3]  # unscored fails
    assert chosen(smoke, axes={"password": (5, None)}) == [1, 2, 3, 4]
    assert chosen(smoke, album=99) == []
    assert chosen(smoke, max_agreement=0.15) == [1]
    assert chosen(smoke, cluster=2, split="train") == [2]
    assert chosen(smoke, box=(0.1, 0.0, 0.2, 1.0)) == [1, 2]


def test_empty_selection_is_not_the_empty_set(smoke):
    assert Selection().selected_ids(smoke) is None
    assert Selection(tag="nobody").selected_ids(smoke).count() == 0


def test_id_lists(spark, smoke):
    assert chosen(smoke, ids=("2", "test_3.jpg", "77", "٣")) == [2, 3]
    assert chosen(smoke, ids=("2", "3"), split="test") == [3]
    many = spark.range(0, 20_000).select(F.col("id").cast("string").alias("entry"))
    assert chosen(smoke, ids=many) == [1, 2, 3, 4]
    assert sel.ids_resolved(smoke.samples, ("1", "1", "nope")).first().ids_resolved == 1
    assert [r.entry for r in sel.id_entries(spark, "b, a\nb").orderBy("pos").collect()] == ["b", "a"]


def test_unscored_sorts_last_both_ways(smoke):
    for sort, want in (("difficulty_asc", [1, 2, 3, 4]), ("difficulty_desc", [3, 2, 1, 4]), ("bogus", [1, 2, 3, 4])):
        assert [r.id for r in smoke.samples.orderBy(*listing.axis_order(sort)).collect()] == want
    first = listing.page(smoke.samples, 1, 2, "difficulty_desc").collect()
    last = first[-1]
    after = listing.page_after(smoke.samples, "difficulty", True, last.difficulty, last.id, 2).collect()
    assert [r.id for r in first + after] == [3, 2, 1, 4] and first[0].total == 4


def test_siblings_and_suspects(smoke):
    got = {r.id: r.sibling_mean for r in details.sibling_means(smoke.captions).collect()}
    assert got[1] == pytest.approx(0.3) and got[4] is None and got[3] == pytest.approx(0.2)
    assert [r.id for r in listing.suspect_captions(smoke, 2).orderBy("agreement").collect()] == [1, 4]


def test_records_export_and_reimport(spark, smoke, tmp_path):
    from siftwork.sources import builds, export

    got = {r.id: r for r in details.records(smoke).collect()}
    assert got[1].captions == ["a dog", "two dogs"] and got[1].tags == ["t"]
    assert got[2].captions == ["a cat", "later"] and got[4].captions == [] and got[4].axes == {}
    assert got[1].axes["rarity"] == 8 and got[1].attributes["time"] == "night"
    many = spark.range(1500).selectExpr("7 AS sample_id", "cast(id * 900 AS int) AS idx", "concat('c', id) AS text")
    whole = details.caption_lists(many).collect()
    assert len(whole) == 1 and whole[0].captions == [f"c{i}" for i in range(1500)]
    line = export.manifest(spark, "split=train", "m", smoke.samples.agg(F.count("id")).scalar(),
                           builds.fingerprint(smoke.samples.select("id")).select("fingerprint").scalar(),
                           F.lit(2))
    picked = details.records(smoke, Selection(split="train").apply(smoke))
    for fmt in ("csv", "json", "jsonl"):
        export.write_export(picked, line, str(tmp_path / fmt), fmt)
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv" / "data"))
    assert csv.columns[:5] == ["id", "filename", "split", "captions", "tags"] and csv.count() == 2
    again = Selection(ids=csv.select(F.col("id").alias("entry"))).apply(smoke)
    assert sorted(r.id for r in again.collect()) == [1, 2]
    lines = [json.loads(r.value) for r in export.jsonl_lines(picked, line).collect()]
    assert lines[0]["_manifest"]["query"] == "split=train" and lines[0]["count"] == 2 and len(lines) == 3


def test_map_points(smoke):
    got = {r.id: r for r in sel.map_points(smoke).collect()}
    assert set(got) == {1, 2, 3} and got[1].agreement == pytest.approx(0.2) and got[3].agreement is None


def test_label_paths_and_annotations(spark):
    tree = rows(spark, "object_labels", [
        dict(id=1, name="animal"), dict(id=2, name="dog", parent_id=1), dict(id=3, name="pug", parent_id=2)])
    got = {r.id: r.path for r in details.label_paths(spark, tree).collect()}
    assert got == {1: ["animal"], 2: ["animal", "dog"], 3: ["animal", "dog", "pug"]}
    marks = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(8)], "id long, sample_id long")
    page = details.annotation_page(marks, size=2).collect()
    assert {(r.id, r.total, r.next_offset) for r in page} == {(0, 5, 2), (1, 5, 2), (5, 3, 2), (6, 3, 2)}


# -------------------------------------------------------------------- order statistics

@pytest.mark.parametrize("n", [1, 2, 11, 333])
def test_percentile_buckets_match_min_rank(spark, n, monkeypatch):
    monkeypatch.setattr(order_stats, "_BRACKET_ROWS", 4)  # force several rounds
    rng = np.random.default_rng(n)
    cols = {"tied": rng.integers(0, 4, n).astype(float), "spread": rng.normal(size=n),
            "it's hot": np.where(rng.random(n) < 0.4, 0.5, rng.random(n))}
    df = spark.createDataFrame([(m, i, float(v)) for m, vs in cols.items() for i, v in enumerate(vs)]
                               + [("tied", -1, None)], "metric string, i int, value double")
    got = {(r.metric, r.i): r.bucket for r in order_stats.percentile_buckets(df).collect()}
    assert got[("tied", -1)] is None
    for m, vs in cols.items():
        ranks = np.searchsorted(np.sort(vs), vs, side="left") / max(1, n - 1)
        assert [got[(m, i)] for i in range(n)] == np.clip(np.round(ranks * 10), 0, 10).astype(int).tolist()
    q = {r.metric: r.q_value for r in order_stats.interpolated_quantile(df, 0.1).collect()}
    assert all(q[m] == pytest.approx(np.percentile(v, 10)) for m, v in cols.items())


def test_positions_agree_on_both_paths(spark):
    df = spark.createDataFrame([(g, (i * 37) % 101, i) for g in "ab" for i in range(60)],
                               "g string, p int, id int")
    plain = {(r.g, r.id): r.position for r in order_stats.positions(df, ["g"], ["p", "id"]).collect()}
    split = {(r.g, r.id): r.position
             for r in order_stats.positions(df, ["g"], ["p", "id"], hot_rows=10).collect()}
    assert plain == split and sorted(v for (g, _), v in plain.items() if g == "a") == list(range(60))


def test_axes_explain_their_hard_tail(spark):
    data = [(i, float(i), float(10 - i), None if i else 1.0) for i in range(11)]
    df = spark.createDataFrame(data, "id long, blur double, luma double, agreement double")
    got = {(r.id, r.axis): r for r in axes.score_axes(df).collect()}
    assert got[(0, "legibility")].why == "blurred" and got[(10, "legibility")].why == "dark"
    assert (1, "difficulty") not in got and got[(0, "difficulty")].score == 0
    wide = axes.axes_wide(axes.score_axes(df)).where("id = 1").first()
    assert wide.difficulty is None and wide.legibility is not None


# ------------------------------------------------------------------ aggregates, describe

def test_histogram_keeps_empty_bins_and_folds_the_top(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 1.0, None)], "agreement double")
    h = {r.bin: r.n for r in ag.agreement_histogram(df).collect()}
    assert len(h) == 40 and h[0] == 1 and h[39] == 1 and sum(h.values()) == 3
    same = spark.createDataFrame([(0.5,)] * 3, "agreement double")
    assert ag.agreement_histogram(same).where("bin = 0").first().n == 3
    assert ag.review_threshold(ag.agreement_histogram(df)).first().threshold == pytest.approx(1 / 40)
    assert ag.agreement_histogram(df.where("agreement > 5")).count() == 0


def test_capped_points_sum_the_tail(spark):
    pts = spark.createDataFrame([(f"l{i:02}", 30 - i) for i in range(30)], "label string, value long")
    got = {r.label: r.value for r in ag.capped(pts, 10).collect()}
    assert len(got) == 10 and got["other (21 levels)"] == sum(range(1, 22))
    assert ag.capped(pts.limit(5), 10).count() == 5


def test_describe_facets_and_drill(spark):
    n = 300
    night = [i < 60 for i in range(n)]
    indoor = [i < 50 or 60 <= i < 90 for i in range(n)]
    samples = rows(spark, "samples", [dict(id=i, split="train") for i in range(n)])
    att = rows(spark, "attributes", [
        d for i in range(n) for d in (
            dict(sample_id=i, grp="time", label="night" if night[i] else "day"),
            dict(sample_id=i, grp="setting", label="indoor" if indoor[i] else "outdoor"))])
    c = Corpus(samples=samples, attributes=att)
    lifts = describe.facet_lift(c, Selection(attrs=("time:night",)))
    over = describe.facet_report(lifts).where("side = 'over'").first()
    assert (over.group, over.label, over["count"], over.lift) == ("setting", "indoor", 50, 3.12)
    drilled = Selection(attrs=("time:night", over.drill.removeprefix("attr="))).apply(c).count()
    assert drilled == over["count"]
    assert {r.grp for r in lifts.collect()} == {"setting"}
    guard = describe.describe_guard(c, Selection()).first()
    assert guard.message.startswith("This is the whole dataset") and guard.set_size == n


def test_album_signals(spark):
    items = spark.createDataFrame([(1, i, i) for i in range(6)], "album_id long, sample_id long, position long")
    att = spark.createDataFrame(
        [(i, "setting", "outdoor" if i < 5 else "indoor", 1.0) for i in range(6)]
        + [(i, "time", "day" if i < 3 else "night", 1.0) for i in range(6)], SCHEMAS["attributes"])
    tags = spark.createDataFrame([(i, "wet") for i in range(3)], "sample_id long, tag string")
    got = {(r.kind, r.label): round(r.share, 2) for r in albums.common_signals(items, att, tags).collect()}
    assert got == {("attribute", "outdoor"): 0.83, ("tag", "wet"): 0.5}
    diff = albums.different_signals(items, att).collect()
    assert [(d.grp, d.first_label, d.second_label) for d in diff] == [("time", "day", "night")]
    vecs = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(6)],
                                 "id long, embedding array<float>")
    assert albums.outliers(items, vecs).orderBy("pos").first().id == 5
    assert albums.coherence(items, vecs).first().coherence == pytest.approx(10 / 15)


# -------------------------------------------------------------------------- curation

def test_album_edits(spark):
    items = spark.createDataFrame([(1, 10, 0), (1, 11, 3), (1, 12, 5)],
                                  "album_id long, sample_id long, position long")
    samples = spark.createDataFrame([(i,) for i in range(10, 15)], "id long")
    want = spark.createDataFrame([(1, 12, 0), (1, 13, 1), (1, 99, 2), (2, 14, 0)],
                                 "album_id long, sample_id long, i long")
    got = {(r.album_id, r.sample_id): r.position for r in curation.items_to_add(items, samples, want).collect()}
    assert got == {(1, 13): 7, (2, 14): 0}
    assert {r.sample_id: r.position for r in curation.compact(items).collect()} == {10: 0, 11: 1, 12: 2}
    given = spark.createDataFrame([(1, 12, 0), (1, 12, 1), (1, 77, 2)], "album_id long, sample_id long, i long")
    kinds = {r.kind: r.ids for r in curation.order_problems(items, given).collect()}
    assert kinds == {"duplicate": [12], "missing": [10, 11], "unknown": [77]}
    assert curation.reorder(items, given).where("position = 3").first().sample_id == 11
    good = spark.createDataFrame([(1, 12, 0), (1, 10, 1), (1, 11, 2)], "album_id long, sample_id long, i long")
    assert {r.sample_id: r.position for r in curation.reorder(items, good).collect()} == {12: 0, 10: 1, 11: 2}
    covers = spark.createDataFrame([(1, 11)], "id long, cover_sample_id long")
    kept, left = curation.remove_items(covers, items, items.where("sample_id = 11"))
    assert kept.first().cover_sample_id is None
    assert {r.sample_id: r.position for r in left.collect()} == {10: 0, 12: 1}


def test_verdicts_views_and_activity(spark):
    calls = spark.createDataFrame(
        [(1, "verdict:ok", 1), (1, "verdict:duplicate", 2), (1, "other", 3)], "sample_id long, tag string, ts int")
    assert curation.latest_verdicts(calls).first().tag == "verdict:duplicate"
    views = spark.createDataFrame([("a=1&_embed_model=m&_corpus=3:x",), ("a=1&_corpus=2:y",), ("a=1",)], "query string")
    now = spark.createDataFrame([("m", "3:x")], "embed_model string, corpus string")
    got = curation.stale_views(views, now).collect()
    assert [r.stale for r in got] == [False, True, False] and {r.query for r in got} == {"a=1"}
    ev = spark.createDataFrame(
        [(1, "tag_approval", '{"a":1}'), (2, "album_create", "{}"), (3, "tag_approval", "not json"),
         (4, "tag_approval", '"' + "x" * 4000 + '"')], "id long, kind string, payload string")
    assert [r.id for r in curation.valid_activity(ev).collect()] == [1]
    shown = {r.id: r.payload for r in listing.newest_activity(ev).collect()}
    assert shown[3] == "{}" and shown[1] == '{"a":1}' and shown[4].startswith('{"value":')


def test_geometry(spark):
    g = "kind string, geometry struct<x: double, y: double, w: double, h: double, points: array<array<double>>>"
    tri = [[0.0, 0.0], [1.0, 0.0], [0.5, 1.0]]
    data = [("rect", (0.1, 0.1, 0.2, 0.2, None)), ("rect", (0.9, 0.1, 0.2, 0.2, None)),
            ("rect", (0.1, float("nan"), 0.2, 0.2, None)), ("rect", (0.1, 0.1, 0.0, 0.2, None)),
            ("polygon", (None,) * 4 + (tri,)), ("polygon", (None,) * 4 + (tri[:2],)),
            ("polygon", (None,) * 4 + ([[2.0, 0.0]] * 3,)), ("blob", (0.1, 0.1, 0.2, 0.2, None))]
    df = spark.createDataFrame(data, g)
    good, bad = geo.split_valid(df)
    assert good.count() == 2 and bad.count() == 6
    boxes = spark.createDataFrame(
        [(1, -5.0, 0.0, 50.0, 20.0, "dog", 0.5), (1, 0.0, 0.0, float("inf"), 9.0, "x", 0.9),
         (1, 120.0, 0.0, 130.0, 5.0, "out", 0.8)],
        "sample_id long, x0 double, y0 double, x1 double, y1 double, label string, score double")
    got = geo.clean_detections(boxes.withColumn("width", F.lit(100)).withColumn("height", F.lit(40))).collect()
    assert [(r.label, r.x, r.w, r.h) for r in got] == [("dog", 0.0, 0.5, 0.5)]


def test_label_resolution(spark):
    known = rows(spark, "object_labels", [dict(id=1, name="Animal"), dict(id=2, name="dog", parent_id=1)])
    asked = spark.createDataFrame(
        [("A dog", "animal"), ("dog", "vehicle"), ("cat", "animal"), ("dog", None), ("x", "x")],
        "label_name string, parent_name string")
    got = curation.resolve_labels(known, asked)
    assert {r.id for r in got["resolved"].collect()} == {2}
    assert {(r.name, r.parent) for r in got["conflicts"].collect()} == {("dog", "vehicle"), ("x", "x")}
    assert [(r.name, r.parent) for r in got["new"].collect()] == [("cat", "animal")]


def test_label_paths_end_at_cycles_and_lost_parents(spark):
    rows = [(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "lost", 99), (5, "x", 6), (6, "y", 5), (7, "z", 6), (8, "own", 8)]
    rows += [(100 + i, f"n{i}", 100 + i - 1 if i else 3) for i in range(40)]
    labels = spark.createDataFrame(rows, "id long, name string, parent_id long")
    got = {r.id: r.path for r in details.label_paths(spark, labels).collect()}
    assert got[3] == ["a", "b", "c"] and got[4] == ["lost"] and len(got[139]) == 43
    assert [got[i] for i in (5, 6, 7, 8)] == [None] * 4


def test_refused_events_keep_their_reason(spark):
    from siftwork.operators import curation
    rows = [("search_snapshot", "{}"), ("other", "{}"), ("image_search", "no"), ("image_search", '"' + "x" * 50 + '"')]
    got = curation.judged_activity(spark.createDataFrame(rows, "kind string, payload string"), longest=20).collect()
    assert [r.refused is None for r in got] == [True, False, False, False]
