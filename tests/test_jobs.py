import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.corpus import SCHEMAS, Corpus
from siftwork.functions import images
from siftwork.functions.encoders import HashingEncoder, encode_table
from siftwork.operators import leakage, scenarios
from siftwork.operators.selection import Selection
from siftwork.plans import bindings as b
from siftwork.plans import search as sp
from siftwork.sources import builds, report, scan
from siftwork.streaming import activity, ingest


def png(path, pixels):
    """A grey PNG, written with the standard library."""
    h, w = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw))
                     + chunk(b"IEND", b""))


def test_images_measure_and_hash(spark, tmp_path):
    rng = np.random.default_rng(3)
    coarse = rng.integers(0, 255, (8, 9))
    big = np.kron(coarse, np.ones((12, 12)))
    png(tmp_path / "a.png", big)
    png(tmp_path / "half.png", np.kron(coarse, np.ones((6, 6))))
    png(tmp_path / "other.png", np.kron(rng.integers(0, 255, (8, 9)), np.ones((12, 12))))
    png(tmp_path / "flat.png", np.full((20, 20), 51))
    png(tmp_path / "tiny.png", np.full((2, 2), 9))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = {r.filename: r for r in images.image_measures(images.read_images(spark, str(tmp_path))).collect()}
    assert "broken.png" not in got and got["tiny.png"].blur is None
    assert got["flat.png"].blur == pytest.approx(0) and got["flat.png"].luma == pytest.approx(0.2, abs=0.01)
    g = big / 255.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    assert got["a.png"].blur == pytest.approx(lap.var(), rel=1e-6)
    df = spark.createDataFrame([(got["a.png"].dhash, got["half.png"].dhash, got["other.png"].dhash)],
                               "a long, b long, c long")
    near, far = df.select(leakage.hamming("a", "b"), leakage.hamming("a", "c")).first()
    assert near == 0 and far > leakage.DUPLICATE_FRAME_MAX


def test_masks(spark):
    m = np.zeros((4, 8), np.uint8)
    m[1:3, 2:6] = 255
    df = spark.createDataFrame(
        [(1, bytearray(m.tobytes()), 8, 4), (2, bytearray(32), 8, 4), (3, bytearray(m.tobytes()), 9, 4)],
        "annotation_id long, raster binary, width int, height int")
    got = images.mask_statistics(df).collect()
    assert [(r.annotation_id, r.x, r.y, r.w, r.h, r.area_fraction) for r in got] == [(1, .25, .25, .5, .5, .25)]


def test_encoder_contract_and_build(spark, tmp_path):
    df = spark.createDataFrame([(1, "a dog"), (2, "a cat"), (3, "a dog")], "id long, text string")
    v = encode_table(HashingEncoder, df, F.col("text")).cache()
    assert builds.contract_holds(v, 3)
    e = {r.id: r.embedding for r in v.collect()}
    assert e[1] == e[3] != e[2]
    root = str(tmp_path / "store")
    first = builds.commit(spark, root, {"vectors": v}, "hashing")
    bad = v.withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    with pytest.raises(ValueError):
        builds.commit(spark, root, {"vectors": bad}, "hashing")
    manifest = spark.read.parquet(root + "/manifest").collect()
    assert {r.version for r in manifest} == {first}
    assert builds.current_build(spark, root)["vectors"].count() == 3


def test_chain_of_builds(spark, tmp_path):
    root = str(tmp_path / "chain")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    assert builds.head(spark, root) is None and builds.current_build(spark, root) == {}
    mark, other = builds.corpus_mark(samples=v), builds.corpus_mark(samples=v.where("id = 1"))
    one = builds.commit(spark, root, {"vectors": v}, "one", corpus=mark)
    assert builds.current_build(spark, root, mark) and builds.current_build(spark, root, other) == {}
    two = builds.commit(spark, root, {"vectors": v.where("id = 1")}, "two", replaces=one, corpus=other)
    with pytest.raises(builds.Superseded):
        builds.commit(spark, root, {"vectors": v}, "rival", replaces=one, corpus=mark)
    with pytest.raises(builds.Superseded):
        builds.commit(spark, root, {"vectors": v}, "orphan", replaces="no such version")
    assert builds.head(spark, root) == two
    assert builds.current_build(spark, root, other)["vectors"].count() == 1
    assert builds.current_build(spark, root, mark) == {}


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS v")
    same = builds.fingerprint(df.orderBy(F.col("id").desc())).first()
    assert builds.fingerprint(df).first() == same
    assert builds.fingerprint(df.where("id > 0")).first() != same


def test_adapters_and_ingest(spark, tmp_path):
    raw = spark.createDataFrame(
        [("train", 5, "  one ", "", "x"), ("train", 2, "two", None, "y"), ("test", 9, "three", "four", "z")],
        "split string, src_order int, caption_0 string, Caption_1 string, other string")
    named = scan.name_rows(raw)
    assert {r.filename for r in named.collect()} == {"train_000000.jpg", "train_000001.jpg", "test_000000.jpg"}
    caps = {(r.filename, r.idx): r.text for r in scan.caption_rows(named).collect()}
    assert caps[("train_000001.jpg", 0)] == "one" and caps[("test_000000.jpg", 1)] == "four" and len(caps) == 4
    raw.write.json(str(tmp_path / "in"))
    assert scan.open_dataset(spark, "json", str(tmp_path / "in")).count() == 3
    with pytest.raises(ValueError):
        scan.open_dataset(spark, "nope", "x")
    have = spark.createDataFrame([("train_000000.jpg",)], "filename string")
    assert scan.new_rows(named, have).count() == 2 and scan.new_rows(named, have, 1).count() == 1
    answers = spark.createDataFrame([(1, '{"tags": [" Dog", "", "dog", "cat"]}'), (2, "junk")],
                                    "sample_id long, answer string")
    stored = spark.createDataFrame([(1, "cat")], "sample_id long, tag string")
    assert [(r.sample_id, r.tag) for r in scan.parsed_tags(answers, stored).collect()] == [(1, "dog")]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    drops, target, ck = (str(tmp_path / n) for n in ("drops", "target", "ck"))
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "filename string")
    for batch in (rows, rows.union(spark.createDataFrame([("c",)], "filename string"))):
        batch.write.mode("append").parquet(drops)
        q = ingest.ingest_stream(ingest.read_drops(spark, drops, rows.schema), target, ck)
        q.awaitTermination()
    got = sorted(r.filename for r in spark.read.parquet(target).collect())
    assert got == ["a", "b", "c"]


def test_streamed_windows_equal_the_batch(spark, sf, tmp_path):
    events = b.table(spark, sf, "events").select("ts", F.col("event_type").alias("kind"))
    src = str(tmp_path / "events")
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = activity.write_windows(activity.activity_windows(stream, "6 hours", "1 hour"),
                               str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r.window_start, r.kind): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.kind): r.n for r in activity.activity_windows(events, "6 hours").collect()}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    last = max(k[0] for k in want)
    assert all(k in got for k in want if k[0] < last)  # only the open window is held back


# ------------------------------------------------------------------------- scenarios

def scene_corpus(spark):
    rng = np.random.default_rng(0)
    vecs, caps, att = [], [], []
    words = {0: "alone", 1: "people", 2: "water"}
    for s in range(3):
        for i in range(10):
            n = s * 10 + i
            v = rng.normal(scale=0.02, size=4)
            v[s] += 1
            vecs.append((n, (v / np.linalg.norm(v)).tolist()))
            caps.append((n, n, 0, f"dog {words[s]}" + (" leash" if s == 0 and i < 3 else ""), None))
            att.append((n, "setting", "outdoor", 1.0))
    return (spark.createDataFrame(vecs, "id long, embedding array<float>"),
            spark.createDataFrame(caps, SCHEMAS["captions"]),
            spark.createDataFrame(att, SCHEMAS["attributes"]),
            spark.createDataFrame([], SCHEMAS["vlm_tags"]))


def test_scenarios_name_what_sets_groups_apart(spark):
    v, caps, att, vlm = scene_corpus(spark)
    ranking = v.select(F.lit(1).cast("long").alias("query_id"), "id",
                       (F.col("id") + 1).cast("int").alias("rank"))
    got = scenarios.scenarios(ranking, v, att, vlm, caps).orderBy("first_id").collect()
    assert [r.label for r in got] == [f"{w} (10)" for w in ("alone", "people", "water")]
    assert got[0].evidence == "caption:alone: 10 of 10 (100%), 33% of all results"
    assert sorted(i for r in got for i in r.members) == list(range(30))
    again = scenarios.scenarios(ranking, v, att, vlm, caps).orderBy("first_id").collect()
    assert got == again
    few = scenarios.scenarios(ranking.where("rank < 8"), v, att, vlm, caps).collect()
    assert [(r.grp, r.label, r.size) for r in few] == [(None, "too few results (7)", 7)]


def test_scenario_leads_are_not_shared(spark):
    v, caps, att, vlm = scene_corpus(spark)
    shared = caps.withColumn("text", F.when(F.col("id") < 20, F.concat("text", F.lit(" street"))).otherwise("dog"))
    ranking = v.select(F.lit(1).cast("long").alias("query_id"), "id", (F.col("id") + 1).cast("int").alias("rank"))
    got = {r.first_id: r for r in scenarios.scenarios(ranking, v, att, vlm, shared).collect()}
    assert got[0].label == "alone, street (10)" and got[10].label == "people, street (10)"
    assert got[20].label == "mixed (10)" and got[20].evidence.startswith("no trait reaches 50%")
    only = shared.withColumn("text", F.when(F.col("id") < 20, F.lit("street dog")).otherwise("dog"))
    got = {r.first_id: r for r in scenarios.scenarios(ranking, v, att, vlm, only).collect()}
    assert got[0].label == "street (10)" and got[10].label == "mixed (10)"
    assert got[10].evidence.startswith("all its traits lead other groups")


# ---------------------------------------------------------------------- search, report

def test_search_modes_and_degradation(spark):
    v, caps, att, vlm = scene_corpus(spark)
    samples = v.select("id", F.concat(F.lit("f"), "id").alias("filename"), F.when(
        F.col("id") < 10, "test").otherwise("train").alias("split"))
    for col in ("legibility", "rarity", "difficulty", "clutter"):
        samples = samples.withColumn(col, F.lit(None).cast("int"))
    c = Corpus(samples=samples, captions=caps, attributes=att, vectors=v, caption_vectors=v)
    q = v.where("id = 0").select(F.lit(1).cast("long").alias("query_id"), F.lit("water").alias("text"), "embedding")
    hybrid = sp.search(c, q, "hybrid", stem=True).orderBy("rank").collect()
    assert {r.score_basis for r in hybrid} == {"rrf"} and len(hybrid) == 30
    assert any(len(r.paths) == 2 for r in hybrid) and hybrid[0].match_caption
    train = sp.search(c, q, "semantic", Selection(split="train"), stem=True).collect()
    assert len(train) == 20 and {r.score_basis for r in train} == {"cosine"}
    none = sp.search(c.with_tables(vectors=None), q, "hybrid").collect()
    assert {r.mode_used for r in none} == {"keyword"} and none[0].message.startswith("Semantic search")
    assert all(r.score is None for r in none) and len(none) == 10


def test_report_states_its_sources(spark, sf, tmp_path):
    c = b.docs(spark, sf, axes=True)
    sections = report.dataset_sections(c)
    report.write_report(spark, str(tmp_path / "r"), "Audit", sections)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "markdown")).collect())
    assert text.count("*Source:") == sum(len(s.blocks) for s in sections) and "## Contents" in text
    with pytest.raises(ValueError):
        report.distribution(c, "no such thing")
    assert report.distribution(c, "Splits").count() == 3
