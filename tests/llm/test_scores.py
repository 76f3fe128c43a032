"""Language model, classifier, licences, URLs, fingerprints, pipeline."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import language_model, licenses, minhash, quality, url_filters
from siftwork.llm.queries import LISTED_HOSTS, ORACLES, QUERIES, RULES
from .conftest import ODD, prose
from .test_pairs import contamination_by_brute_force, near_copies_by_brute_force, removed_by_brute_force


def model_by_brute_force(rows):
    """(base, score) of each row, from plain counters."""
    one, two, three = (collections.Counter() for _ in range(3))
    walks = []
    for i, text in rows:
        words = [*(text or "").encode().lower().split(), "end"]
        held = zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
        v = ["begin", *words]
        walks.append((v, held))
        if not held:
            one.update(words)
            two.update(zip(v, v[1:], strict=False))
            three.update(zip(v, v[1:], v[2:], strict=False))
    total, kinds = sum(one.values()), len(one)
    k2, k3 = language_model.STRENGTH
    for v, held in walks:
        base = score = known = 0
        for j in range(1, len(v)):
            p = (one[v[j]] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p)
            known += one[v[j]] > 0
            if seen := one["end"] if v[j - 1] == "begin" else one[v[j - 1]]:
                p = (two[v[j - 1], v[j]] + k2 * p) / (seen + k2)
            if j > 1 and (seen := two[v[j - 2], v[j - 1]]):
                p = (three[v[j - 2], v[j - 1], v[j]] + k3 * p) / (seen + k3)
            score += math.log10(p)
        yield held, len(v) - 1, known, total, base, score


def test_model_equals_brute_force(docs_of, rng):
    texts = ODD + [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    ids = [None, *range(1, len(texts) - 1), 3]
    docs = docs_of(texts, ids=ids)
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6),
                  round(r.score, 6)) for r in language_model.lm_scores(docs).collect())
    want = sorted((i or 0, n, held, known, total, round(b, 6), round(s, 6)) for i, (held, n, known, total, b, s) in
                  zip(ids, model_by_brute_force(list(zip(ids, texts, strict=True))), strict=True))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(x - y) < 1e-5 * max(1, abs(y)) for g, w in zip(got, want, strict=True)
               for x, y in zip(g[5:], w[5:], strict=True))
    assert language_model.lm_scores(docs_of([])).count() == 0


def test_states_carried_over_pieces(rng, monkeypatch):
    """A walk in pieces, the shortest ones included, is the walk from the beginning."""
    texts = [prose(rng, n, ["red", "blue", "fish", "bird", "tree"]) for n in (0, 1, 2, 3, 5, 40, 400)]
    walk = language_model.Walk(texts)
    counts = walk.counts(np.arange(len(texts)) % 3 > 0)
    model = language_model.Automaton(walk, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (500.0, 4.0))
    at = walk.at[0]
    for first, n in zip(walk.begins, walk.lengths, strict=True):  # one state, one token at a time
        state, want = model.begin, []
        for token in at[first:first + n]:
            log, arc = 0.0, dict(zip(model.arcs.tolist(), range(len(model.arcs)), strict=True))
            while (found := arc.get(state * model.words + token)) is None:
                log, state = log + model.fail_weight[state], model.fail_to[state]
            log, state = log + model.weight[found], model.to[found]
            want.append(log)
        for piece in (1, 2, 7, 1000):
            monkeypatch.setattr(language_model, "PIECE", piece)
            got = model.traverse(at, walk.begins, walk.lengths)[first:first + n]
            assert np.allclose(got, want, rtol=0, atol=1e-12)
    # the weights of a state's arcs, and its failure arc times the rest, sum to one
    vocabulary = 10.0 ** np.append(model.root, np.log10(0.1 / (counts[0].sum() + 0.1 * ((counts[0] > 0).sum() + 1))))
    known = counts[0] > 0
    assert abs(vocabulary[:-1][known].sum() + vocabulary[-1] - 1) < 1e-12


def test_model_beats_its_root_and_is_normalised(docs_of, rng):
    texts = [prose(rng, 12, ["red fish", "blue bird", "old tree"]) for _ in range(200)]
    held = [r for r in language_model.lm_scores(docs_of(texts)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)
    vocabulary = ["red", "fish", "blue", "bird", "old", "tree"]
    docs = docs_of([*texts, *(f"red {w}" for w in vocabulary), "red", "red"], ids=[
        *range(len(texts)), *[zeros for zeros in range(10_000, 90_000) if zlib.crc32(str(zeros).encode()) % 10 == 0][:8]])
    rows = {r.doc_id: r for r in language_model.lm_scores(docs).collect() if r.doc_id >= 10_000}
    assert len({r.train_tokens for r in rows.values()}) == 1


@pytest.fixture
def labelled(spark, docs_of, rng):
    texts, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randrange(20, 60), [f"w{k}" for k in range(200)])
        low, toxic = i % 7 == 0, i % 5 == 0
        if toxic:
            text += " " + " ".join(rng.choice(["grubfoo", "grubbar", "nasty"]) for _ in range(3))
        if low:
            text = " ".join(w + "!!" for w in text.upper().split())
        texts.append(text)
        labels.append((i, 0 if low else 1, int(toxic)))
    return (docs_of(texts + ODD, ids=[*range(300), None, *range(301, 300 + len(ODD))]),
            spark.createDataFrame([*labels, (5, 0, 0), (None, 1, 1), (6, None, None), (9999, 1, 0)],
                                  "doc_id long, quality int, toxic int"))


def test_classifier_on_held_out_rows(labelled):
    docs, labels = labelled
    some = labels.where("doc_id % 2 = 0 or doc_id is null")
    rows = [r for r in quality.classify(docs, some).collect() if r.doc_id is not None and r.doc_id < 300]
    held = [r for r in rows if r.doc_id % 2]
    right = sum((not r.keep) == (r.doc_id % 7 == 0 or r.doc_id % 5 == 0) for r in held)
    assert len(rows) == 300 and right / len(held) > 0.95
    assert all(0 <= r.site_low <= 1 and 0 <= r.p_toxic <= 1 for r in rows)


def posteriors_by_brute_force(rows, label_of):
    """(site rate, posterior) of each (doc_id, host, path, evidence), one head."""
    def strength(sites, prior_of):
        n = sum(m for m, _ in sites.values())
        chance = [(prior_of(k) * (1 - prior_of(k)), m, (bad / m - prior_of(k)) ** 2) for k, (m, bad) in sites.items()]
        between = (sum(m * d for _, m, d in chance) - sum(c for c, _, _ in chance)) / n
        within = sum(m * c for c, m, _ in chance) / n
        return min(1e6, max(1.0, within / between if between > 0 else 1e6))

    def odds(p):
        p = min(1 - 1e-9, max(1e-9, p))
        return math.log(p / (1 - p))

    paths, hosts = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for i, host, path, e in rows:
        bad = label_of.get(i, e)
        for site in (paths[host, path], hosts[host]):
            site[0] += 1
            site[1] += bad
    overall = min(1 - 1e-6, max(1e-6, sum(b for _, b in hosts.values()) / len(rows)))
    k = strength(hosts, lambda _: overall)
    prior = {h: (b + k * overall) / (n + k) for h, (n, b) in hosts.items()}
    k = strength(paths, lambda site: prior[site[0]])
    for _, host, path, e in rows:
        n, bad = paths[host, path]
        site = (bad + k * prior[host]) / (n + k)
        yield site, 1 / (1 + math.exp(-(odds(e) + odds(site) - odds(overall))))


def test_posteriors_equal_brute_force(labelled):
    docs, labels = labelled
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    docs = docs.withColumn("host", F.concat(F.lit("h"), F.when(number % 7 == 0, number % 3).otherwise(number % 5))).withColumn(
        "path", F.when(number % 11 > 0, F.concat(F.lit("p"), number % 4)))
    some = labels.where("doc_id % 3 = 0 or doc_id is null")
    got = quality.classify(docs, some, "host", "path").collect()
    assert len(got) == docs.count() and {r.host for r in got} == {f"h{i}" for i in range(5)} and "" in {r.path for r in got}
    given = collections.defaultdict(lambda: [0.0, 0.0])
    for r in some.where("doc_id is not null").collect():
        old = given[r.doc_id]
        given[r.doc_id] = [max(old[0], float(r.quality == 0)), max(old[1], float(r.toxic == 1))]
    for head, i in (("low", 0), ("toxic", 1)):
        want = posteriors_by_brute_force([(r.doc_id, r.host, r.path, r["evidence_" + head]) for r in got],
                                         {d: v[i] for d, v in given.items()})
        for r, (site, p) in zip(got, want, strict=True):
            assert abs(r["site_" + head] - site) < 1e-9 and abs(r["p_" + head] - p) < 1e-9
    assert all(r.keep == (r.p_low < 0.5 and r.p_toxic < 0.5) for r in got)


def test_head_is_at_its_optimum(rng):
    x = np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(400)])
    y = np.array([float(rng.random() < 1 / (1 + math.exp(-(r[0] - 2 * r[1] + 0.5)))) for r in x])
    head = quality.Head(x, y)
    z = head._scaled(x)
    slope = z.T @ (y - head(x)) - np.array([1.0] * 4 + [1e-3]) * head.weights
    assert np.abs(slope).max() < 1e-4 and quality.Head(x, y * 0)(x).max() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "p", 0.9, None)] * 400 + [("other", "p", 0.1, None)] * 400 + [("tiny", "p", 1.0, None)]
    scored = spark.createDataFrame(rows, "host string, path string, low double, label_low double")
    rate = {r.host: r.site_low for r in quality.site_posteriors(scored, "low").collect()}
    assert abs(rate["big"] - 0.9) < 0.02 and abs(rate["other"] - 0.1) < 0.02
    assert 0.5 < rate["tiny"] < 0.95


def test_classifier_without_labels_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.classify(docs_of(ODD), none).collect())
    assert quality.classify(docs_of([]), none).count() == 0
    kept = quality.keep_good(docs_of(ODD), none)
    assert kept.columns == docs_of(ODD).columns and kept.count() == len(ODD)


def test_licences_by_digest(spark, docs_of):
    mit = licenses.TEXTS["MIT"]
    texts = ODD + [
        f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}", mit.upper().replace(" ", "\n  "), mit + " and more",
        f"(c) 1999 X\nAll rights reserved.\n{licenses.TEXTS['ISC']}",
        "text\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0.", "Licensed under unknown terms."]
    rows = {r.doc_id: r for r in licenses.scan(
        docs_of(texts), licenses.built_in(spark, licenses.known_texts()),
        licenses.built_in(spark, licenses.known_notices())).collect()}
    n = len(ODD)
    assert [rows[n + k].license for k in range(6)] == ["MIT", "MIT", None, "ISC", None, None]
    assert rows[n + 4].notices == "CC-BY-NC-4.0,MIT" and rows[n + 5].notices is None
    assert rows[0].digest == rows[1].digest == hashlib.sha256(b"").hexdigest() and rows[0].license is None
    none = licenses.built_in(spark, [])
    assert licenses.scan(docs_of([]), none, none).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?utm_source=a&q=1#f", "https://a.example.net/en",
        "https://a.example.net/en/", "http://b.org/fr/y", "http://b.org", "http://casino.win.example.com/de/z",
        "http://casino.example.org/a/", "http://www.casino.example.org/a?ref=x", "http://casino.example.org/b",
        "http://example.com/de", "x://y/z://w", "http://É.org/fr/"]


def test_urls_are_judged(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    listed = pages.where(F.col("page_id") == 10).select(url_filters.canonical_url(F.col("url")).alias("canonical"))
    rows = {r.page_id: r for r in url_filters.filter_urls(pages, listed, RULES).collect()}
    assert [(rows[i].rule, rows[i].verdict) for i in range(len(URLS))] == [
        (None, "allow")] * 4 + [("example.net/en/", "allow"), ("net/", "block"), ("example.net/en/", "allow"),
                                ("org/fr/", "allow"), (None, "allow"), ("example.com/de/", "block"), (None, "block"),
                                (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow")]
    assert rows[4].host == "www.example.net" and rows[4].path == "/en/x" and rows[15].host == "É.org".replace("É", "É")
    assert url_filters.filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert url_filters.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("canonical"), (F.col("id") < 2000).alias("in"))
    blocks = 2000 * url_filters.BITS_PER_URL // 512
    bloom = url_filters.bloom_blocks(keys.where("in"), blocks)
    hit = None
    for i, m in enumerate(url_filters._masks("canonical")):
        one = F.col(f"w{i}").bitwiseAND(m) == m
        hit = one if hit is None else hit & one
    passed = keys.withColumn("block", url_filters._block(F.col("canonical"), blocks)).join(bloom, "block").where(hit)
    counts = {r["in"]: r["count"] for r in passed.groupBy("in").count().collect()}
    assert counts[True] == 2000 and counts.get(False, 0) < 60


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_fingerprints_and_edits(docs_of, rng):
    texts = ODD + [prose(rng, 400, [f"w{i}" for i in range(900)]) for _ in range(30)]
    texts += texts[-3:]
    ids = rng.sample(range(1000), len(texts))
    docs = docs_of(texts, ids=ids)
    rows = {r.doc_id: r for r in minhash.edited_fingerprints(docs).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    errors, by_text = [], {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        assert rows[i].n_chars == n and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 100:
            errors.append(rows[i].near_edited - len(a & b) / len(a | b))
        by_text.setdefault(text, set()).add(rows[i].fingerprint)
    assert all(len(f) == 1 and len(next(iter(f))) == minhash.BINS * minhash.BITS // 4 for f in by_text.values())
    assert abs(sum(errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.25


def test_next_document_in_edge_cases(docs_of):
    one = minhash.edited_fingerprints(docs_of(["abc def"])).first()
    assert one.near_next == 1.0
    assert minhash.edited_fingerprints(docs_of([])).count() == 0
    rows = minhash.with_next(docs_of(["a", "b", "c", "d"], ids=[7, None, 7, -3]).select("doc_id", "text"), ["text"])
    after = {r.text: r.next_text for r in rows.collect()}
    assert after["d"] == "b" and {after["a"], after["c"]} in ({"a", "d"}, {"c", "d"}) and after["b"] in "ac"


def test_estimator_is_unbiased(docs_of, rng):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(base)] + [" ".join(base[:cut] + [rng.choice(words) for _ in range(300 - cut)])
                                for cut in (270, 200, 100)]
    prints = minhash.with_fingerprint(docs_of(texts).select("doc_id", "text"), "text", "print")
    first = prints.where("doc_id = 0").select(F.col("print").alias("other"))
    near = {r.doc_id: r.near for r in prints.join(F.broadcast(first), F.lit(True)).select(
        "doc_id", minhash.likeness("print", "other").alias("near")).collect()}
    for i, t in enumerate(texts):
        a, b = shingles(texts[0]), shingles(t)
        assert abs(near[i] - len(a & b) / len(a | b)) < 0.15
    assert near[0] == 1.0


def without_covered(text, cover):
    """The characters that are not wholly covered."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not all(cover[at:at + n]):
            out.append(c)
        at += n
    return "".join(out)


def accepted_by_brute_force(spark, sf, docs):
    """Rows whose posteriors, in plain Python over the document models' evidence, stay below one half."""
    labels = corpus_pipeline.table(spark, sf, "labels")
    given = {r.doc_id: (float(r.quality == 0), float(r.toxic == 1)) for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    p = [[x for _, x in posteriors_by_brute_force([(r.doc_id, r.host, r.path, r["evidence_" + head]) for r in rows],
                                                  {d: v[i] for d, v in given.items()})]
         for i, head in enumerate(("low", "toxic"))]
    return {r.doc_id for r, *both in zip(rows, *p, strict=True) if max(both) < 0.5}


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of it, on the rows that its predecessor really kept."""
    before = corpus_pipeline.table(spark, sf, "documents")
    docs = before
    counts, kept = [], [{r.doc_id: r for r in before.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, docs, sf))
        assert after.columns[:5] == before.columns
        counts.append((docs.count(), after.count()))
        docs = after
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == counts[-1][1]
    (a, b), (_, c), (d, e), (_, f), (g, h) = counts
    assert a > b > c and d == e and e >= f and g == h
    texts = [r.text for r in docs.select("text").collect() if len(r.text) >= 100]
    assert len(texts) == len(set(texts))

    raw, good, single, cut, clean, coded = kept
    assert set(good) == accepted_by_brute_force(spark, sf, before)
    assert all(good[i] == raw[i] for i in good) and all(single[i] == good[i] for i in single)
    assert sorted(single) == near_copies_by_brute_force([(i, r.text) for i, r in sorted(good.items())])
    rows = sorted((i, r.text) for i, r in single.items())
    for (i, text), cover in zip(rows, removed_by_brute_force(rows), strict=True):
        want = without_covered(text, cover)
        assert (cut[i].text, cut[i].n_chars, cut[i].lang, cut[i].source) == (want, len(want), single[i].lang, single[i].source)
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, sf, "benchmark").collect()]
    ids = sorted(cut)
    found = contamination_by_brute_force([cut[i].text for i in ids], items)
    assert set(clean) == {i for i, (*_, bad) in zip(ids, found, strict=True) if not bad}
    assert all(clean[i] == cut[i] for i in clean)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in coded.items():
        want = lib.encode(r.text)
        assert (r.text, r.ids, r.n_tokens) == (clean[i].text, want, len(want))
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()


def test_queries_are_registered():
    assert sorted(q.split("_")[0] for q in QUERIES if q != "pipeline") == sorted(f"op{n}" for n in range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and LISTED_HOSTS


@pytest.mark.parametrize("name", sorted(k for k, v in ORACLES.items() if v))
def test_query_equals_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(ORACLES[name]).df()[cols].astype(object).where(lambda d: d.notna(), None)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(
        map(str, want.itertuples(index=False, name=None)))
