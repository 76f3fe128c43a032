"""SimHash groups, long repeats and contamination against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import common, components, decontamination, near_copies, repeats, simhash
from .conftest import ODD, prose


def groups_by_brute_force(prints, max_bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    some = sorted(prints)
    for i, a in enumerate(some):
        for b in some[:i]:
            if bin(a ^ b).count("1") <= max_bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def check_groups(docs, size=3, max_bits=2):
    rows = [(r.doc_id, simhash.fingerprint(r.text, size)) for r in docs.select("doc_id", "text").collect()]
    of = groups_by_brute_force({p for _, p in rows}, max_bits)
    least = {}
    for i, p in rows:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    want = sorted(((i, f"{p:016x}", least.get(of[p])) for i, p in rows), key=str)
    got = simhash.near_duplicates(docs, size, max_bits)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def test_fingerprint_follows_its_definition():
    import xxhash
    words = b"a b c d e".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint("A b\x0bC\nd e") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_close_fingerprints_are_linked(docs_of, rng):
    base = [prose(rng, 300, [f"w{i}" for i in range(400)]) for _ in range(12)]
    near = []
    for t in base:
        words = t.split()
        for _ in range(6):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
            near.append(" ".join(words))
    want = check_groups(docs_of(ODD + base + base[:3] + near))
    assert len({c for _, _, c in want}) < len(want)


def test_large_groups_and_chains(spark):
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(20) for j in range(i)]
    far = [0x0F0F << 40 | i * 0x1111 for i in range(8)]
    prints = {simhash._signed(p) for p in flips + far}
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "print long"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    of = groups_by_brute_force({p & (1 << 64) - 1 for p in prints}, 2)
    for a in prints:
        for b in prints:
            same = of[a & (1 << 64) - 1] == of[b & (1 << 64) - 1]
            assert (roots.get(a, a) == roots.get(b, b)) == same


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs_of):
    docs = docs_of(["a b c d", "a b c d", None, "", "other words here now"], ids=[4, 2, 9, 9, None])
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]
    assert simhash.keep_one(docs_of([])).count() == 0 and simhash.near_duplicates(docs_of([])).count() == 0


def near_copies_by_brute_force(rows):
    """Ids of the rows (id, text) that stay: the least of each component."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def edited_texts(rng):
    """Copies with few words changed (around the threshold), a crowd around one
    text, a crowd with a passage in common, and a line that many texts hold."""
    many = [f"w{i}" for i in range(900)]
    line = prose(rng, 9, many)
    out = [f"{prose(rng, rng.randrange(4, 120), many)} {line}" for _ in range(60)]
    for t in [prose(rng, n, many) for n in (6, 25, 60, 100, 200, 400)]:
        for edits in (0, 1, 2, 3, 5, 8):
            words = t.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
            out.append(" ".join(words))
        out += [t[:len(t) * 9 // 10], f"{t} {prose(rng, 12, many)}"]
    crowd = prose(rng, 150, many)
    for edits in (3, 4, 5, 6):
        for _ in range(18):
            words = crowd.split()
            for _ in range(edits):
                words[rng.randrange(150)] = f"u{rng.randrange(900)}"
            out.append(" ".join(words))
    out += [f"{prose(rng, 25, many)} {crowd[:400]}" for _ in range(45)]
    return out


def test_near_copies_of_the_pipeline_equal_brute_force(spark, docs_of, rng):
    texts = ODD + edited_texts(rng)
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = near_copies_by_brute_force(list(zip(order, texts, strict=True)))
    assert len(want) < len(texts)
    docs = docs_of(texts, ids=order)
    kept = corpus_pipeline.deduplicated(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_simhash_finds_most_near_copies(spark, docs_of, rng):
    """One word of 220 differs (about four bits; the exact step finds what is missed); a crowd meets its ends only."""
    many = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(60):
        words = prose(rng, 220, many).split()
        texts += [" ".join(words), " ".join([*words[:110], "other", *words[111:]])]
    prints = near_copies._prints(docs_of(texts, ids=list(range(120)))).select("doc_id", "node", "print").cache()
    node = {r.doc_id: r.node for r in prints.collect()}
    found = {(r.a, r.b) for r in near_copies._by_simhash(prints).collect()}
    pairs = [(max(node[i], node[i + 1]), min(node[i], node[i + 1])) for i in range(0, 120, 2)]
    assert sum(p in found for p in pairs) >= 0.75 * len(pairs)
    crowd = spark.createDataFrame([((1 << i) | (1 << j),) for i in range(60) for j in range(i)], "print long")
    assert 0 < simhash.star_candidates(crowd).count() <= 30 * crowd.count()


@pytest.mark.parametrize("tile", [4096, 40])
def test_a_crowd_below_the_threshold_makes_few_candidates(spark, docs_of, rng, monkeypatch, tile):
    """Copies of one text, each with words of its own: all share shingles, hardly any two are alike."""
    many = [f"w{i}" for i in range(900)]
    base, texts = prose(rng, 150, many), []
    for k in range(150):
        words = base.split()
        for at in rng.sample(range(150), 3 if k % 3 else 1):
            words[at] = f"x{k}"
        texts.append(" ".join(words))
    seen, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "_verified", lambda d, p, pairs: seen.append(pairs.count()) or verified(d, p, pairs))
    kept = near_copies.keep_one(docs_of(texts, ids=list(range(150))))
    assert sorted(r.doc_id for r in kept.collect()) == near_copies_by_brute_force(list(enumerate(texts)))
    assert seen[-1] < 150 * 149 / 20


def test_a_pair_that_shares_rare_and_crowded_shingles_is_kept(docs_of, rng, monkeypatch):
    """Its rare shingles are too few to name it, and the crowd's stand behind them."""
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    monkeypatch.setattr(near_copies, "_by_simhash", lambda prints: prints.select(
        F.col("node").alias("a"), F.col("node").alias("b")).where("false"))

    def words(n):
        return [f"w{rng.randrange(1 << 40)}" for _ in range(n)]

    passage, shared = words(158), words(8)
    texts = [" ".join(passage + words(26)) for _ in range(40)]
    texts += [" ".join(passage + shared + words(18)) for _ in range(2)]
    want = near_copies_by_brute_force(list(enumerate(texts)))
    assert want == list(range(41))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs_of(texts)).collect()) == want


def test_long_marks_rule_out_long_texts_below_the_threshold():
    """Without reading sets; they never differ in more bits than the sets in shingles."""
    draw = np.random.default_rng(3)
    for n, m in ((600, 600), (3000, 2600), (4000, 5000), (300, 5000)):
        for both in (0, min(n, m) // 2, min(n, m) * 8 // 10, min(n, m)):
            every = draw.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
            x, y = np.unique(every[:n]), np.unique(every[n - both:])
            apart = near_copies._apart(near_copies._long_marks(x), near_copies._long_marks(y))
            assert apart <= n + m - 2 * both
            if n > 512 and 0.6 * (n + m - both) > both:
                assert 9 * apart > n + m


def test_rows_are_named_in_parts(docs_of, rng, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 128)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [*base, *(t + " more" for t in base), *base[:3]]
    docs = docs_of(texts)
    want = near_copies_by_brute_force(list(enumerate(texts)))
    kept = near_copies.keep_one(docs.unionByName(docs.where("doc_id = 5")))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_near_copies_without_rows_and_ids(docs_of):
    docs = docs_of(["a b c d", "A b c D", None, "", "other words here now"], ids=[4, 2, 9, 9, None])
    kept = near_copies.keep_one(docs.unionByName(docs))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]
    assert near_copies.keep_one(docs_of([])).count() == 0


def removed_by_brute_force(rows, width=repeats.WIDTH):
    """rows: (doc_id, text) in corpus order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p:p + width]
            if w in seen:
                cover[p:p + width] = b"\1" * width
            seen.add(w)
        out.append(cover)
    return out


def repeat_texts(rng):
    passage = prose(rng, 60)
    long = prose(rng, 3_000)
    out = [prose(rng, rng.randrange(5, 200)) for _ in range(25)]
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(8)]
    out += [out[3], out[3][:150], out[4] + out[4], "z" * 500, "ab" * 300, long, long[5_000:9_000], out[5] + passage[7:]]
    return ODD + out


def test_repeats_equal_brute_force(docs_of, rng):
    texts = repeat_texts(rng)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = sorted(zip(order, texts, strict=True))
    got = {r.doc_id: r for r in repeats.repeat_report(docs_of(texts, ids=order)).collect()}
    for (i, text), cover in zip(rows, removed_by_brute_force(rows), strict=True):
        raw = (text or "").encode()
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        runs = len(re.findall(b"\1+", bytes(cover)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest())


def test_repeated_rows_and_null_ids(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = repeats.repeat_report(docs_of([text, text, text, text], ids=[5, 5, None, 7])).collect()
    removed = {r.doc_id: r.n_removed for r in rows}
    assert removed == {None: 0, 5: len(text), 7: len(text)} and len(rows) == 4
    assert repeats.repeat_report(docs_of([])).count() == 0


def test_characters_stay_whole(docs_of):
    text = "é" * 30 + "".join(chr(0x4E00 + i) for i in range(80))
    docs = docs_of([text, "ü" + text, "clean"])
    out = {r.doc_id: r for r in repeats.drop_repeats(docs).collect()}
    assert repeats.drop_repeats(docs).columns == docs.columns
    assert out[0].text == text and out[1].text == "ü" and out[1].n_chars == 1 and out[2].text == "clean"
    assert out[1].rest is None and out[1].copy == "x"


def test_parse_holds_little_beside_its_texts(rng):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(4000)]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(n), "_copy": np.arange(n), "text": texts,
                                        "_bucket": np.arange(n, dtype=np.int32) % 8})
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in repeats._parsed(8)(iter([batch])))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert rows == 8 and peak < 60 << 20  # 8 MB of texts


TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TR))


def contamination_by_brute_force(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s:s + 13]), set()).add("" if i is None else str(i))
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s:s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        yield (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
               bool(hit) and 20 * len(hit) >= len(w))


def test_contamination_equals_brute_force(spark, docs_of, rng):
    many = [f"t{i}" for i in range(50)]
    items = [(1, prose(rng, 40, many)), (2, prose(rng, 13, many)), (3, "Alpha, BETA gamma"), (10, "delta"),
             (4, None), (5, "..."), (6, prose(rng, 20, many)), (6, prose(rng, 30, many)), (None, prose(rng, 15, many))]
    item = dict((i, t) for i, t in items if i in (1, 2, 6))
    texts = ODD + [prose(rng, 100, many) for _ in range(5)]
    texts += [f"{prose(rng, 30, many)} {t} {prose(rng, 30, many)}" for t in item.values()]
    texts += [item[1], item[1].upper().replace(" ", " - "), item[1][40:], "alpha beta gamma delta", "delta " * 40,
              prose(rng, 600, many) + " " + item[2], (item[2] + " ") * 3]
    docs = docs_of(texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in
           decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == list(contamination_by_brute_force(texts, items))


def test_no_items_and_no_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = docs_of(["a b c", None, "x"], ids=[1, 1, None])
    assert [r.contaminated for r in decontamination.contamination(docs, none).collect()] == [False] * 3
    assert decontamination.contamination(docs_of([]), some).count() == 0
    kept = decontamination.decontaminate(docs, some)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "x"]


def test_alike_sets_share_what_is_needed():
    """The count filter loses no pair: any two sets of similarity 0.8 share that many of their first fifths."""
    import numpy as np
    draw = np.random.default_rng(5)
    tight = 0
    for _ in range(4000):
        n = int(draw.integers(1, 80))
        base = draw.permutation(400)[:n]
        own = [draw.integers(400, 800, draw.integers(0, n // 8 + 2)) if draw.random() < .5 else
               draw.integers(-400, 0, draw.integers(0, n // 8 + 2)) for _ in range(2)]
        cut = [base[draw.random(n) > draw.random() / 8] if draw.random() < .5 else np.sort(base)[draw.integers(0, n // 8 + 1):]
               for _ in range(2)]
        x, y = (np.unique(np.concatenate(z)) for z in zip(cut, own, strict=True))
        both = len(np.intersect1d(x, y))
        if not (len(x) and len(y)) or not near_copies.alike(len(x), len(y), both):
            continue
        met = np.intersect1d(x[:near_copies._fifth(len(x))], y[:near_copies._fifth(len(y))])
        needed = int(near_copies._needed(np.array([len(x)]), np.array([len(y)]))[0])
        assert len(met) >= needed
        tight += len(met) == needed
    assert tight > 50
