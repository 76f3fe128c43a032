"""Tree contraction and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftwork.llm import contraction, prefix_trie, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def totals(tree):
    below = defaultdict(list)
    for node, (parent, *_) in tree.items():
        below[parent].append(node)
    out = {}
    for node in tree:
        stack, total = [node], [0, 0]
        while stack:
            at = stack.pop()
            total = [a + b for a, b in zip(total, tree[at][1:], strict=True)]
            stack += below[at]
        out[node] = tuple(total)
    return out


def shapes(rng):
    yield {0: (None, 3, 4)}
    yield {i: (i - 1 if i else None, i, 1) for i in range(60)}
    yield {i: (0 if i else None, 1, i) for i in range(60)}
    yield {i: (rng.randrange(max(0, i - 4), i) if i else None, rng.randrange(9), 1) for i in range(200)}
    yield {i: (rng.randrange(i) if i % 37 else None, 1, -i) for i in range(150)}


@pytest.mark.parametrize("shape", range(5))
def test_subtree_totals(spark, shape):
    tree = list(shapes(random.Random(shape)))[shape]
    df = spark.createDataFrame([(i, *v) for i, v in tree.items()], "id long, parent long, a long, b long")
    got = {r.id: (r.a, r.b) for r in contraction.subtree_totals(df, ["a", "b"]).collect()}
    assert got == totals(tree)


def test_odd_forests(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 1, None), (3, 99, 7), (None, 1, 4), (2, 1, 6)], "id long, parent long, a long")
    assert {r.id: r.a for r in contraction.subtree_totals(df, ["a"]).collect()} == {1: 11, 2: 6, 3: 7}
    assert contraction.subtree_totals(df.where("false"), ["a"]).collect() == []
    with pytest.raises(ValueError):
        contraction.subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, a long"), ["a"])


def trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p] + [x for k in children[p] for x in below(k)]
    rows = []
    for p, ms in members.items():
        sub = below(p)
        rows.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]),
                     sum(not children[x] for x in sub),
                     sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x),
                     sha(",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(p)))))))
    return sorted(rows, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(rng, n):
    say = [("user", "é"), ("assistant", "yes"), ("user", None), (None, "no"), ("", "no"), ("user", "")]
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            role, text = rng.choice(say[:2]) if rng.random() < .8 else rng.choice(say)
            yield (c, rng.choice([t, t, None]), role, text)


@pytest.mark.parametrize("segment", [prefix_trie.SEGMENT, 3])
def test_trie_equals_plain_python(spark, segment):
    rng = random.Random(segment)
    convs = {c: [(rng.choice("ua"), rng.choice(["x", "é", ""])) for _ in range(rng.choice([0, 1, 4, 9]))] for c in range(40)}
    convs[50] = convs[51] = [("u", "x")] * 30
    turns = spark.createDataFrame([(c, d + 1, r, t, 1) for c, ts in convs.items() for d, (r, t) in enumerate(ts)],
                                  "conv_id long, depth long, role string, text string, p0 int")
    sizes = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv_id long, n_turns long")
    assert rows_of(prefix_trie.prefix_trie(sizes, turns, segment)) == trie(convs)


def test_trie_without_conversations(spark):
    sizes = spark.createDataFrame([], "conv_id long, n_turns long")
    turns = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, depth long, role string, text string")
    assert prefix_trie.prefix_trie(sizes, turns).collect() == []


@pytest.mark.parametrize("n", [0, 60])
def test_query_equals_plain_python(spark, tmp_path, n):
    rows = list(conversations(random.Random(2), n)) + [(None, 1, "user", "of no conversation")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, t, r, x in sorted(rows[:-1], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((r or "", x or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    want = trie(convs)
    assert rows_of(queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))) == want
