"""Event logs against a plain fold; formatted text against what was put in."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import chat_format, queries

ODD_TEXTS = [None, "", "#", "###", "####", "\\", "\\###", " </turn>\n", "</turn>", ": ", "### user: x </turn>\n", "é😀\n", "a" * 5000, "<", "ends in \\"]
EVENT = "conv_id long, seq long, message long, kind string, role string, text string, cut int, carried string"


def folded(events):
    """Events of one conversation, in order."""
    state = {}
    for _, message, kind, role, text in events:
        if kind == "regenerate":
            state = {m: v for m, v in state.items() if m < message} | {message: [state.get(message, [None])[0], ""]}
        told = state.setdefault(message, [None, ""])
        told[1] = text or "" if kind == "edit" else told[1] + (text or "")
        if role is not None:
            told[0] = role
    return state


@pytest.mark.parametrize("segment", [chat_format.SEGMENT, 4, 1])
def test_reconstruction_equals_a_fold(spark, segment):
    rng = random.Random(segment)
    rows, want = [], {}
    for conv in [None, *range(25)]:
        events, top = [], 0
        for seq in range(rng.randint(1, 40)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate"])
            message = rng.randint(0, top)
            if kind == "open":
                top += 1
                message = top
            events.append((seq, message, kind, rng.choice(["user", "assistant"]) if kind == "open" else None,
                           rng.choice(["a", "b ", None, ""])))
        state = folded(events)
        # A message that was discarded keeps the role it had, if it comes again without one.
        roles = {}
        for _, message, _, role, _ in events:
            roles[message] = role if role is not None else roles.get(message)
        want |= {(conv, m): (roles[m], t) for m, (_, t) in state.items()}
        rows += [(conv, *e, 1, "x") for e in events]
    rows += rng.sample(rows, 30) + [(1, None, 0, "delta", "user", "lost", 1, "x"), (1, 5, None, "delta", "user", "lost", 1, "x"),
                                    (1, 5, 0, "ping", "user", "lost", 1, "x"), (1, 5, 0, None, "user", "lost", 1, "x")]
    rng.shuffle(rows)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.reconstruct(
        spark.createDataFrame(rows, EVENT), segment).collect()}
    assert got == want
    assert chat_format.reconstruct(spark.createDataFrame([], EVENT)).collect() == []


def test_formatted_text_reads_back(spark):
    rng = random.Random(4)
    messages = [(c, m, rng.choice(["user", "assistant", "a: b", "###", None, ":", "x\\", "#"]), rng.choice(ODD_TEXTS))
                for c in range(30) for m in range(rng.randint(1, 6))]
    turns = chat_format.render(spark.createDataFrame(messages, "conv_id long, message long, role string, text string"))
    for row in chat_format.joined(turns).collect():
        mine = [(r or "", t or "") for c, _, r, t in messages if c == row.conv_id]
        assert chat_format.read(row.formatted) == mine
        assert [chat_format.unescaped(row.formatted[s.start:s.stop]) for s in row.loss] == [
            t for r, t in mine if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("#\\:< /turn>ab\n"), st.text("#\\:< /turn>ab\n")), max_size=5))
def test_marks_are_unambiguous(turns):
    import re
    esc = lambda t, more="": re.sub(r"(\\|###|</turn>" + more + ")", r"\\\1", t)
    text = "".join(f"### {esc(r, '|: ')}: {esc(t)} </turn>\n" for r, t in turns)
    assert chat_format.read(text) == turns


@pytest.mark.parametrize("n", [0, 40])
def test_query_equals_plain_python_and_sql(spark, tmp_path, n):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None, "a: b"]), rng.choice(ODD_TEXTS), 1)
            for c in range(n) for t in range(rng.choice([1, 3, 12]))]
    rows += rows[:5]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int").coalesce(1).write.parquet(path)
    said = "\\### Assistant: </turn> ok"
    convs = {-7: [("user", said), ("assistant", said)]}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((c, len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), sum(len(t) for r, t in ts if r == "assistant"),
                   sha("".join(t for r, t in ts if r == "assistant"))) for c, ts in convs.items())
    cols = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    got = sorted(tuple(r[c] for c in cols) for r in queries.QUERIES["op13_chat_formatting"](spark, str(tmp_path)).collect())
    assert [g[:5] for g in got] == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['op13_chat_formatting']})").fetchall()) == got
