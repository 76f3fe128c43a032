"""Chat formatting: event logs folded into final messages, then rendered and read back.

An event is (conv_id, seq, message, kind, role, text).  ``open`` begins a message,
``delta`` adds to its text, ``edit`` replaces its text, ``regenerate`` empties it and
discards every later message of the conversation; any of them may carry text and the
role.  An event counts if no later regeneration reaches its message, and text counts
from the message's last edit on.  The log is cut into segments of sequence numbers, so
a conversation of any length is folded in many tasks: what later segments discard
enters a segment as one number.  A message is assembled in one cell.

A rendered turn is ``### role: text </turn>`` and a line break.  Control strings inside
are escaped with a backslash, which is escaped itself, so reading gives back what was
written.  The loss mask covers each assistant text, as a span of code points.

Defined results: a null text is empty and a null role is no role (empty when
rendered); events without seq or message, or of another kind, count for nothing; an
event that is delivered twice counts once; different events of one seq are taken in
the order of message, kind, role and text; a null conv_id is a conversation like any
other; an empty log gives no message.  Only the columns named are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of a segment.
SEGMENT = 4096
KINDS = ("open", "delta", "edit", "regenerate")
START, COLON, END = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
_LAST = (1 << 63) - 1


def reconstruct(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, message, role, text): the messages that an event log comes to."""
    log = events.where("seq IS NOT NULL AND message IS NOT NULL").where(F.col("kind").isin(*KINDS)).select(
        "conv_id", F.floor(F.col("seq") / segment).alias("_segment"), F.col("seq").cast("long").alias("seq"),
        F.col("message").cast("long").alias("message"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    again = F.when(F.col("kind") == "regenerate", F.col("message"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = log.groupBy("conv_id", "_segment").agg(F.min(again).alias("least")).withColumn(
        "least", F.min("least").over(later)).where("least IS NOT NULL")
    reached = beyond.select("conv_id", "_segment", F.lit(_LAST).alias("seq"), F.col("least").alias("message"),
                            F.lit("regenerate").alias("kind"), F.lit(None).cast("string").alias("role"),
                            F.lit("").alias("text"), F.lit(True).alias("carried"))
    order = ["seq", "message", "kind", "role", "text"]
    back = Window.partitionBy("conv_id", "_segment").orderBy(F.desc("carried"), *(F.desc(c) for c in order))
    event = F.struct(*order)
    seen = log.withColumn("carried", F.lit(False)).unionByName(reached).withColumns({
        "twice": F.lag(event).over(back).eqNullSafe(event),
        "cut": F.min(again).over(back.rowsBetween(Window.unboundedPreceding, -1))}).where("NOT carried AND NOT twice")
    counts = F.col("cut").isNull() | (F.col("cut") > F.col("message"))
    grouped = seen.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
        F.collect_list(F.when(counts, F.struct("seq", "kind", "role", "text"))).alias("parts"))
    edits = F.transform(F.filter("parts", lambda p: p["kind"] == "edit"), lambda p: F.struct(p["seq"], p["role"], p["text"]))
    last = F.array_max(edits)
    since = F.filter(F.array_sort("parts"), lambda p: F.col("last").isNull() | (p["seq"] > F.col("last.seq")))
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform(since, lambda p: p["text"]), ""))
    return grouped.where(F.size("parts") > 0).withColumn("last", last).select(
        "conv_id", "message", F.col("named.role").alias("role"), text.alias("text"))


def escaped(text: Column, *more: str) -> Column:
    control = "|".join(["\\\\", START.strip(), END.strip(), *more])
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({control})", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, turn, loss_from, loss_to): the formatted turns of each conversation, in order of
    ``message``.  The span, in code points of the turn, is null where nothing is learned."""
    head = F.concat(F.lit(START), escaped(F.col("role"), COLON), F.lit(COLON))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    begins = F.when(F.col("role") == LEARNED, F.length("head").cast("long"))
    return parts.select("conv_id", "message", F.concat("head", "body", F.lit(END)).alias("turn"),
                        begins.alias("loss_from"), (begins + F.length("body")).alias("loss_to"))


def joined(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): whole conversations in one cell each, with their spans."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("message", "turn", "loss_from", "loss_to"))).alias("t"))
    shifted = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() AS array<struct<start:long,stop:long>>)").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["turn"])).alias("at"),
            F.when(t["loss_from"].isNotNull(), F.concat(a["spans"], F.array(F.struct(
                (a["at"] + t["loss_from"]).alias("start"), (a["at"] + t["loss_to"]).alias("stop"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return rows.select("conv_id", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
                       shifted.alias("loss"))


_ESCAPE = re.compile(r"\\(\\|###|</turn>|: )")
#: The next mark of each kind, or an escaped string before it.
_NEXT = {mark: re.compile(rf"{_ESCAPE.pattern}|{re.escape(mark)}") for mark in (START, COLON, END)}


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text, by its marks."""
    turns, at, fields = [], 0, []
    while True:
        for mark in (START, COLON, END):
            begin = at
            while (token := _NEXT[mark].search(formatted, at)) and token[1]:
                at = token.end()
            if token is None:
                return turns
            fields.append(unescaped(formatted[begin:token.start()]))
            at = token.end()
        turns.append((fields[1], fields[2]))
        fields.clear()


_READ = "conv_id long, message long, n_turns long, turns string, loss_chars long, loss string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """What rendered rows hold: per row the number of turns read, ``turns`` (role, line break, text, line
    break for each), the text under the loss mask and its length, and the length of all."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns", "loss_chars", "loss", "formatted_chars")}
            for text, a, b in zip(*(batch[c].to_pylist() for c in ("turn", "loss_from", "loss_to")), strict=True):
                found, loss = read(text), "" if a is None else unescaped(text[a:b])
                out["n_turns"].append(len(found))
                out["turns"].append("".join(f"{r}\n{t}\n" for r, t in found))
                out["loss_chars"].append(len(loss))
                out["loss"].append(loss)
                out["formatted_chars"].append(len(text))
            yield pa.record_batch({"conv_id": batch["conv_id"].cast(pa.int64()), "message": batch["message"], **out})

    return turns.select("conv_id", "message", "turn", "loss_from", "loss_to").mapInArrow(run, _READ)
