"""The dataset report: small tables computed in Spark, written as text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.corpus import Corpus
from siftwork.operators import aggregates as ag
from siftwork.operators import listing

# Names a dimension may also be asked for by.
ALIASES = {
    "splits": "split", "captions": "caption_length", "caption_lengths": "caption_length",
    "quality": "agreement", "caption_quality": "agreement", "axes": "difficulty_axes",
    "difficulty": "difficulty_axes", "size": "image_size", "dimensions": "image_size",
    "tag": "tags", "time": "time_of_day", "subject": "main_subject",
}


def _labelled(df: DataFrame, label: str, value: str = "n") -> DataFrame:
    return df.select(F.col(label).cast("string").alias("label"),
                     F.col(value).cast("double").alias("value"))


DIMENSIONS = {
    "split": lambda c: _labelled(ag.split_counts(c.samples), "split"),
    "caption_length": lambda c: _labelled(ag.word_count_distribution(c.table("captions")), "words"),
    "agreement": lambda c: _labelled(ag.agreement_histogram(c.table("captions")), "lo"),
    "difficulty_axes": lambda c: _labelled(ag.hard_tail(c.samples), "axis"),
    "image_size": lambda c: _labelled(ag.dimension_counts(c.samples), "dimensions"),
    "tags": lambda c: _labelled(ag.tag_counts(c.table("sample_tags")), "tag"),
}


def distribution(corpus: Corpus, dimension: str) -> DataFrame:
    """``label, value, share`` of a named dimension; any facet group of the
    corpus is one without being registered."""
    name = dimension.strip().lower().replace(" ", "_")
    name = ALIASES.get(name, name)
    if name in DIMENSIONS:
        return ag.with_shares(DIMENSIONS[name](corpus))
    rows = corpus.table("attributes").where(F.col("grp") == name)
    if rows.limit(1).count() == 0:
        raise ValueError(f"unknown dimension {dimension!r}, known: {sorted(DIMENSIONS)} "
                         "and the facet groups")
    return ag.with_shares(_labelled(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label"))


@dataclass
class Block:
    """One table of a report with the measurement it states."""

    title: str
    source: str
    rows: DataFrame
    order: list = field(default_factory=list)
    note: str | None = None


@dataclass
class Section:
    heading: str
    text: str
    blocks: list[Block]


def dataset_sections(corpus: Corpus, benchmark: DataFrame | None = None) -> list[Section]:
    """Scale, composition, annotation quality, difficulty, retrieval."""
    def points(df: DataFrame, limit: int = ag.MAX_POINTS) -> DataFrame:
        return ag.capped(df.select("label", "value"), limit)

    by_value = [F.col("value").desc(), F.col("label")]
    sections = [Section("Size", "Rows of each table and how many carry computed signals.", [
        Block("Rows", "counts over samples, captions, tags", ag.overview(corpus))])]
    groups = [r["grp"] for r in corpus.table("attributes").select("grp").distinct().orderBy("grp").collect()]
    composition = [Block("Splits", "count of samples by split",
                         points(distribution(corpus, "split"), ag.MAX_PIE_POINTS), by_value)]
    composition += [Block(f"Facet {g}", f"count of attributes in {g}",
                          points(distribution(corpus, g)), by_value) for g in groups]
    composition.append(Block("Dimensions", "count of samples by width and height",
                             points(distribution(corpus, "image_size")), by_value))
    sections.append(Section("Shares", "Rows by split, facet and dimension.", composition))
    suspects = listing.suspect_captions(corpus, 10).select("sample_id", "agreement", "text")
    sections.append(Section("Captions", "Length, agreement, and the captions that their siblings support least.", [
        Block("Caption length", "words per caption",
              ag.word_count_distribution(corpus.table("captions")), [F.col("words")]),
        Block("Agreement", "captions per bin over the observed range",
              ag.agreement_histogram(corpus.table("captions")), [F.col("bin")]),
        Block("Least supported captions", "captions by ascending agreement", suspects,
              [F.col("agreement"), F.col("sample_id")])]))
    sections.append(Section("Axes", "Samples at the hard end of each axis.", [
        Block("Scores of 8 and more", "samples scoring 8 or more", ag.hard_tail(corpus.samples), [F.col("axis")])]))
    if benchmark is not None:
        sections.append(Section("Search", "Captions as queries, without themselves.", [
            Block("Ranks by mode", "caption to sample retrieval", benchmark, [F.col("mode")])]))
    return sections


def _cell(value) -> str:
    if value is None:
        return "—"
    text = f"{value:g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def _rows_of(block: Block) -> tuple[list[str], list[list], int]:
    """At most MAX_TABLE_ROWS rows reach the driver, with the full count."""
    shown = ag.table_block(block.rows, block.order or [F.lit(1)])
    got = shown.collect()
    names = block.rows.columns
    return names, [[r[n] for n in names] for r in got], got[0]["total_rows"] if got else 0


def render(title: str, sections: list[Section]) -> tuple[str, str]:
    """Markdown and JSON of a report; every table states its source."""
    md, doc = [f"# {title}", ""], {"title": title, "sections": []}
    if len(sections) > 1:
        md += ["## Contents", *[f"- {s.heading}" for s in sections], ""]
    for s in sections:
        md += [f"## {s.heading}", "", s.text, ""]
        doc["sections"].append({"heading": s.heading, "text": s.text, "blocks": []})
        for b in s.blocks:
            names, rows, total = _rows_of(b)
            note = b.note or ""
            if total > len(rows):
                note = f"{note} Showing the first {len(rows)} of {total} rows.".strip()
            md += [f"### {b.title}", ""]
            if rows:
                md += ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
                md += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows]
            else:
                md.append("_(no rows)_")
            md += ["", f"*Source: {b.source}*", ""] + ([f"> {note}", ""] if note else [])
            doc["sections"][-1]["blocks"].append(
                {"title": b.title, "source": b.source, "note": note, "columns": names, "rows": rows})
    return "\n".join(md).rstrip() + "\n", json.dumps(doc, default=str)


def write_report(spark: SparkSession, path: str, title: str, sections: list[Section]) -> None:
    """Write both forms through Spark, so any file system of the cluster works."""
    markdown, as_json = render(title, sections)
    for i, block in enumerate(b for s in sections for b in s.blocks):  # whole tables beside the shown rows
        block.rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/tables/{i:03d}")
    for name, body in (("markdown", markdown), ("json", as_json)):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path.rstrip('/')}/{name}")
