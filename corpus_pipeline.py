"""From raw documents to token ids: five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
documents (the last adds its own); ``run`` writes each result to the shared
checkpoint folder as Parquet and reads it back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import decontamination, near_copies, quality, repeats, sentencepieces
from siftwork.llm.common import saved, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word Jaccard of at least 0.8,
    verified on every candidate (op8 has its own contract of bits)."""
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat what an earlier one says."""
    return repeats.drop_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to speak of."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, checked by decoding them."""
    out = sentencepieces.encode_pieces(docs)
    return out.withColumns({"n_tokens": F.size("ids").cast("long"),
                            "decoded_sha256": F.sha2(F.encode("decoded", "UTF-8"), 256)}).drop("decoded")


STAGES = [
    ("quality classifier", classified),
    ("SimHash near-dedup", deduplicated),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: Learned weights, fingerprints and merges are beyond SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
