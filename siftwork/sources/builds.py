"""Vector builds: contract check, fingerprints, versioned commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.vector import norm

NORM_SLACK = 1e-3


def contract(vectors: DataFrame) -> DataFrame:
    """One row of facts about a vector table, from one pass."""
    off = F.abs(norm(F.col("embedding")) - 1.0)
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"),
        F.count_if(F.col("id").isNull() | F.col("embedding").isNull()).alias("nulls"),
        F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"),
        F.max(off).alias("norm_error"))


def contract_holds(vectors: DataFrame, expected_rows: int | None = None) -> bool:
    c = contract(vectors).first()
    return bool(
        c["rows"] == c["ids"] and c["nulls"] == 0 and c["min_dim"] == c["max_dim"]
        and (c["norm_error"] or 0.0) <= NORM_SLACK
        and (expected_rows is None or c["rows"] == expected_rows))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint: count, xor and sum of row hashes.  Combines on
    the map side; equal multisets of rows give equal marks."""
    h = F.xxhash64(*[F.col(c) for c in (columns or df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"),
        F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("sum_hash")).select(
        "rows", F.sha1(F.concat_ws(":", "rows", "xor_hash", "sum_hash")).alias("fingerprint"))


class Superseded(RuntimeError):
    """Another build took the place of the one this build meant to replace."""


_MANIFEST = ("version string, replaces string, table string, path string, provider string, rows long, "
             "fingerprint string, corpus string, committed_at timestamp")


def corpus_mark(**tables: DataFrame) -> DataFrame:
    """One row, ``mark``: the ids of a corpus's tables.  New, lost or renumbered rows change it."""
    parts = [fingerprint(df, ["id"]).select(F.lit(name).alias("name"), "fingerprint") for name, df in tables.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("name", "fingerprint"))))).alias("mark"))


def head(spark: SparkSession, root: str) -> str | None:
    """Version in force."""
    rows = _chain(spark, root)
    return rows[-1][0]["version"] if rows else None


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], provider: str, *,
           corpus: DataFrame | None = None, replaces: str | None = "") -> str:
    """Write a build to a fresh version and only then its marker rows.

    Readers find a build through its marker, so a job that dies half way leaves the previous build in
    force.  The marker names the version it replaces (by default the one in force at the start) and the
    mark of the corpus (``corpus_mark``) that it was built from.  If another build took that place in
    the meantime, ``Superseded`` is raised and this one is never read.  Returns the version."""
    root, version = root.rstrip("/"), uuid.uuid4().hex[:12]
    replaces = head(spark, root) if replaces == "" else replaces
    mark = corpus.first()["mark"] if corpus is not None else None
    facts = []
    for name, df in tables.items():
        path = f"{root}/builds/{version}/{name}"
        df.write.parquet(path)
        written = spark.read.parquet(path)
        if "embedding" in written.columns and not contract_holds(written):
            raise ValueError(f"{name} breaks the vector contract, build {version} not committed")
        found = fingerprint(written).first()
        facts.append((version, replaces, name, path, provider, found["rows"], found["fingerprint"], mark, None))
    # One file, so a marker is there whole or not at all.
    manifest = spark.createDataFrame(facts, _MANIFEST).withColumn("committed_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    if version not in [rows[0]["version"] for rows in _chain(spark, root)]:
        raise Superseded(f"build {version} was to replace {replaces}, which has another successor")
    return version


def _chain(spark: SparkSession, root: str) -> list[list]:
    """Marker rows by version, from the first build to the one in force: each replaces the one before it,
    and of two that replace the same the earlier one counts.  Readers see one chain whatever the order
    in which markers arrive, but for markers that are stamped earlier than one already read."""
    marks = spark.read.schema(_MANIFEST).option("ignoreMissingFiles", True).parquet(
        _present(spark, f"{root.rstrip('/')}/manifest"))
    after: dict[str | None, list] = {}
    for r in marks.orderBy("committed_at", "version").collect():  # a few rows for each build
        rows = after.setdefault(r["replaces"], [])
        if not rows or rows[0]["version"] == r["version"]:
            rows.append(r)
    chain, at = [], None
    while at in after:
        chain.append(after.pop(at))
        at = chain[-1][0]["version"]
    return chain


def _present(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def current_build(spark: SparkSession, root: str, corpus: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the build in force; every table from the same one.

    With ``corpus`` (the mark of the corpus as it is now), a build of another corpus is not served: any
    change puts every earlier build out of force, without a marker being touched."""
    chain = _chain(spark, root)
    if not chain or (corpus is not None and chain[-1][0]["corpus"] != corpus.first()["mark"]):
        return {}
    return {r["table"]: spark.read.parquet(r["path"]) for r in chain[-1]}
