"""Every bound query against its SQL, and the shape of the plans."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwork.operators import similarity
from siftwork.operators.selection import Selection
from siftwork.plans import bindings as b

FAST = sorted(os.environ.get("SIFTWORK_QUERIES", "").split()) or [
    "overview", "facet_coverage", "sel_facets", "sel_id_list", "agreement_hist", "suspects", "export_record",
    "label_path", "reconcile", "knn", "leak_curve", "hubness", "zero_shot", "composed", "negative_only",
    "bm25_and", "hybrid_rrf", "term_stats", "describe_facets", "album_common", "coherence", "reorder_check",
    "eval_metrics", "percentile_bucket", "axes", "activity_windows"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def canonical(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in cursor.fetchall()]
    assert canonical([[r[c] for c in cols] for r in got.collect()]) == canonical(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_selection_sits_below_the_limit(spark, sf):
    c = b.docs(spark, sf)
    plan = plan_of(Selection(split="train", tag="click").apply(c).select("id").orderBy("id").limit(5))
    assert plan.index("Limit") < plan.index("LeftSemi") < plan.index("Filter")


def test_split_filter_reaches_the_scan(spark, sf):
    plan = b.docs(spark, sf).samples.where(F.col("dataset") == "src7").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src7)]" in text
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    v = b.vectors(spark, sf)
    near = similarity.knn(v, v.withColumnRenamed("id", "query_id"), 3)
    assert "WindowGroupLimit" in plan_of(near)
