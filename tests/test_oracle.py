"""Every registered query against its DuckDB oracle on the small driver tables,
plus plan checks for the scale-relevant shapes."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from compare import TABLES, rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

from gleaner.plans import registry  # noqa: E402

KEYS = sorted(registry.all_queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle():
    assert set(KEYS) == set(registry.all_sql()) and set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    sc, sr = rows_of(sdf.toPandas())
    dc, dr = rows_of(duck.sql(E.oracle_sql()[key]).df())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "is_new" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_scan_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F

    from gleaner.plans.common import load
    spark.catalog.clearCache()            # cached inputs of earlier queries would replace the scan
    df = load(spark, SF_SMALL, "embeddings", ["vec_id", "label"]).where(F.col("label").isin(1, 3))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label" in p or "PushedFilters: [IsNotNull(label), In(label" in p
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in p


def test_plan_topk_uses_group_limit(spark):
    q = E.queries()["positional_cap"](spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "WindowGroupLimit" in _plan(q)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_plan_dispatch_has_no_join(spark):
    q = E.queries()["profile_dispatch"](spark, SF_SMALL)
    p = _plan(q)
    assert "Join" not in p and "Exchange" not in p


def test_plan_keep_first_partial_aggregation(spark):
    q = E.queries()["dedup_first"](spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(q)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("min_by") >= 2          # partial + final min_by aggregate
    assert p.count("ArrowEvalPython") + p.count("MapInPandas") + p.count("PythonMapInArrow") >= 1


def test_plan_two_level_scan_reads_input_once(spark):
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(E.queries()["speaker_change"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("FileScan parquet") == 1 and "ReusedExchange" in p
