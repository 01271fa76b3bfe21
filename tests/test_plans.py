"""Plan-shape checks: pushdown, pruning, no Python in JVM jobs, reuse."""

import pytest

from support import SF_SMALL
from tessera.plans import QUERIES

# jobs whose plans legitimately contain Python (pandas UDF / grouped map / state)
PYTHON_JOBS = {"user_day_event_gaps", "ab_conversion_p_exact", "event_value_bootstrap", "user_longest_streak"}
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "FlatMapGroupsInPandasWithState", "PythonUDF")

STREAM_OR_FILE_JOBS = {n for n in QUERIES if n.startswith("stream") or n.startswith("events_stream")
                       or n in ("orders_csv_bad_rows", "events_json_roundtrip", "orders_by_year_partitioned")}


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_JOBS - STREAM_OR_FILE_JOBS))
def test_no_python_in_builtin_jobs(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), name


def test_filter_and_columns_reach_the_scan(spark):
    p = plan_of(QUERIES["open_high_value_orders"](spark, SF_SMALL))
    assert "PushedFilters: [" in p
    for f in ("EqualTo(o_orderstatus,O)", "GreaterThan(o_totalprice,400000.0)", "In(o_orderpriority"):
        assert f in p, f
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double," \
           "o_orderpriority:string>" in p


def test_flagship_prunes_lineitem_columns(spark):
    p = plan_of(QUERIES["revenue_rollup"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p


def test_global_ranking_reads_persisted_ranges(spark):
    for name in ("customer_rfm", "part_abc", "part_price_ranks", "event_value_quantiles"):
        p = plan_of(QUERIES[name](spark, SF_SMALL))
        assert "ranged-" in p and "_pid" in p and "SinglePartition" not in p.split("ranged-")[0][-200:], name


def test_ranking_jobs_are_repeatable(spark):
    for name in ("part_abc", "part_price_ranks"):
        a = sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()))
        b = sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()))
        assert a == b, name


def test_pandas_job_is_bucketed(spark):
    p = plan_of(QUERIES["user_day_event_gaps"](spark, SF_SMALL))
    assert "FlatMapGroupsInPandas" in p and "_bucket" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_single_partition_exchanges_are_explained(spark, name):
    from tools.plan_report import SINGLE_PARTITION_NOTES
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    if "Exchange SinglePartition" in p:
        assert name in SINGLE_PARTITION_NOTES, name
