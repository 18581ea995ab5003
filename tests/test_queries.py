"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siglake import plans
from siglake.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def ordered(df):
    own = df[sorted(df.columns)]
    return own.sort_values(list(own.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name not in registry.ORACLES:
        assert len(got) and got.notna().all().all()
        return
    pd.testing.assert_frame_equal(ordered(got), ordered(duck.execute(registry.ORACLES[name]).df()), check_dtype=False, check_exact=True)


def test_plans_hold_no_nested_loop(spark):
    for name in ("restrict_events", "match_nearest", "detect_overlaps", "subtract_intervals", "event_lag_histogram", "peri_event_histogram", "burst_pairs"):
        df = registry.QUERIES[name](spark, DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
        loops = plan.count("CartesianProduct") + (plan.count("BroadcastNestedLoopJoin") if name != "estimate_lag" else 0)
        assert loops == 0, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["events_to_intervals"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan and "user_id" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
