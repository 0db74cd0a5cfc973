from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("resolve_identity", "latest_per_key", "trade_kind_filter", "digest_minutes")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


@pytest.mark.skipif(not Path(SF).exists(), reason="shared tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    from tools.compare import TABLES, rows_of

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="shared tables are not here")
@pytest.mark.parametrize("name", ("entity_history", "people_timeline", "cluster_trades", "join_session_offset", "search_entities", "feed_groups", "bar_inventory", "sector_candles"))
def test_plans_hold_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
