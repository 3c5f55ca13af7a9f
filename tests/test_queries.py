"""Every query of the library proper against its DuckDB text on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, duck_rows, spark_rows
from checks.texts import ORACLE
from firnline.plans.catalog import QUERIES

UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"]
WITHOUT_TEXT = {"freshness"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, duck, name):
    frame = queries()[name](spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in UNWANTED)
    schema, got = spark_rows(frame)
    if name in WITHOUT_TEXT:
        assert got
        return
    duck_schema, want = duck_rows(duck, oracle_sql()[name])
    assert schema == duck_schema
    assert got == want


def test_every_text_belongs_to_a_query():
    assert set(ORACLE) == set(QUERIES) - WITHOUT_TEXT
    assert set(QUERIES) <= set(queries()) and ORACLE.items() <= oracle_sql().items()


def test_entry(spark, small):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "daily_rollup", "outer_weather_snow", "live_table", "snow_enriched", "trend_wind_stations", "moving_avg_station",
    "risk_matrix_canton", "stream_daily",
])
def test_plans_for_large_inputs_agree(spark, small, duck, name, monkeypatch):
    """The same rows when small groups count as hot and nothing may be broadcast by hint."""
    from firnline.operators import enrich, rollup

    for module, most in ((enrich, 1), (rollup, 8)):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
        monkeypatch.setattr(module, "HOT_ROWS", most)
    schema, got = spark_rows(queries()[name](spark, small))
    assert (schema, got) == duck_rows(duck, oracle_sql()[name])
