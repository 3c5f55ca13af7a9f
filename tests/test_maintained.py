"""The live table by day: the same rows as the one built at once, and only touched days written anew."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from firnline.plans import adapters as A
from firnline.plans import maintained, panels
from firnline.plans.live import live
from tests.conftest import rows


@pytest.fixture
def sources(spark, small, tmp_path):
    """Readings of the first days in one file, and stations; the other days are still to come."""
    events = spark.read.parquet(f"{small}/events.parquet")
    events.where("ts < '2024-01-11'").coalesce(1).write.parquet(f"{tmp_path}/events")
    spark.read.parquet(f"{small}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/supplier")
    return events, str(tmp_path)


def followed(spark, root):
    return maintained.follow(maintained.LiveTable(spark, f"{root}/live"), f"{root}/supplier", f"{root}/events", A.as_stations, A.as_measurements, A.as_snow)


def at_once(spark, root):
    events = spark.read.parquet(f"{root}/events")
    return live(A.as_stations(spark.read.parquet(f"{root}/supplier")), A.as_measurements(events), A.as_snow(events))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    listed = lambda f: sorted((str([round(v, 8) if isinstance(v, float) else v for v in r]) for r in f.select(want.columns).collect()))
    assert listed(got) == listed(want)


def folders(root, spark):
    return maintained.LiveTable(spark, f"{root}/live").table.snapshot().folders


def test_new_files_refresh_their_days_alone(spark, sources):
    events, root = sources
    same(followed(spark, root), at_once(spark, root))
    first = folders(root, spark)
    # a day that is there already, and one that is new; late readings of a station that was silent come with them
    events.where("ts >= '2024-01-15' AND ts < '2024-01-16' OR ts >= '2024-01-05' AND ts < '2024-01-06' AND event_id % 2 = 0") \
        .withColumn("event_id", F.col("event_id") + 1_000_000).coalesce(1).write.mode("append").parquet(f"{root}/events")
    same(followed(spark, root), at_once(spark, root))
    second = folders(root, spark)
    changed = {d for d in second if second[d] != first.get(d)}
    assert changed - {"measure_date=__HIVE_DEFAULT_PARTITION__"} == {"measure_date=2024-01-05", "measure_date=2024-01-15"}
    followed(spark, root)
    assert folders(root, spark) == second, "nothing has come, nothing is written"


def test_removed_readings_and_changed_stations_refresh_everything(spark, sources):
    events, root = sources
    events.where("ts >= '2024-01-20'").coalesce(1).write.mode("append").parquet(f"{root}/events")
    followed(spark, root)
    first = folders(root, spark)
    newest = max((f"{root}/events/{n}" for n in os.listdir(f"{root}/events") if n.endswith(".parquet")), key=os.path.getmtime)
    os.remove(newest)
    same(followed(spark, root), at_once(spark, root))
    second = folders(root, spark)
    assert "measure_date=2024-01-25" in first and "measure_date=2024-01-25" not in second and not set(first.values()) & set(second.values())
    spark.read.parquet(f"{root}/supplier").where("s_suppkey > 2").withColumn("s_suppkey", F.col("s_suppkey") + 1).coalesce(1).write.parquet(f"{root}/supplier2")
    os.rename(f"{root}/supplier", f"{root}/before")
    os.rename(f"{root}/supplier2", f"{root}/supplier")
    same(followed(spark, root), at_once(spark, root))


def test_a_day_without_readings_any_more(spark, sources):
    events, root = sources
    table = maintained.LiveTable(spark, f"{root}/live")
    stations = A.as_stations(spark.read.parquet(f"{root}/supplier"))
    readings, snow = A.as_measurements(events), A.as_snow(events)
    table.refresh(stations, readings, snow)
    day = dt.date(2024, 1, 7)
    left = F.coalesce(F.col("ts").cast("date") != F.lit(day), F.lit(True))
    table.refresh(stations, A.as_measurements(events.where(left)), A.as_snow(events.where(left)), [day])
    assert table.read().where(F.col("measure_date") == F.lit(day)).isEmpty()
    same(table.read(), live(stations, A.as_measurements(events.where(left)), A.as_snow(events.where(left))))


def test_dates_of_the_panels_choose_folders(spark, sources):
    _, root = sources
    table = followed(spark, root)
    for frame in (panels.weather_trend(table, start="2024-01-03", end="2024-01-05"), panels.latest_map(table, "wind")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*measure_date#\d+ (>|=)", plan)
    assert len(rows(panels.weather_trend(table, start="2024-01-03", end="2024-01-05"))) == 3
