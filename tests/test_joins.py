import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from firnline.operators import enrich
from tests.conftest import rows

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
W = "station_code STRING, measure_date DATE, air_temp_mean_stations DOUBLE, wind_speed_max_stations DOUBLE"
S = "station_code STRING, measure_date DATE, snow_height_mean_stations DOUBLE, new_snow_mean_stations DOUBLE"
ST = "code STRING, station_name STRING, lon DOUBLE, lat DOUBLE, elevation INT, country_code STRING, type STRING, canton_code STRING, alpine_region STRING"


def _weather(spark):
    return spark.createDataFrame([("A", D1, 1.0, 2.0), ("X", D1, 3.0, 4.0), ("F", D1, 5.0, 6.0), ("Z", D1, 7.0, 8.0)], W)


def _snow(spark):
    return spark.createDataFrame([("A", D1, 10.0, 1.0), ("A", D2, 11.0, None), ("A", D2, 12.0, 3.0)], S)


def _stations(spark):
    return spark.createDataFrame([
        ("A", "a", 9.0, 46.0, 2000, "CH", "SNOW", "GR", None), ("F", "f", 9.0, 46.0, 2001, "LI", "SNOW", "FL", None),
        ("Z", "z", 9.0, 46.0, 500, "CH", "SNOW", "ZH", None), ("Q", "q", 9.0, 46.0, 6000, "CH", "WIND", "VS", None)], ST)


def test_outer_join_keeps_both_sides_and_double_readings(spark):
    got = rows(enrich.outer_weather_snow(_weather(spark), _snow(spark)), "station_code", "measure_date", "snow_height_mean_stations")
    assert [(r[0], r[1]) for r in got] == [("A", D1), ("A", D2), ("A", D2), ("F", D1), ("X", D1), ("Z", D1)]
    single = enrich.outer_weather_snow(_weather(spark), _snow(spark), one_snow_row_per_day=True)
    assert single.count() == 5


def _sql_outer(single, many):
    """The same join by DuckDB."""
    con = duckdb.connect()
    con.execute("CREATE TABLE w(station_code VARCHAR, measure_date DATE, a DOUBLE, b DOUBLE)")
    con.execute("CREATE TABLE s(station_code VARCHAR, measure_date DATE, c DOUBLE, d DOUBLE)")
    for name, some in (("w", single), ("s", many)):
        if some:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", some)
    return sorted(con.execute("SELECT coalesce(w.station_code, s.station_code), coalesce(w.measure_date, s.measure_date), a, b, c, d"
                              " FROM w FULL JOIN s ON w.station_code = s.station_code AND w.measure_date = s.measure_date").fetchall(), key=str)


HOT = [("A", D1, float(i % 7), None) for i in range(60)] + [("A", D2, 1.0, 1.0)] * 40 + [(None, D1, float(i), 2.0) for i in range(30)] + [("N", D2, float(i), 0.0) for i in range(25)]


@pytest.mark.parametrize("many", [[], [("A", D1, 1.0, None), ("B", D2, 2.0, 3.0)], HOT, [*HOT, ("F", D1, 9.0, 9.0), ("S", None, 1.0, None), ("X", D1, None, None)]])
@pytest.mark.parametrize("single", [[], [("A", D1, 1.0, 2.0), ("A", D2, None, None), ("F", D1, 5.0, 6.0), ("Z", D2, 7.0, 8.0), (None, D1, 3.0, 3.0), ("X", None, 1.0, 1.0)]])
@pytest.mark.parametrize("hot_rows", [4, 1000])
def test_hot_keys_of_an_outer_join(spark, single, many, hot_rows):
    weather, snow = spark.createDataFrame(single, W), spark.createDataFrame(many, S)
    got = enrich.salted_outer(weather, snow, enrich.KEYS, hot_rows)
    assert got.columns == [*enrich.KEYS, *weather.columns[2:], *snow.columns[2:]]
    assert sorted(map(tuple, got.collect()), key=str) == _sql_outer(single, many)


def test_a_hot_key_meets_in_many_tasks(spark):
    """A third of all rows under one key: no join partition gets more than a small part of them."""
    snow = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("S"), "id")).alias("station_code"),
                                      F.lit(D1).alias("measure_date"), F.col("id").cast("double").alias("snow_height_mean_stations"))
    weather = spark.createDataFrame([("A", D1, 1.0, 2.0), ("B", D1, 1.0, 2.0)], W)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = enrich.salted_outer(weather, snow, enrich.KEYS, 500)
        parts = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(parts) == 30_001 and len(parts) == 16 and max(parts) < 6_000


def test_live_table_keeps_silent_stations_and_drops_rows_without_region(spark):
    live = enrich.live_table(_stations(spark), _weather(spark), _snow(spark))
    got = rows(live.select("code", "station_code", "measure_date", "alpine_region", "region_id", "elevation_group"), "code", "measure_date")
    assert got == [
        ("A", "A", D1, "Eastern Alps", 4, "2000"), ("A", "A", D2, "Eastern Alps", 4, "2000"), ("A", "A", D2, "Eastern Alps", 4, "2000"),
        ("F", "F", D1, "Eastern Alps", 4, "3000"), ("Q", None, None, "Southern Alps", 3, None)]


def test_live_table_does_not_shuffle_measures_by_station(spark, tmp_path):
    _stations(spark).write.parquet(f"{tmp_path}/stations")
    stations = spark.read.parquet(f"{tmp_path}/stations")
    joined = enrich.with_stations(stations, _weather(spark))._jdf.queryExecution().executedPlan().toString()
    measures_side = joined[:joined.index("LeftAnti")]
    assert "BroadcastHashJoin" in measures_side and "Exchange hashpartitioning(station_code" not in measures_side


def test_beyond_the_size_check_the_join_shuffles_and_agrees(spark, monkeypatch):
    broadcast = rows(enrich.with_stations(_stations(spark), _weather(spark)), "code")
    monkeypatch.setattr(enrich, "broadcast_if_small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(enrich.with_stations(_stations(spark), _weather(spark)), "code") == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snow_enriched_is_an_inner_join(spark):
    snow = spark.createDataFrame([("A", D1, "2024", 1.0, 2.0), ("X", D1, "2024", 1.0, 2.0)],
                                 "station_code STRING, measure_date DATE, hyear STRING, HS DOUBLE, HN_1D DOUBLE")
    got = enrich.snow_enriched(snow, _stations(spark))
    assert rows(got.select("station_code", "canton", "imis_type", "snow_height_cm")) == [("A", "GR", "SNOW", 1.0)]


def test_risk_names(spark):
    frame = spark.createDataFrame([(0,), (4,), (9,), (None,)], "k_cluster INT")
    got = [tuple(r) for r in enrich.with_risk(frame).select("risk_group", "colour").collect()]
    assert got == [("3 - moderate", "orange"), ("5 - high", "darkred"), (None, "gray"), (None, "gray")]


def test_null_keys_match_nothing(spark):
    weather = spark.createDataFrame([(None, D1, 1.0, 2.0)], W)
    snow = spark.createDataFrame([(None, D1, 1.0, 2.0)], S)
    assert enrich.outer_weather_snow(weather, snow).count() == 2
    assert enrich.with_stations(_stations(spark), weather).where(F.col("measure_date").isNotNull()).isEmpty()
