import datetime as dt

from pyspark.sql import functions as F

from firnline.operators import cleaning, filters
from tests.conftest import rows


def test_first_arrival_wins(spark):
    frame = spark.createDataFrame([(3, "A", "t1", 9.0), (1, "A", "t1", 1.0), (2, "A", "t2", 2.0), (4, "B", "t1", None)],
                                  "nr INT, station STRING, t STRING, v DOUBLE")
    first = cleaning.keep_first(frame, ["station", "t"], ["nr"])
    assert rows(first, "nr") == [(1, "A", "t1", 1.0), (2, "A", "t2", 2.0), (4, "B", "t1", None)]
    assert rows(cleaning.keep_first(first, ["station", "t"], ["nr"]), "nr") == rows(first, "nr")


def test_hot_key_is_cut_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("nr"))
    plan = cleaning.keep_first(frame, ["k"], ["nr"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit"), "one before and one after the exchange"


def test_renames_ignore_absent_columns(spark):
    frame = spark.createDataFrame([("A", "2024-01-01", 1.0, 2.0, 3.0, 4.0)],
                                  ["station_code", "measure_date", "TA_30MIN_MEAN", "VW_30MIN_MAX", "TSS_30MIN_MEAN", "TS0_30MIN_MEAN"])
    assert cleaning.project_measurements(frame).columns == [
        "station_code", "measure_date", "air_temp_mean_stations", "wind_speed_max_stations",
        "snow_surf_temp_mean_stations", "snow_ground_temp_mean_stations"]


def _cantons(spark):
    return spark.createDataFrame([("GR",), ("ZH",), ("VS",), (None,)], "canton_code STRING")


def test_empty_choices_mean_no_filter(spark):
    frame = _cantons(spark)
    assert filters.by_region(frame, None).count() == 4
    assert filters.by_region(frame, "Entire Alpine Region").count() == 4, "cantons outside the list stay"
    assert rows(filters.by_region(frame, "Eastern Alps")) == [("GR",)]
    assert filters.by_region(frame, "Nowhere").count() == 0
    assert filters.by_canton(frame, "None").count() == 4
    assert rows(filters.by_canton(frame, "ZH")) == [("ZH",)]
    assert filters.by_members(frame, "canton_code", []).count() == 4
    assert filters.by_members(frame, "canton_code", ["VS", "ZH"]).count() == 2


def test_date_range_needs_both_ends(spark):
    frame = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3)], "d DATE")
    assert filters.by_date_range(frame, "d", "2024-01-02", None).count() == 3
    assert filters.by_date_range(frame, "d", "2024-01-02", "2024-01-03").count() == 2


def test_latest_slice_skips_null_dates(spark):
    frame = spark.createDataFrame([(1, None), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 2)), (4, dt.date(2023, 1, 1))], "i INT, d DATE")
    assert sorted(r.i for r in filters.latest_slice(frame, "d").collect()) == [2, 3]
    assert [r.i for r in filters.by_date(frame, "d", "2023-01-01").collect()] == [4]


def test_since_is_strict_and_hyear_is_text(spark):
    frame = spark.createDataFrame([(dt.date(1997, 12, 31), "2022"), (dt.date(1998, 1, 1), "2022/23")], "d DATE, hyear STRING")
    assert filters.since(frame, "d", "1997-12-31").count() == 1
    assert filters.since_hyear(frame, "2022").count() == 1
