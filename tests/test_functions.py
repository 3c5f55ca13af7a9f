import datetime as dt

import pytest
from pyspark.sql import functions as F

from firnline.functions import dates, labels, places
from firnline.functions.numbers import floor_bin, min_max, nan_to_null
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_elevation_classes_are_closed_on_the_right(spark):
    frame = spark.createDataFrame([(v,) for v in (None, -1, 0, 1, 2000, 2001, 3000, 4000, 5000, 5001)], "e INT")
    got = [r[0] for r in frame.select(places.elevation_group(F.col("e"))).collect()]
    assert got == [None, None, None, "2000", "2000", "3000", "3000", "4000", "5000", None]


def test_region_maps_differ_in_one_canton(spark):
    frame = spark.createDataFrame([("FL",), ("GR",), ("VS",), ("ZH",), (None,)], "c STRING")
    got = rows(frame.select(places.alpine_region_live(F.col("c")), places.alpine_region_hist(F.col("c"))))
    assert got == [("Eastern Alps", "NONE"), ("Eastern Alps", "Eastern Alps"), ("Southern Alps", "Southern Alps"),
                   ("NONE", "NONE"), ("NONE", "NONE")]
    ids = spark.createDataFrame([("Western Alps",), ("Central Alps",), ("Southern Alps",), ("Eastern Alps",), ("NONE",)], "r STRING")
    assert [r[0] for r in ids.select(places.region_id(F.col("r"))).collect()] == [1, 2, 3, 4, 0]


def test_haversine(spark):
    km = places.haversine_km(F.lit(46.0), F.lit(9.0), F.lit(47.0), F.lit(9.0))
    assert one(spark, km) == pytest.approx(111.2298, abs=1e-3)
    opposite = places.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert one(spark, opposite) == pytest.approx(6373.0 * 3.141592653589793)


def test_floor_bins_go_down_below_zero(spark):
    frame = spark.createDataFrame([(-0.5,), (-5.0,), (0.0,), (4.9,), (None,)], "v DOUBLE")
    assert [r[0] for r in frame.select(floor_bin(F.col("v"), 5)).collect()] == [-5, -5, 0, 0, None]


def test_min_max_of_equal_bounds_is_zero(spark):
    assert one(spark, min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0
    assert one(spark, min_max(F.lit(3.0), F.lit(2.0), F.lit(6.0))) == 0.25


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in frame.select(nan_to_null(F.col("v"))).collect()] == [None, 1.0, None]


def test_labels(spark):
    frame = spark.createDataFrame([("GR", "DAV2", "Hang", 2558.9), (None, None, None, None)], "c STRING, k STRING, n STRING, e DOUBLE")
    part = [F.col(x) for x in "ckne"]
    assert [r[0] for r in frame.select(labels.station_label(*part)).collect()] == ["GR - DAV2 - Hang - 2558 m", " -  -  - 0 m"]
    assert [r[0] for r in frame.select(labels.live_label(*part[:3])).collect()] == ["GR - DAV2 - Hang", None]
    assert one(spark, labels.trimmed(F.lit("\t AB C\n "))) == "AB C"


def test_colours_and_truncated_means(spark):
    frame = spark.createDataFrame([(0.9,), (1.0,), (4.0,), (None,), (7.0,)], "m DOUBLE")
    got = [r[0] for r in frame.select(labels.matrix_colour(F.col("m"))).collect()]
    assert got == ["orange", "lightcoral", "darkred", "white", "white"]
    assert one(spark, labels.cluster_colour(F.lit(9))) == "gray"
    assert one(spark, labels.cluster_risk(F.lit(3))) == "1 - very low"


def test_stamps(spark):
    assert one(spark, dates.iso_day(F.lit("2024-01-05T06:30:00Z"))) == dt.date(2024, 1, 5)
    assert one(spark, dates.midnight_stamp(F.lit("2024-01-05T06:30:00Z"))) == "2024-01-05T00:00:00Z"
    assert one(spark, dates.midnight_stamp(F.lit("2024-01-05T06:30:00Z"), zulu=False)) == "2024-01-05T00:00:00"
    assert one(spark, dates.day_text(F.lit("2024-01-05").cast("date"))) == "05-Jan-2024"
    assert one(spark, dates.minute_text(F.lit("2024-01-05 06:30:00").cast("timestamp"))) == "2024-01-05-06:30"


def test_bad_dates_raise_or_become_null(spark):
    assert one(spark, dates.parse_ts_lenient(F.lit("no date"))) is None
    assert one(spark, dates.parse_ts_lenient(F.lit("05.10.2024"), "dd.MM.yyyy")) == dt.datetime(2024, 10, 5)
    with pytest.raises(Exception):
        one(spark, dates.parse_ts(F.lit("no date")))


def test_season_months_and_year_ranges(spark):
    assert [dates.season_month(i, 2024) for i in range(7)] == [
        (2024, 10), (2024, 11), (2024, 12), (2025, 1), (2025, 2), (2025, 3), (2025, 4)]
    assert dates.month_span(2024, 12) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    frame = spark.createDataFrame([(dt.date(y, 12, 31),) for y in range(1995, 2002)], "d DATE")
    kept = frame.where(dates.in_years(F.col("d"), [1999, 1996, 1997])).collect()
    assert [r.d.year for r in kept] == [1996, 1997, 1999]
    assert frame.where(dates.in_years(F.col("d"), [])).isEmpty()
