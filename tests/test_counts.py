import datetime as dt

import pytest

from firnline import vocabulary as V
from firnline.operators import counts
from tests.conftest import rows


def _accidents(spark):
    data = [(dt.date(1998, 1, 5), -0.5, 3, "West"), (dt.date(1998, 1, 6), -5.0, 1, "West"), (dt.date(1998, 12, 1), 0.0, 3, "East"),
            (dt.date(1999, 2, 1), 1.0, 0, "West"), (dt.date(1998, 7, 1), None, None, None)]
    return spark.createDataFrame(data, "date DATE, air_temp_mean_stations DOUBLE, k_cluster INT, alpine_region STRING")


def test_heatmap_has_all_months_and_no_null_class(spark):
    got = counts.accident_heatmap(_accidents(spark), 1998, "temperature")
    assert got.columns == ["bin", *[f"m{m:02d}" for m in range(1, 13)]]
    assert [(r.bin, r.m01, r.m07, r.m12) for r in got.orderBy("bin").collect()] == [(-5, 2, 0, 0), (0, 0, 0, 1)]
    assert counts.accident_heatmap(_accidents(spark), 2030, "temperature").isEmpty()


def test_region_counts_and_their_maximum(spark):
    got = counts.accidents_by_region(_accidents(spark))
    assert rows(got, "alpine_region", "year") == [
        ("East", 1998, 0, 0, 0, 1, 0, 0), ("West", 1998, 0, 1, 0, 1, 0, 0), ("West", 1999, 1, 0, 0, 0, 0, 0)]
    more = spark.createDataFrame([("West", "1999-01-01", 7), ("West", "2005-01-01", None)], "alpine_region STRING, date STRING, k_cluster INT")
    more = counts.accidents_by_region(more.withColumn("date", more.date.cast("date")))
    assert rows(more, "year") == [("West", 1999, 0, 0, 0, 0, 0, 1)]  # further labels count apart, missing ones not at all
    assert counts.max_yearly_accidents(_accidents(spark)).first()[0] == 2


def test_months(spark):
    assert rows(counts.accidents_by_month(_accidents(spark)), "month") == [(1, 1998, 2), (2, 1999, 1), (12, 1998, 1)]


def test_shares_match_the_published_table(spark):
    data = [(k,) for k, n in V.CLUSTER_COUNTS.items() for _ in range(n)]
    got = {r.k_cluster: r.percentage for r in counts.cluster_share(spark.createDataFrame(data, "k_cluster INT")).collect()}
    assert sum(got.values()) == pytest.approx(100)
    assert got[0] == pytest.approx(18.63013698630137) and got[4] == pytest.approx(11.428571428571429)


def test_normalised_means_use_row_extremes(spark):
    frame = spark.createDataFrame([(0, 0.0, 5.0), (0, 4.0, 5.0), (1, 10.0, 5.0), (None, -10.0, 5.0)], "k_cluster INT, a DOUBLE, b DOUBLE")
    assert rows(counts.normalised_cluster_means(frame, ["a", "b"]), "k_cluster") == [(0, 0.6, 0.0), (1, 1.0, 0.0)]


def test_risk_matrix_mean_and_mode(spark):
    day = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([("GR", day, 0), ("GR", day, 3), ("GR", day, 3), (None, day, 1), ("VS", day, 4)],
                                  "canton_code STRING, measure_date DATE, k_cluster INT")
    assert rows(counts.risk_matrix(frame, "canton_code"), "canton_code") == [("GR", day, 2.0), ("VS", day, 4.0)]
    assert rows(counts.risk_matrix(frame, "canton_code", most_frequent=True), "canton_code") == [("GR", day, 3.0), ("VS", day, 4.0)]
