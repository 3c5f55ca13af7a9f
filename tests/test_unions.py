import datetime as dt

from firnline.operators import unions
from tests.conftest import rows


def test_union_comes_apart_again(spark):
    training = spark.createDataFrame([(1.0, "M")], "a DOUBLE, municipality STRING")
    live = spark.createDataFrame([(2.0, "S"), (1.0, "T")], "a DOUBLE, station STRING")
    both = unions.union_tagged(training=training, live=live)
    assert both.count() == 3
    assert rows(unions.part_of(both, "live").select("a", "station"), "a") == [(1.0, "T"), (2.0, "S")]
    assert rows(unions.part_of(both, "training").select("a", "municipality")) == [(1.0, "M")]


def test_layers(spark):
    training = spark.createDataFrame([(0.1, 0.2, 4), (0.3, 0.4, 9)], "PCA1 DOUBLE, PCA2 DOUBLE, k_cluster INT")
    live = spark.createDataFrame([(1.0, 2.0, 3, "GR", "A", None, dt.date(2024, 1, 1))],
                                 "PCA1 DOUBLE, PCA2 DOUBLE, k_cluster INT, canton_code STRING, station_code STRING, station_name STRING, measure_date DATE")
    got = unions.risk_layers(training, live, unions.stored_centres(spark))
    assert {(r.layer, r.colour) for r in got.collect()} == {
        ("training", "darkred"), ("training", "gray"), ("live", "black"), ("centre", "darkblue")}
    assert got.where("layer = 'centre'").count() == 5
    assert got.where("layer = 'live'").first().label is None, "a missing part leaves no label"
