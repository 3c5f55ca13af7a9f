"""The daily stages and the historical pipeline from files to scores."""

import datetime as dt
import json
import random

import pytest

from firnline import schemas
from firnline.operators.clusters import RiskModel
from firnline.plans import history, live, panels
from firnline.sources import loaders
from firnline.vocabulary import FEATURES
from tests.conftest import rows


def test_five_stages(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "stations.csv").write_text(
        "\ufeffcode;station_name;lon;lat;elevation;country_code;type;canton_code;alpine_region\n"
        "A;Alpha;9.8;46.7;2558;CH;SNOW_FLAT;GR;Eastern Alps\nB;Beta;9.1;46.1;1900;CH;WIND;ZH;NONE\nC;Gamma;7.1;46.1;3100;CH;SNOW;VS;Southern Alps\n")

    def land(folder, name, records):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(records))
        return str(tmp_path / folder)

    def reading(code, stamp, temp, gust):
        return {"station_code": code, "measure_date": stamp, "TA_30MIN_MEAN": temp, "VW_30MIN_MAX": gust, "HS": 100.0}

    first = land("w0", "a.json", [reading("A", "2024-01-01T00:00:00Z", -4.0, 10.0), reading("A", "2024-01-01T00:30:00Z", -6.0, 14.0),
                                  reading("B", "2024-01-01T00:00:00Z", 1.0, 1.0), reading("X", "2024-01-01T00:00:00Z", 1.0, 1.0)])
    second = land("w1", "a.json", [reading("A", "2024-01-01T00:00:00Z", 99.0, 99.0), reading("C", "2024-01-02T00:00:00Z", -1.0, 8.0)])
    snow = land("s0", "a.json", [{"station_code": "A", "measure_date": "2024-01-01T06:00:00Z", "HS": 120.0, "HN_1D": 5.0},
                                 {"station_code": "C", "measure_date": "2024-01-02T06:00:00Z", "HS": 110.0, "HN_1D": None}])
    live.ingest(spark, first, f"{root}/weather", schemas.MEASUREMENT_RECORD, 0)
    live.ingest(spark, second, f"{root}/weather", schemas.MEASUREMENT_RECORD, 1)
    live.ingest(spark, snow, f"{root}/snow", schemas.SNOW_RECORD, 0)
    live.clean(spark, f"{root}/weather", f"{root}/weather_clean")
    live.clean(spark, f"{root}/snow", f"{root}/snow_clean")
    assert spark.read.parquet(f"{root}/weather_clean").count() == 5
    live.roll_up(spark, f"{root}/weather_clean", f"{root}/daily")
    live.build_live(spark, f"{root}/stations.csv", f"{root}/daily", f"{root}/snow_clean", f"{root}/live")
    table = spark.read.parquet(f"{root}/live")
    day = dt.date(2024, 1, 1)
    assert rows(table.select("code", "measure_date", "elevation_group", *FEATURES), "code") == [
        ("A", day, "3000", -5.0, 14.0, 120.0, 5.0), ("C", dt.date(2024, 1, 2), "4000", -1.0, 8.0, 110.0, None)]

    rng = random.Random(0)
    training = spark.createDataFrame([tuple(rng.gauss(0, 9) for _ in FEATURES) for _ in range(200)], ", ".join(f"{f} DOUBLE" for f in FEATURES))
    RiskModel.fit(training).save(spark, f"{root}/model")
    live.score(spark, f"{root}/model", f"{root}/live", f"{root}/scored")
    scored = spark.read.parquet(f"{root}/scored")
    assert scored.columns == schemas.PCA_LIVE.fieldNames() and [r.station_code for r in scored.collect()] == ["A"]


def test_history_to_training(spark):
    day = dt.date(2000, 1, 1)
    accidents = spark.createDataFrame(
        [(i, day, "GR" if i else "FL", "M", 46.0 + i / 1000, 9.0, 2000.0 + i if i else None, 0, 1, 0) for i in range(5)],
        "acc_id INT, date DATE, canton STRING, municipality STRING, start_zone_coordinates_latitude DOUBLE, "
        "start_zone_coordinates_longitude DOUBLE, start_zone_elevation DOUBLE, number_dead INT, number_caught INT, number_fully_buried INT")
    weather = spark.createDataFrame([(day, 46.0, 9.0, -3.0, 2.0, 8.0, -5.0, None)], schemas.HISTORY_WEATHER)
    snow = spark.createDataFrame([(day, 46.0, 9.0, 120.0, 4.0)],
                                 "measure_date DATE, imis_latitude DOUBLE, imis_longitude DOUBLE, snow_height_cm DOUBLE, new_snow_cm DOUBLE")
    got = history.training_rows(accidents, weather, snow).orderBy("acc_id").collect()
    assert got[0].start_zone_elevation == 2002.0 and got[0].alpine_region == "NONE" and got[1].alpine_region == "Eastern Alps"
    assert {tuple(r[f] for f in FEATURES) for r in got} == {(-3.0, 8.0, 120.0, 4.0)}
    assert got[0].snow_ground_temp_mean_stations is None and got[0].elevation_group == "3000"


def test_training_rows_join_each_history_once_and_sort_nothing(spark, small):
    """Neither the fill nor the weather join is repeated for the snow, and the order of the cleaned accidents, which the joins lose, is not made."""
    from firnline.plans import adapters

    accidents = history.clean_accidents(adapters.raw_accidents(spark, small))
    rows_ = history.training_rows(accidents, adapters.hist_weather(spark, small), adapters.hist_snow(spark, small))
    plan = rows_._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Join Inner" in line and "ASIN" in line for line in plan) == 2
    assert sum("Relation" in line and "l_shipdate" in line for line in plan) == 2
    assert not any("Sort [" in line for line in plan)


def test_raw_accidents_are_cut_to_nine_columns_since_1992(spark):
    frame = spark.createDataFrame([(dt.date(1991, 12, 31),), (dt.date(1998, 5, 1),), (dt.date(1992, 1, 1),)], "date DATE")
    raw = frame.selectExpr("date", *[f"NULL AS {c}" for c in schemas.ACCIDENTS_RAW.fieldNames() if c != "date"])
    got = history.clean_accidents(raw)
    assert got.columns == ["acc_id", *schemas.ACCIDENT_COLUMNS] and [r.date.year for r in got.collect()] == [1992, 1998]


def test_raw_file_to_training_outputs(spark, tmp_path):
    """From the landed file on; no column is added by hand."""
    names = schemas.ACCIDENTS_RAW.fieldNames()
    lines = [";".join(names)]
    for i in range(40):
        row = {"avalanche_id": i, "date": "2000-01-0" + str(1 + i % 5), "canton": "GR", "municipality": "M", "start_zone_coordinates_latitude": 46 + i / 5000,
               "start_zone_coordinates_longitude": 9.0, "start_zone_elevation": "" if i % 4 == 0 else 2000 + i, "number_dead": 0, "number_caught": 1, "number_fully_buried": 0}
        lines.append(";".join(str(row.get(n, "")) for n in names))
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    raw = loaders.load_raw_accidents(spark, str(tmp_path / "raw.csv"))
    days = [dt.date(2000, 1, d) for d in range(1, 6)]
    weather = spark.createDataFrame([(d, 46.0, 9.0, -3.0 * k, 2.0, 8.0 + k, -5.0, None) for k, d in enumerate(days)], schemas.HISTORY_WEATHER)
    snow = spark.createDataFrame([(d, 46.0, 9.0, 100.0 + 9 * k, 4.0 + k * k) for k, d in enumerate(days)],
                                 "measure_date DATE, imis_latitude DOUBLE, imis_longitude DOUBLE, snow_height_cm DOUBLE, new_snow_cm DOUBLE")
    rows_ = history.training_rows(history.clean_accidents(raw), weather, snow)
    model = history.run_training(rows_, str(tmp_path / "out"))
    read = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("clustered", "positions", "centres", "means")}
    assert read["clustered"].count() == 40 and read["positions"].columns == schemas.PCA_TRAINING.fieldNames()
    assert read["centres"].columns == schemas.CLUSTER_CENTRES.fieldNames() and read["centres"].count() == len(model.centres)
    assert sum(r["count"] for r in read["centres"].collect()) == 40 and {r["count"] for r in read["centres"].collect()} == {8}
    at = {r.cluster: (r.PCA1, r.PCA2) for r in read["centres"].collect()}
    for r in read["means"].collect():
        assert (r.PCA1, r.PCA2) == pytest.approx(at[r.k_cluster], abs=1e-6)


def test_future_months_are_empty_and_a_canton_groups_by_station(spark):
    scored = spark.createDataFrame([("A", "GR", dt.date(2024, 1, 1), 3)], "station_code STRING, canton_code STRING, measure_date DATE, k_cluster INT")
    assert panels.risk_matrix(scored, 2030, 3).isEmpty()
    assert panels.risk_matrix(scored, 2023, 3, canton="GR").columns[0] == "station_code"
    assert panels.risk_matrix(scored, 2023, 3, canton="None").columns[0] == "canton_code"


def test_canton_options_offer_every_listed_canton(spark):
    stations = spark.createDataFrame([("A", "GR"), ("B", "ZH"), ("C", "GR")], "code STRING, canton_code STRING")
    got = rows(panels.canton_options(stations, "Eastern Alps"))
    assert got == [("All Cantons", "None", 3), ("FL", "FL", 0), ("GL", "GL", 0), ("GR", "GR", 2), ("SG", "SG", 0)]
    assert rows(panels.canton_options(stations, None)) == [("All Cantons", "None", 3)]
    assert panels.canton_options(stations, "Entire Alpine Region").count() == 13


def test_panel_points_and_trends(spark):
    live = spark.createDataFrame([
        ("A", "A", 46.0, 9.0, "GR", dt.date(2024, 1, d), float(d), None) for d in range(1, 5)
    ] + [("B", "B", 46.5, 8.0, "ZH", dt.date(2024, 1, 4), 10.0, 2.0), ("Q", None, 47.0, 8.0, "GR", None, None, None)],
        "code STRING, station_code STRING, lat DOUBLE, lon DOUBLE, canton_code STRING, measure_date DATE, "
        "air_temp_mean_stations DOUBLE, wind_speed_max_stations DOUBLE")
    assert rows(panels.latest_map(live, "temperature"), "code") == [("A", 46.0, 9.0, 4.0), ("B", 46.5, 8.0, 10.0)]
    overall = rows(panels.trend(live, "temperature", window=3), "measure_date")
    assert [r[1:] for r in overall] == [(1.0, None), (2.0, None), (3.0, 2.0), (7.0, 4.0)]
    chosen = rows(panels.trend(live, "temperature", window=3, codes=["A"]), "measure_date")
    assert [r[2:] for r in chosen] == [(1.0, None), (2.0, None), (3.0, 2.0), (4.0, 3.0)]
    assert rows(panels.default_range(live)) == [(dt.date(2024, 1, 1), dt.date(2023, 12, 7), dt.date(2024, 1, 4))]
