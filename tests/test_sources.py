import os

import pytest

from firnline import schemas
from firnline.session import shared_folder
from firnline.sources import listing, loaders, readers, sinks
from tests.conftest import rows


def test_stations_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("\ufeffcode;station_name;lon;lat;elevation;country_code;type;canton_code;alpine_region\n"
                    "DAV2;Hang;9.8;46.7;2558;CH;SNOW_FLAT;GR;Eastern Alps\n001;Zahl;9.1;46.1;1;CH;WIND;GR;Eastern Alps\n", encoding="utf-8")
    got = readers.read_csv(spark, str(path), schemas.STATIONS, sep=";")
    assert [r.code for r in got.collect()] == ["DAV2", "001"], "keys stay texts"
    assert got.schema == schemas.STATIONS


def test_nan_in_files_is_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cluster,character,risk,air_temp_mean_stations,wind_speed_max_stations,snow_height_mean_stations,"
                                    "new_snow_mean_stations,count,percentage,PCA1,PCA2\n0,x,y,NaN,,1.5,2.5,3,4.5,0.1,0.2\n")
    got = readers.read_csv(spark, str(tmp_path), schemas.CLUSTER_CENTRES).first()
    assert (got.air_temp_mean_stations, got.wind_speed_max_stations, got.snow_height_mean_stations) == (None, None, 1.5)


def test_quoted_keys_are_trimmed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('PCA1,PCA2,k_cluster,station_code,station_name,canton_code,measure_date,alpine_region,elevation_group\n'
                                    '1.0,2.0,3," \tDAV2 ","a, b",GR,2024-01-02,Eastern Alps,3000\n')
    got = readers.trim_key(readers.read_csv(spark, str(tmp_path), schemas.PCA_LIVE), "station_code").first()
    assert (got.station_code, got.station_name, got.k_cluster) == ("DAV2", "a, b", 3)


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"station_code": "A", "measure_date": "2024-01-01T00:30:00Z", "HS": 12.5},\n {"station_code": "B"}]')
    got = readers.read_json_array(spark, str(tmp_path), schemas.MEASUREMENT_RECORD)
    assert rows(got.select("station_code", "HS"), "station_code") == [("A", 12.5), ("B", None)]


def test_append_keeps_arrival_order(spark, tmp_path):
    for number, value in enumerate(["1.0", "2.0"]):
        (tmp_path / f"land{number}").mkdir()
        (tmp_path / f"land{number}" / "a.json").write_text(f'[{{"station_code": "A", "measure_date": "2024-01-01", "HS": {value}}}]')
        batch = sinks.with_sequence(readers.read_json_array(spark, str(tmp_path / f"land{number}"), schemas.SNOW_RECORD, position=True), number)
        sinks.append_batch(batch, str(tmp_path / "table"), ["measure_date"])
    assert [r.HS for r in spark.read.parquet(str(tmp_path / "table")).orderBy("batch", "file", "nr").collect()] == [1.0, 2.0]


def test_freshness_from_file_times(spark, tmp_path):
    for name, hour in (("a", 3), ("b", 17), ("c", 9)):
        (tmp_path / "t" / f"day={name}").mkdir(parents=True)
        file = tmp_path / "t" / f"day={name}" / "part-0.parquet"
        file.write_bytes(b"no parquet at all")  # opening it would be an error
        os.utime(file, (1_700_000_000 + hour * 60,) * 2)
    files = listing.file_status(spark, str(tmp_path / "t"))
    assert files.count() == 3 and {r.length for r in files.collect()} == {17}
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert listing.freshness(files).first().last_update == "2023-11-14-22:30"
    first = listing.fingerprints(t=files, u=files.limit(0))
    assert first["u"] == "0|0|0" and first == listing.fingerprints(t=files, u=files.limit(0))
    os.utime(file, (1_700_000_000,) * 2)
    assert listing.fingerprints(t=listing.file_status(spark, str(tmp_path / "t")))["t"] != first["t"]


def test_create_table_replaces(spark, tmp_path):
    for n in (3, 5):
        got = sinks.create_table_as(spark.range(n), "firnline_test_table", str(tmp_path / f"ctas{n}"))
        assert got.count() == n == spark.table("firnline_test_table").count()
    spark.sql("DROP TABLE firnline_test_table")


def test_preview(spark):
    assert [r.id for r in sinks.preview(spark.range(10), ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_shared_folder_follows_the_session(spark):
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    root = set_ or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark, "x").startswith(root.rstrip("/")) and shared_folder(spark, "x") != shared_folder(spark, "x")


def test_other_names_of_components(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k_cluster,PC1,PC2\n2,1.0,3.0\n")
    got = loaders.load_cluster_means(spark, str(tmp_path / "a.csv"))
    assert got.schema == schemas.CLUSTER_MEANS and tuple(got.first()) == (2, 1.0, 3.0)
    (tmp_path / "b.csv").write_text("PC1,PC2,k_cluster\n1.0,3.0,2\n")
    got = loaders.load_pca_training(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["PCA1", "PCA2", "k_cluster"] and tuple(got.first()) == (1.0, 3.0, 2)


def test_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PCA1,k_cluster,PCA2\n1.0,2,3.0\n")
    with pytest.raises(Exception):
        loaders.load_cluster_means(spark, str(tmp_path / "a.csv")).collect()


def test_schemas_list_every_measure():
    assert schemas.MEASUREMENTS.fieldNames() == ["nr", "station_code", "measure_date", *schemas.MEASURES]
    assert len(schemas.MEASURES) == 13
