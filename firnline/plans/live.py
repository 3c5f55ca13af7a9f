"""The daily pipeline: clean, roll up, join, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.dates import iso_day
from firnline.operators.cleaning import iso_days, keep_first, project_measurements, project_snow
from firnline.operators.clusters import RiskModel
from firnline.operators.enrich import live_table
from firnline.operators.filters import present
from firnline.operators.rollup import daily_rollup
from firnline.sources.loaders import load_stations
from firnline.sources.readers import read_json_array
from firnline.sources.sinks import append_batch, with_sequence, write_result

ARRIVAL = ["batch", "file", "nr"]
READING = ["station_code", "measure_date"]


def daily_measurements(readings: DataFrame) -> DataFrame:
    """Readings (``date`` and ``measure_date`` given) to one row per station and day."""
    return daily_rollup(readings, ["date", "station_code"], "measure_date")


def daily_features(readings: DataFrame) -> DataFrame:
    """Only the four measures of the live table, under their names there.

    The median and the other means are never computed, and their columns never read.
    """
    daily = present(readings, ["station_code", "date"]).groupBy("station_code", "date").agg(
        F.avg("TA_30MIN_MEAN").alias("TA_30MIN_MEAN"), F.max("VW_30MIN_MAX").alias("VW_30MIN_MAX"),
        F.avg("TSS_30MIN_MEAN").alias("TSS_30MIN_MEAN"), F.avg("TS0_30MIN_MEAN").alias("TS0_30MIN_MEAN"),
    )
    return project_measurements(daily.withColumnRenamed("date", "measure_date"))


def live(stations: DataFrame, readings: DataFrame, snow: DataFrame) -> DataFrame:
    """Stations, daily weather and daily snow in one table."""
    return live_table(stations, daily_features(readings), project_snow(snow))


SCORED_COLUMNS = [
    "PCA1", "PCA2", "k_cluster", "station_code", "station_name", "canton_code", "measure_date", "alpine_region",
    "elevation_group",
]


def score_live(model: RiskModel, live_rows: DataFrame) -> DataFrame:
    return model.score(live_rows).select(*SCORED_COLUMNS)


# ---- the five stages as jobs; Parquet between them, CSV and JSON only at the edge ----

def ingest(spark: SparkSession, landed: str, table: str, schema, batch_no: int) -> None:
    """Stage 1: landed JSON arrays are appended with their arrival order."""
    batch = with_sequence(read_json_array(spark, landed, schema, position=True), batch_no)
    append_batch(batch.withColumn("date", iso_day(F.col("measure_date"))), table, ["date"])


def clean(spark: SparkSession, table: str, cleaned: str) -> None:
    """Stage 2: first arrival per (station, time), sorted inside each day's files."""
    rows = keep_first(spark.read.parquet(table), READING, ARRIVAL)
    # AQE gathers small days into one task and splits days that are too large for one
    ordered = rows.hint("rebalance", "date").sortWithinPartitions("date", *READING)
    write_result(ordered, cleaned, ["date"])


def roll_up(spark: SparkSession, cleaned: str, daily: str) -> None:
    """Stage 3."""
    write_result(daily_measurements(spark.read.parquet(cleaned)), daily)


def build_live(spark: SparkSession, stations_csv: str, daily: str, snow: str, target: str) -> None:
    """Stage 4."""
    stations = load_stations(spark, stations_csv)
    weather = project_measurements(iso_days(spark.read.parquet(daily)))
    readings = project_snow(iso_days(spark.read.parquet(snow)))
    write_result(live_table(stations, weather, readings), target)


def score(spark: SparkSession, model_path: str, live_path: str, target: str) -> None:
    """Stage 5, with the stored model instead of a daily refit."""
    write_result(score_live(RiskModel.load(spark, model_path), spark.read.parquet(live_path)), target)
