"""Projection and de-duplication of raw rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.dates import iso_day
from firnline.vocabulary import MEASUREMENT_NAMES, SNOW_NAMES

MEASUREMENT_COLUMNS = ["station_code", "measure_date", "TA_30MIN_MEAN", "VW_30MIN_MAX", "TSS_30MIN_MEAN", "TS0_30MIN_MEAN"]
SNOW_COLUMNS = ["station_code", "measure_date", "HS", "HN_1D"]


def renamed(rows: DataFrame, columns: list[str], names: Mapping[str, str]) -> DataFrame:
    """Keep some columns and rename them; names of absent columns are ignored."""
    return rows.select(*columns).withColumnsRenamed(dict(names))


def project_measurements(daily: DataFrame) -> DataFrame:
    """Daily measurements under the names of the live table."""
    return renamed(daily, MEASUREMENT_COLUMNS, MEASUREMENT_NAMES)


def project_snow(snow: DataFrame) -> DataFrame:
    return renamed(snow, SNOW_COLUMNS, SNOW_NAMES)


def with_constants(rows: DataFrame, **values) -> DataFrame:
    return rows.withColumns({name: F.lit(value) for name, value in values.items()})


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the earliest in arrival order.

    ``row_number() = 1`` lets Spark cut each key to one row in every map task, ahead
    of the shuffle, so a key with very many copies stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def iso_days(rows: DataFrame, column: str = "measure_date") -> DataFrame:
    return rows.withColumn(column, iso_day(F.col(column)))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def sorted_groups(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    key: Column = F.col(column)
    return distinct_values(rows, column).orderBy(key.desc() if descending else key.asc())
