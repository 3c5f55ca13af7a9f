"""The live table kept by day, and brought up to date for the days whose sources have changed.

The panels ask for a day or a range of days. They read a versioned table partitioned by measure_date, so their
dates choose folders, and neither the roll-up nor the joins run again. A refresh recomputes the days
that new files of the sources touch, from all readings of those days, and replaces them in one step; readers see
the old days or the new ones. Stations without any measure have no day; they are the partition without one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators.cleaning import project_snow
from firnline.operators.enrich import described_stations, measured_stations, outer_weather_snow, silent_stations
from firnline.plans.live import daily_features
from firnline.session import stored
from firnline.sources.listing import file_status, fingerprints
from firnline.sources.versions import StaleSnapshot, VersionedTable

DAY = "measure_date"


def on_days(rows: DataFrame, day: str, days: Iterable[dt.date] | None) -> DataFrame:
    """Rows of some days and those without a day; all if days is None. The dates reach the scan."""
    if days is None:
        return rows
    return rows.where(F.col(day).isin(list(days)) | F.col(day).isNull())


class LiveTable:
    """Stations with daily weather and snow, below path."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, DAY)

    def read(self) -> DataFrame:
        return self.table.read()

    def refresh(self, stations: DataFrame, readings: DataFrame, snow: DataFrame, days: Iterable[dt.date] | None = None,
                notes: dict[str, str] | None = None) -> None:
        """Recompute some days, or everything if days is None (or nothing has been written).

        A day that has no rows any more is removed. stations must be those of the other days: after a change
        of stations refresh everything.
        """
        if self.table.snapshot() is None:
            days = None
        days = None if days is None else sorted(set(days) - {None})
        described = described_stations(stations)
        measures = outer_weather_snow(daily_features(on_days(readings, "date", days)), project_snow(on_days(snow, DAY, days)))
        new = stored(measured_stations(described, measures), "live-days")
        seen = new.select("station_code")
        touched = None
        if days is not None:
            touched = [*days, None]
            seen = seen.union(self.table.read(but=touched).select("station_code"))
        self.table.write(new.unionByName(silent_stations(described, seen), allowMissingColumns=True), touched, notes)


def follow(live: LiveTable, stations_path: str, readings_path: str, stations_of: Callable[[DataFrame], DataFrame],
           readings_of: Callable[[DataFrame], DataFrame], snow_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The live table after everything that has come to two Parquet tables is in it.

    What is in it is known from listings alone: one of the stations, one of the readings (kept beside the table, by
    version). Nothing changed: no data file is opened. New files of readings: their days are refreshed. Changed
    stations, or readings that were removed or written anew: everything is refreshed.
    """
    spark = live.table.spark
    now = file_status(spark, readings_path)
    marks = fingerprints(stations=file_status(spark, stations_path), readings=now)
    while True:
        state = live.table.snapshot()
        if state is not None and all(state.notes.get(k) == v for k, v in marks.items()):
            return live.table.read(state)
        readings = spark.read.parquet(readings_path)
        days, listing = None, f"{live.table.path}/listings/{marks['readings'].rsplit('|', 1)[1]}"
        now.write.mode("overwrite").parquet(listing)
        if state is not None and state.notes["stations"] == marks["stations"]:
            known, same = spark.read.schema(now.schema).parquet(state.notes["listing"]), ["path", "length", "modified"]
            if known.join(now, same, "left_anti").isEmpty():
                new = [r.path for r in now.join(known, same, "left_anti").select("path").collect()]  # files since the last refresh
                rows = spark.read.schema(readings.schema).parquet(*new)
                days = [r[0] for r in readings_of(rows).select("date").union(snow_of(rows).select(DAY)).distinct().collect()]  # calendar days
        try:
            live.refresh(stations_of(spark.read.parquet(stations_path)), readings_of(readings), snow_of(readings), days, {**marks, "listing": listing})
        except StaleSnapshot:  # another session has refreshed it meanwhile
            continue
