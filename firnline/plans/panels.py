"""Queries behind the panels: parameters in, lazy DataFrame out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.dates import in_month, in_years, season_month
from firnline.functions.labels import matrix_colour, station_label, station_url
from firnline.operators.counts import risk_matrix as matrix_cells
from firnline.operators.filters import by_canton, by_date, by_date_range, by_members, by_region, latest_slice
from firnline.operators.moving import moving_average
from firnline.operators.rollup import means_per_day
from firnline.operators.unions import risk_layers
from firnline.vocabulary import ALL_CANTONS, NO_DATA, PANEL_MEASURES, PANEL_REGIONS, TREND_DAYS


def _label() -> F.Column:
    return station_label(F.col("canton_code"), F.col("code"), F.col("station_name"), F.col("elevation"))


def station_options(stations: DataFrame, region: str | None = None, canton: str | None = None) -> DataFrame:
    chosen = by_canton(by_region(stations, region), canton)
    return chosen.select(_label().alias("label"), F.col("code").alias("value"))


def canton_options(stations: DataFrame, region: str | None) -> DataFrame:
    """Every canton of a region below the entry for all of them, with the number of its stations.

    The cantons come from the fixed list, so one without stations is offered too.
    """
    listed = PANEL_REGIONS.get(region, []) if region else []
    canton = F.col("canton_code")
    counted = stations.agg(F.count("*").alias("every"), *[F.count_if(canton == c).alias(c) for c in listed])
    entries = [("All Cantons", ALL_CANTONS, "every"), *[(c, c, c) for c in listed]]
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(value).alias("value"), F.col(n).alias("stations"))
        for label, value, n in entries
    ])))


def station_overview(stations: DataFrame, region: str | None = None, canton: str | None = None,
                     codes: Iterable[str] | None = None) -> DataFrame:
    chosen = by_members(by_canton(by_region(stations, region), canton), "code", codes)
    return chosen.select("code", "lat", "lon", _label().alias("label"), station_url(F.col("code")).alias("url"))


def latest_map(live: DataFrame, measure: str) -> DataFrame:
    """Points of the newest day; the region, canton and station choices do not apply here."""
    return latest_slice(live, "measure_date").select("code", "lat", "lon", F.col(PANEL_MEASURES[measure]).alias("z"))


def _trend_rows(live, region, canton, codes, start, end) -> DataFrame:
    rows = by_date_range(live, "measure_date", start, end)
    return by_members(by_canton(by_region(rows, region), canton), "station_code", codes)


def weather_trend(live: DataFrame, region: str | None = None, canton: str | None = None,
                  codes: Iterable[str] | None = None, start: dt.date | str | None = None,
                  end: dt.date | str | None = None) -> DataFrame:
    """Mean of the four measures per day."""
    return means_per_day(_trend_rows(live, region, canton, codes, start, end), "measure_date", list(PANEL_MEASURES.values()))


def trend(live: DataFrame, measure: str, window: int = 7, region: str | None = None, canton: str | None = None,
          codes: Iterable[str] | None = None, start: dt.date | str | None = None, end: dt.date | str | None = None,
          per_station: bool | None = None) -> DataFrame:
    """One measure with its moving average: per chosen station, or of the mean over all."""
    column, codes = PANEL_MEASURES[measure], list(codes or [])
    rows = _trend_rows(live, region, canton, codes, start, end)
    if codes if per_station is None else per_station:
        named = rows.where(F.col("measure_date").isNotNull()).select("station_code", "measure_date", F.col(column).alias("value"))
        return moving_average(named, ["value"], window, ["measure_date"], ["station_code"])
    per_day = means_per_day(rows, "measure_date", [column]).withColumnRenamed(column, "value")
    return moving_average(per_day, ["value"], window, ["measure_date"])


def default_range(live: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    newest = F.max("measure_date")
    return live.agg(
        F.min("measure_date").alias("first_date"), F.date_sub(newest, days).alias("start_date"), newest.alias("end_date")
    )


def risk_scatter(training: DataFrame, scored: DataFrame, centres: DataFrame, day: dt.date | str | None = None) -> DataFrame:
    return risk_layers(training, by_date(scored, "measure_date", day), centres)


def risk_matrix(scored: DataFrame, first_year: int, month_index: int | None = None, region: str | None = None,
                canton: str | None = None, group: str | None = None, most_frequent: bool = False) -> DataFrame:
    """Mean cluster per canton and day (per station once a canton is chosen) with its colour class."""
    day = F.col("measure_date")
    if month_index is None:
        rows = scored.where(in_years(day, [first_year, first_year + 1]))
    else:
        year, month = season_month(month_index, first_year)
        rows = scored.where(in_month(day, month, year))
    rows = by_canton(by_region(rows, region), canton)
    group = group or ("station_code" if canton and canton != ALL_CANTONS else "canton_code")
    cells = matrix_cells(rows, group, most_frequent=most_frequent)
    return cells.withColumn("colour", matrix_colour(F.col("k_mean")))


def empty_marker(cells: DataFrame, text: str = NO_DATA) -> DataFrame:
    """One row with a message if a panel has nothing to show, otherwise none; a single row of the panel is looked for."""
    return cells.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(text).alias("message"))
