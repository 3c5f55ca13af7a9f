"""Row selection. Every optional choice follows one rule: nothing chosen means no filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.vocabulary import ALL_CANTONS, FEATURES, NO_REGION, PANEL_REGIONS, WHOLE_REGION


def latest_slice(rows: DataFrame, day: str) -> DataFrame:
    """Rows at the newest day. The day is a scalar subquery, so the scan is filtered by it."""
    newest = rows.select(F.max(day)).scalar()
    return rows.where(F.col(day) == newest)


def by_region(
    rows: DataFrame, region: str | None, column: str = "canton_code",
    regions: Mapping[str, list[str]] = PANEL_REGIONS,
) -> DataFrame:
    """Cantons of a region; the whole region keeps every row, also of cantons outside its list."""
    if not region or region == WHOLE_REGION:
        return rows
    return rows.where(F.col(column).isin(list(regions.get(region, []))))


def by_canton(rows: DataFrame, canton: str | None, column: str = "canton_code") -> DataFrame:
    return rows if not canton or canton == ALL_CANTONS else rows.where(F.col(column) == canton)


def by_members(rows: DataFrame, column: str, members: Iterable | None) -> DataFrame:
    """Station list, risk groups: membership, with an empty list meaning all."""
    chosen = list(members or [])
    return rows.where(F.col(column).isin(chosen)) if chosen else rows


def by_date_range(rows: DataFrame, day: str, start: dt.date | str | None, end: dt.date | str | None) -> DataFrame:
    """Both ends included; used only when both are given."""
    if not (start and end):
        return rows
    return rows.where(F.col(day).between(_day(start), _day(end)))


def by_date(rows: DataFrame, day: str, wanted: dt.date | str | None) -> DataFrame:
    """One day, or the newest one if none is given."""
    return rows.where(F.col(day) == _day(wanted)) if wanted else latest_slice(rows, day)


def since(rows: DataFrame, day: str, after: dt.date | str) -> DataFrame:
    """Strictly later than a day."""
    return rows.where(F.col(day) > _day(after))


def since_hyear(rows: DataFrame, after: str, column: str = "hyear") -> DataFrame:
    """Hydrological years are texts and compare as texts."""
    return rows.where(F.col(column) > F.lit(after))


def present(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in every column; single conditions, so that they reach the scan."""
    for column in columns:
        rows = rows.where(F.col(column).isNotNull())
    return rows


def complete(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return present(rows, columns or FEATURES)


def with_region(rows: DataFrame, column: str = "alpine_region") -> DataFrame:
    return rows.where(F.col(column) != NO_REGION)


def split_missing(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a value, rows without)"""
    return rows.where(F.col(column).isNotNull()), rows.where(F.col(column).isNull())


def _day(value: dt.date | str) -> Column:
    return F.lit(value).cast("date")
