"""Date and time expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from firnline.vocabulary import SEASON_MONTHS


def iso_day(stamp: Column) -> Column:
    """Day of an ISO timestamp text, from its first ten characters."""
    return F.to_date(F.substring(stamp, 1, 10))


def midnight_stamp(stamp: Column, zulu: bool = True) -> Column:
    """ISO text of midnight on the day of an ISO timestamp text."""
    return F.concat(F.substring(stamp, 1, 10), F.lit("T00:00:00Z" if zulu else "T00:00:00"))


def parse_ts(text: Column, fmt: str | None = None) -> Column:
    """Timestamp of a text; bad text is an error."""
    return F.to_timestamp(text, fmt) if fmt else F.to_timestamp(text)


def parse_ts_lenient(text: Column, fmt: str | None = None) -> Column:
    """Timestamp of a text; bad text gives NULL."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def day_text(day: Column) -> Column:
    """``05-Jan-2024``"""
    return F.date_format(day, "dd-MMM-yyyy")


def minute_text(stamp: Column) -> Column:
    """``2024-01-05-06:30``"""
    return F.date_format(stamp, "yyyy-MM-dd-HH:mm")


def season_month(index: int, first_year: int) -> tuple[int, int]:
    """(year, month) of a slider position in the winter that starts in ``first_year``."""
    month = SEASON_MONTHS[index]
    return (first_year if month >= SEASON_MONTHS[0] else first_year + 1), month


def month_span(year: int, month: int) -> tuple[dt.date, dt.date]:
    """First day of the month and first day of the next one."""
    return dt.date(year, month, 1), dt.date(year + month // 12, month % 12 + 1, 1)


def in_span(day: Column, span: tuple[dt.date, dt.date]) -> Column:
    return (day >= F.lit(span[0])) & (day < F.lit(span[1]))


def in_years(day: Column, years: Iterable[int]) -> Column:
    """Year membership written as date ranges, so that files and partitions can be skipped."""
    wanted = sorted(set(years))
    condition = F.lit(False)
    while wanted:
        first = last = wanted.pop(0)
        while wanted and wanted[0] == last + 1:
            last = wanted.pop(0)
        condition = condition | in_span(day, (dt.date(first, 1, 1), dt.date(last + 1, 1, 1)))
    return condition


def in_month(day: Column, month: int, year: int | None = None) -> Column:
    return F.month(day) == month if year is None else in_span(day, month_span(year, month))
