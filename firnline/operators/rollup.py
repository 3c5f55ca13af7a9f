"""Daily roll-up and means per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.filters import present
from firnline.operators.medians import bracketed_median
from firnline.session import HOT_ROWS, broadcast_if_small, stored
from firnline.vocabulary import ROLLUP_MAXIMA, ROLLUP_MEANS, ROLLUP_MEDIANS


def circular_mean(direction: Column) -> Column:
    """Mean of angles in degrees (an option; the plain roll-up takes the arithmetic mean)."""
    angle = F.radians(direction)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))), F.lit(360.0))


def daily_rollup(
    rows: DataFrame,
    keys: list[str],
    first: str,
    medians: list[str] = ROLLUP_MEDIANS,
    means: list[str] = ROLLUP_MEANS,
    maxima: list[str] = ROLLUP_MAXIMA,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per key: earliest ``first``, medians, means and maxima; NULL keys drop out.

    One pass with partial aggregation. Groups are counted first: those above ``hot_rows``
    rows, if any, get their medians by the bracketed plan, since a median holds its group.
    """
    rows = present(rows, keys)
    plain = [F.min(first).alias(first)]
    plain += [F.avg(c).alias(c) for c in means] + [F.max(c).alias(c) for c in maxima]
    order = [*keys, first, *medians, *means, *maxima]
    if not medians:
        return rows.groupBy(*keys).agg(*plain).select(*order)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (hot_rows or HOT_ROWS)).select(*keys)
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*plain, *[F.median(c).alias(c) for c in medians]).select(*order)

    hot = broadcast_if_small(stored(hot, "hot-groups"))
    cold = rows.join(hot, keys, "left_anti").groupBy(*keys).agg(*plain, *[F.median(c).alias(c) for c in medians])
    heavy = rows.join(hot, keys, "left_semi")
    split = heavy.groupBy(*keys).agg(*plain)
    for column in medians:
        split = split.join(bracketed_median(heavy, keys, column), keys, "left")
    return cold.select(*order).unionByName(split.select(*order))


def means_per_day(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Mean of several measures per day in one pass."""
    return present(rows, [day]).groupBy(day).agg(*[F.avg(c).alias(c) for c in columns])


def scalar_stats(rows: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    return rows.agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value")
    )


def map_centre(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))


def latest_day(rows: DataFrame, day: str) -> DataFrame:
    return rows.agg(F.max(day).alias("latest_date"))


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))
