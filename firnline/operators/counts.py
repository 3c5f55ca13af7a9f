"""Counts laid out as tables: month columns, cluster columns, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.dates import in_years
from firnline.functions.numbers import floor_bin, min_max
from firnline.operators.filters import present
from firnline.vocabulary import HEATMAP_FEATURES, WINTER_MONTHS


def spread_counts(
    rows: DataFrame, keys: list[str], column: Column, values: list[int], prefix: str, other: str | None = None,
) -> DataFrame:
    """Count per key and value, one output column per value, 0 where there is none; other names a column for all further values.

    The values are known, so one aggregation with conditional counts does the work of
    group, pivot and fill.
    """
    width = len(str(max(values)))
    return present(rows, keys).groupBy(*keys).agg(
        *[F.count_if(column == v).alias(f"{prefix}{v:0{width}d}") for v in values],
        *([F.count_if(~column.isin(values)).alias(other)] if other else []),
    )


def accident_heatmap(accidents: DataFrame, year: int, feature: str) -> DataFrame:
    """Accidents per (value class, month) of one year, months 1 to 12 as columns."""
    column, width = HEATMAP_FEATURES[feature]
    rows = accidents.where(in_years(F.col("date"), [year]))
    rows = rows.select(floor_bin(F.col(column), width).cast("bigint").alias("bin"), F.month("date").alias("month"))
    return spread_counts(rows, ["bin"], F.col("month"), list(range(1, 13)), "m")


def accidents_by_region(accidents: DataFrame, clusters: int = 5) -> DataFrame:
    """Accidents per (region, year), one column per cluster and one for any further label; unlabelled accidents do not count."""
    rows = present(accidents, ["k_cluster"]).select("alpine_region", F.year("date").alias("year"), "k_cluster")
    return spread_counts(rows, ["alpine_region", "year"], F.col("k_cluster"), list(range(clusters)), "c", "other")


def max_yearly_accidents(accidents: DataFrame) -> DataFrame:
    rows = present(accidents, ["alpine_region", "date", "k_cluster"]).select("alpine_region", F.year("date").alias("year"))
    return rows.groupBy("alpine_region", "year").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_accidents"))


def accidents_by_month(accidents: DataFrame, months: list[int] = WINTER_MONTHS) -> DataFrame:
    """Accidents per winter month and year."""
    rows = accidents.select(F.month("date").alias("month"), F.year("date").alias("year"))
    return rows.where(F.col("month").isin(months)).groupBy("month", "year").agg(F.count("*").alias("n"))


def risk_matrix(scored: DataFrame, group: str, day: str = "measure_date", most_frequent: bool = False) -> DataFrame:
    """Mean cluster label per (group, day); optionally the most frequent label instead."""
    label = F.mode("k_cluster", True).cast("double") if most_frequent else F.avg("k_cluster")
    return present(scored, [group, day]).groupBy(group, day).agg(label.alias("k_mean"))


def cluster_share(rows: DataFrame, cluster: str = "k_cluster") -> DataFrame:
    """Rows and percentage per cluster; the window runs over one row per cluster."""
    counts = present(rows, [cluster]).groupBy(cluster).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def cluster_means(rows: DataFrame, columns: list[str], cluster: str = "k_cluster") -> DataFrame:
    return present(rows, [cluster]).groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


def normalised_cluster_means(rows: DataFrame, columns: list[str], cluster: str = "k_cluster") -> DataFrame:
    """Mean per cluster on the scale from the lowest to the highest single row.

    Minimum and maximum over the rows are the extremes of the cluster extremes, so one
    pass over the rows is enough; the window runs over one row per cluster. Rows
    without a cluster count for the scale only.
    """
    per = rows.groupBy(cluster).agg(*[
        e for c in columns for e in
        (F.avg(c).alias(f"_m_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))
    ])
    every = Window.partitionBy()
    return per.select(cluster, *[
        min_max(F.col(f"_m_{c}"), F.min(f"_lo_{c}").over(every), F.max(f"_hi_{c}").over(every)).alias(c + "_norm")
        for c in columns
    ]).where(F.col(cluster).isNotNull())
