"""Tagged unions of training rows, live rows and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.labels import cluster_colour, live_label
from firnline.vocabulary import CLUSTER_POSITIONS


def union_tagged(**parts: DataFrame) -> DataFrame:
    """Union of frames with a ``source`` column that names each; ``part_of`` takes them apart again."""
    names = iter(parts.items())
    first, rows = next(names)
    out = rows.withColumn("source", F.lit(first))
    for name, rows in names:
        out = out.unionByName(rows.withColumn("source", F.lit(name)), allowMissingColumns=True)
    return out


def part_of(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source).drop("source")


def risk_layers(training: DataFrame, live: DataFrame, centres: DataFrame) -> DataFrame:
    """Training points, live points and centres of one scatter chart."""
    none = F.lit(None).cast("string")
    points = training.select(
        F.lit("training").alias("layer"), "PCA1", "PCA2", F.col("k_cluster").cast("int"),
        cluster_colour(F.col("k_cluster")).alias("colour"), none.alias("label"),
    )
    today = live.select(
        F.lit("live").alias("layer"), "PCA1", "PCA2", F.col("k_cluster").cast("int"), F.lit("black").alias("colour"),
        live_label(F.col("canton_code"), F.col("station_code"), F.col("station_name")).alias("label"),
    )
    marks = centres.select(
        F.lit("centre").alias("layer"), "PCA1", "PCA2", F.col("cluster").cast("int").alias("k_cluster"),
        F.lit("darkblue").alias("colour"), none.alias("label"),
    )
    return points.unionByName(today).unionByName(marks)


def stored_centres(spark) -> DataFrame:
    """The published centre positions as a table of five rows."""
    rows = [(n, *p) for n, p in CLUSTER_POSITIONS.items()]
    return spark.createDataFrame(rows, "cluster INT, PCA1 DOUBLE, PCA2 DOUBLE")
