"""Loaders of the files the pipelines exchange, each with its schema and separator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline import schemas
from firnline.sources.readers import read_csv, read_csv_named, trim_key

#: Other names of the two components in files of earlier runs.
COMPONENT_NAMES = {"PC1": "PCA1", "PC2": "PCA2"}


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STATIONS, sep=";")


def load_raw_accidents(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.ACCIDENTS_RAW, sep=";")


def load_weather_history(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.HISTORY_WEATHER, sep=";")


def load_snow_history(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.HISTORY_SNOW, sep=";")


def load_measurements(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.MEASUREMENTS, sep=";")


def load_daily_measurements(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.MEASUREMENTS_DAILY, sep=";")


def load_snow(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SNOW, sep=";")


def load_live(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LIVE, sep=";")


def load_accidents(spark: SparkSession, path: str) -> DataFrame:
    """Accidents with their station means and region."""
    return read_csv(spark, path, schemas.ACCIDENTS)


def load_clustered_training(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRAINING_CLUSTERED)


def load_pca_training(spark: SparkSession, path: str) -> DataFrame:
    """All features, or just the two components and the cluster; components may be called PC1 and PC2."""
    return read_csv_named(spark, path, schemas.PCA_TRAINING, COMPONENT_NAMES)


def load_pca_live(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields; station codes may carry blanks."""
    return trim_key(read_csv(spark, path, schemas.PCA_LIVE, quote='"'), "station_code")


def load_cluster_centres(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CLUSTER_CENTRES)


def load_cluster_means(spark: SparkSession, path: str) -> DataFrame:
    """Components may be called PC1 and PC2."""
    return read_csv_named(spark, path, schemas.CLUSTER_MEANS, COMPONENT_NAMES)
