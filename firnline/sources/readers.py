"""Scans: CSV and JSON at the edge, Parquet everywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.functions.labels import trimmed
from firnline.functions.numbers import nan_to_null
from firnline.sources.json_arrays import read_records


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", quote: str = '"') -> DataFrame:
    """CSV with a header and a fixed schema; NaN becomes NULL.

    The header must name the columns of the schema in order; other files are an error.
    """
    rows = spark.read.schema(schema).csv(path, sep=sep, header=True, quote=quote, enforceSchema=False)
    return clear_nan(rows)


def read_csv_named(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str]) -> DataFrame:
    """CSV whose header may use other names (names: theirs to ours) and may lack columns, which are left out."""
    header = {names.get(c, c): c for c in spark.read.csv(path, header=True).columns}
    ours = [f for f in schema if f.name in header]
    asked = T.StructType([T.StructField(header[f.name], f.dataType) for f in ours])
    return read_csv(spark, path, asked).toDF(*[f.name for f in ours])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, position: bool = False) -> DataFrame:
    """Landed files that each hold one array of records; with position also file and nr, the order of arrival in a batch."""
    return clear_nan(read_records(spark, path, schema, position))


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a known schema no footers are read ahead of the query."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def trim_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(key, trimmed(F.col(key)))


def clear_nan(rows: DataFrame) -> DataFrame:
    floats = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({name: nan_to_null(F.col(name)) for name in floats})
