"""What files a table has, from the file system's listing alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_status(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, modified of every file below the paths. No file is opened: their contents are never asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def freshness(files: DataFrame) -> DataFrame:
    """Newest modification time of a listing, as text; NULL without files."""
    return files.agg(F.date_format(F.max("modified"), "yyyy-MM-dd-HH:mm").alias("last_update"))


def fingerprints(**listings: DataFrame) -> dict[str, str]:
    """A text for each listing that changes with every file that comes, goes or is written anew; one job for all of them."""
    tagged = reduce(DataFrame.union, [files.withColumn("name", F.lit(name)) for name, files in listings.items()])
    rows = tagged.groupBy("name").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)")).alias("sum"))
    found = {r["name"]: f"{r['n']}|{r['size']}|{r['sum']}" for r in rows.collect()}
    return {name: found.get(name, "0|0|0") for name in listings}
