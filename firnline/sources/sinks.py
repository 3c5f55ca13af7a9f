"""Writes: append with an ingest sequence, cleaning in place, table creation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators.cleaning import keep_first
from firnline.sources.versions import VersionedTable


def with_sequence(batch: DataFrame, batch_no: int) -> DataFrame:
    """Add the arrival order: batch number, then position inside the batch.

    A frame read with positions keeps its columns file and nr. Any other must be read
    straight from files, so that positions follow the rows of each file; across the files of one batch
    the file name decides.
    """
    if {"file", "nr"} <= set(batch.columns):
        return batch.select(F.lit(batch_no).cast("bigint").alias("batch"), "*")
    return batch.select(
        F.lit(batch_no).cast("bigint").alias("batch"),
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("nr"),
        "*",
    )


def append_batch(batch: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows below ``path``; one task writes whole partitions, so files stay few."""
    writer = batch
    if partition_by:
        # a day may be large: AQE splits the rebalanced partitions that grow too big
        writer = batch.hint("rebalance", *partition_by)
    out = writer.write.mode("append")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def clean_in_place(table: VersionedTable, keys: list[str], order: list[str]) -> list:
    """Keep the first row of each key; the partition column must be a function of the key.

    Only partitions that hold a key twice are written anew. Their values are returned.
    """
    rows = table.read()
    twice = rows.groupBy(table.column, *keys).agg(F.count("*").alias("_n")).where("_n > 1")
    touched = [r[0] for r in twice.select(table.column).distinct().collect()]  # partitions, not rows
    if touched:
        table.change(lambda some: keep_first(some, keys, order), touched)
    return touched


def write_result(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    out = rows.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def create_table_as(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """New catalogue table from a query; an earlier one of that name is replaced."""
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = rows.write.format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def preview(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in a stated order (a top-n, not a full sort)."""
    return rows.orderBy(*order).limit(n)
