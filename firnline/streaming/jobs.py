"""Incremental jobs: ingest, de-duplicate, roll up and score what has newly landed.

Each job runs to the end of the available files and stops (``availableNow``), so it can
be started once a day. Progress is kept in the checkpoint folder; a batch that is
repeated after a failure rewrites its own output and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from firnline.operators.clusters import RiskModel


def landed_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "json":
        options.setdefault("multiLine", "true")
    if files_per_batch:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    return reader.options(**options).load(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append_stream(stream: DataFrame, target: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Every new row goes to ``target`` once (the file sink logs finished batches)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _finish(writer.trigger(availableNow=True).start(target))


def each_batch(stream: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    writer = stream.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint)
    _finish(writer.trigger(availableNow=True).start())


def _replace_partitions(rows: DataFrame, target: str, partition_by: list[str]) -> None:
    # AQE gathers small partitions into one task and splits those too large for one
    writer = rows.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(target)


def _days(batch: DataFrame, day: str) -> list:
    """Days a batch touches: a few calendar days, used to read only their partitions."""
    return [r[0] for r in batch.select(day).distinct().collect()]


def dedupe_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Stateful de-duplication with bounded state: copies count while they come within ``delay``."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def dedupe_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], day: str,
                  event_time: str | None = None, delay: str | None = None) -> None:
    """Keep the first row of each key, over all batches; ``day`` is a column that follows from the key.

    The first row of every key is kept as state, in the state store of the checkpoint. A batch
    looks up its own keys there and reads nothing that is stored in the target. Within a batch the first is the one of
    smallest ``order``, then by the other columns; NULL keys are copies of each other. All rows of a batch carry one
    time of arrival, so a key is new if its earliest and its latest time are the same.

    Without ``delay`` the state holds every key ever seen and the result is exact. With it, keys
    are forgotten once ``event_time``, a timestamp among the keys, lies that far behind the newest one, and rows
    that come later than that are left out. The batch number is a partition, so a repeated batch replaces itself.
    """
    others = [c for c in stream.columns if c not in (*keys, *order)]
    rows = stream.withColumn("_arrived", F.current_timestamp())
    if delay:
        if event_time not in keys:
            raise ValueError("the event time must be part of the key")
        rows = rows.withWatermark(event_time, delay)
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("_first"), F.min("_arrived").alias("_since"), F.max("_arrived").alias("_until"))

    def change(batch: DataFrame, number: int) -> None:
        fresh = batch.where("_since = _until").select(*keys, "_first.*").select(*stream.columns)
        _replace_partitions(fresh.withColumn("batch", F.lit(number)), target, [day, "batch"])

    writer = first.writeStream.outputMode("update").foreachBatch(change).option("checkpointLocation", checkpoint)
    _finish(writer.trigger(availableNow=True).start())


def daily_stream(stream: DataFrame, stored: str, target: str, checkpoint: str, day: str,
                 roll_up: Callable[[DataFrame], DataFrame]) -> None:
    """Keep every reading, and recompute the roll-up of the days a batch touches.

    A late reading therefore always counts, as it does when everything is recomputed.
    """
    spark = stream.sparkSession

    def change(batch: DataFrame, number: int) -> None:
        days = _days(batch, day)
        _replace_partitions(batch.withColumn("batch", F.lit(number)), stored, [day, "batch"])
        if days:
            touched = spark.read.parquet(stored).where(F.col(day).isin(days)).drop("batch")
            _replace_partitions(roll_up(touched), target, [day])

    each_batch(stream, change, checkpoint)


def windowed_daily(stream: DataFrame, event_time: str, key: str, delay: str, aggregates: list[Column]) -> DataFrame:
    """Tumbling one-day roll-up with a watermark; rows later than ``delay`` are left out."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    rolled = timed.groupBy(F.window(event_time, "1 day").alias("_w"), key).agg(*aggregates)
    return rolled.select(F.to_date("_w.start").alias("date"), key, *[c for c in rolled.columns if c not in ("_w", key)])


def score_stream(stream: DataFrame, model: RiskModel, target: str, checkpoint: str) -> None:
    """Score new rows with the stored model; nothing is kept between rows."""
    append_stream(model.score(stream), target, checkpoint)
