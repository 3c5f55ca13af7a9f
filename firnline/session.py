"""Session settings, the shared work folder, and size checks made before a plan is chosen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only while Catalyst's own size estimate stays below this.
BROADCAST_BYTES = 64 << 20
# A group with more rows than this is handled apart; a buffer of that many values fits any task.
HOT_ROWS = 100_000


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the library relies on; a cluster's own settings win."""
    builder = SparkSession.builder.appName("firnline")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs several round trips per expression while a plan is built
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    Without that setting (as in tests) it lies beside the managed tables, on the file
    system that Spark itself uses for them.
    """
    return f"{lasting_folder(spark, purpose)}-{uuid.uuid4().hex}"


def lasting_folder(spark: SparkSession, name: str) -> str:
    """The folder of that name in the same place: the same one at every call."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
    return f"{root.rstrip('/')}/{name}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the shared folder and go on from there.

    This cuts the lineage like a checkpoint, but computes the rows only once, keeps
    them by column, and survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unordered(df: DataFrame) -> DataFrame:
    """The same rows where their order has no use: below a join Spark drops a sort, which it would repeat for every use.

    The join is a left join with a table of no rows, which changes nothing and which adaptive execution drops. (An
    anti join would be pushed below the sort.)
    """
    none = F.broadcast(df.sparkSession.range(0).toDF("_none"))
    return df.join(none, F.hash(df.columns[0]).cast("bigint") == none["_none"], "left").drop(none["_none"])


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, without running anything; None if it cannot be had."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # no JVM handle (remote session): size unknown
        return None


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast behind a size check; otherwise AQE picks the join at run time."""
    return F.broadcast(df) if is_small(df, limit) else df
