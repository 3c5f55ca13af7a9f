"""Trailing moving averages over rows."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from firnline.session import stored

#: monotonically_increasing_id holds the partition above these bits and the place in the partition below them.
PLACE_BITS = 33


def moving_average(rows: DataFrame, columns: list[str], n: int, order: list[str], by: list[str] | None = None, suffix: str = "_avg") -> DataFrame:
    """Mean of the last n rows; NULL until n rows are there or while one of them is NULL.

    The frame counts rows, not days. Without ``by``, ``rows`` is a table of one row per day, so
    the single window is as long as the record in days and does not grow with the stations. With
    ``by``, groups may have any length. Rows equal in ``by`` and ``order`` follow the order of their other
    columns, from left to right and NULL first, so that the averages do not depend on arrival.
    """
    if not by:
        return _average(rows, columns, n, Window.partitionBy().orderBy(*order), suffix)
    ties = [c for c in rows.columns if c not in (*by, *order)]
    placed, starts = _ranged(rows, [*by, *order, *ties])
    averaged = _average(_with_halo(placed, starts, n - 1), columns, n, Window.partitionBy("_home", *by).orderBy("_row"), suffix)
    return averaged.where("_home = _part").drop("_home", "_part", "_row")


def _average(rows: DataFrame, columns: list[str], n: int, spec: WindowSpec, suffix: str) -> DataFrame:
    frame = spec.rowsBetween(1 - n, 0)
    return rows.withColumns({
        c + suffix: F.when(F.count(c).over(frame) == n, F.avg(c).over(frame)) for c in columns
    })


def _ranged(rows: DataFrame, key: list[str]) -> tuple[DataFrame, list[int]]:
    """Rows in ranges of the key, with _row (ascending in the order of the key) and _part (the range), and how many rows lie before each range.

    The ranges are those of a range partitioning, so that one group may have many of them. Rows are stored, since
    the ranges are drawn from a sample; one number for each range comes to the driver.
    """
    in_order = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = stored(in_order.withColumn("_row", F.monotonically_increasing_id()), "ranged-rows").withColumn("_part", F.shiftright("_row", PLACE_BITS).cast("int"))
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.count("*")).collect()}
    starts = [0]
    for part in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(part, 0))
    return placed, starts


def _with_halo(placed: DataFrame, starts: list[int], n: int) -> DataFrame:
    """Every row in its range (_home), and once more in each later range that begins at most n rows after it."""
    home = placed.withColumn("_home", F.col("_part"))
    if n < 1 or len(starts) < 3:
        return home
    begin = F.lit(starts)
    # the last range that rows of a range may be copied to
    furthest = F.lit([min(bisect_right(starts, end - 1 + n) - 1, len(starts) - 2) for end in starts[1:]])
    at = F.get(begin, F.col("_part")) + F.col("_row").bitwiseAND((1 << PLACE_BITS) - 1)
    # few rows are left here: at most n for each range
    last = placed.withColumn("_at", at).where((F.get(begin, F.col("_part") + 1) - F.col("_at") <= n) & (F.get(furthest, F.col("_part")) > F.col("_part")))
    later = F.filter(F.sequence(F.col("_part") + 1, F.get(furthest, F.col("_part"))), lambda p: F.get(begin, p) - F.col("_at") <= n)
    return home.unionByName(last.withColumn("_home", F.explode(later)).drop("_at"))
