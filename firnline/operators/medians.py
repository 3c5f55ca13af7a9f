"""Exact median of groups that are too large for one aggregation buffer.

Spark's ``median`` keeps every distinct value of a group in one buffer. For groups
with very many rows, a mergeable quantile sketch first gives two values close to the
middle and on either side of it. Rows below them are only counted, rows above are
dropped; what is left to rank is a tiny share of the group. Where the sketch has missed the middle, the group's
values are counted between pivots, over and over in the range that holds the middle, until it is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.session import broadcast_if_small, stored

ACCURACY = 200_000
MARGIN = 4.0 / ACCURACY  # four times the rank error the sketch allows
#: Pivots of a range; a range of the next round has about this part of the rows.
PIVOTS = 64


def bracketed_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) with the exact median of the non-NULL values per group.

    ``rows`` holds only large groups: their number is at most rows / threshold, so the
    table of one row per group that is joined here is small; it is stored, and broadcast behind a check of its size.
    """
    rows = rows.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL")
    sketch = F.percentile_approx("_v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    edges = rows.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_e")).select(
        *keys, "_n", F.col("_e")[0].alias("_low"), F.col("_e")[1].alias("_high")
    )
    # everything below the bracket counts under the value NULL, which sorts first
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")
    counted = (
        rows.join(broadcast_if_small(stored(edges, "median-edges")), keys).where(F.col("_v") <= F.col("_high"))
        .groupBy(*keys, "_n", inside).agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda rank: F.min(F.when(F.col("_upto") >= F.expr(rank), F.col("_v")))
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).groupBy(*keys, "_n").agg(
        first("(_n + 1) div 2").alias("_m1"), first("_n div 2 + 1").alias("_m2"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
    )
    # both middle rows must lie inside the bracket
    met = F.col("_m2").isNotNull() & (F.col("_below") < F.expr("(_n + 1) div 2"))
    ranked = stored(ranked.select(*keys, "_n", F.when(met, (F.col("_m1") + F.col("_m2")) / 2).alias(value), met.alias("_met")), "medians")
    if ranked.where("NOT _met").isEmpty():
        return ranked.select(*keys, value)
    missed = ranked.where("NOT _met").select(*keys, F.explode(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1"))).alias("_rank"))
    middles = select_ranks(rows, keys, missed).groupBy(*keys).agg(F.avg("_v").alias(value))  # one row if both middle rows are the same
    return ranked.where("_met").select(*keys, value).unionByName(middles)


def select_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, _rank, _v): the value of each wanted rank (from 1) among the values _v of its group, whatever their distribution.

    Each round takes pivots from the values between two bounds and counts the rows at and between them. The rank
    then lies at a pivot, and is found, or between two neighbours, which bound the next round; pivots are
    values of the range, so it has fewer rows each time.
    """
    number = [*keys, "_rank"]
    kind = dict(rows.dtypes)["_v"]
    none = F.lit(None).cast(kind)
    # _before: rows up to the lower bound
    open_ = wanted.distinct().select(*number, none.alias("_low"), none.alias("_high"), F.lit(0).cast("bigint").alias("_before"))
    found = []
    while not open_.isEmpty():
        inside = rows.join(broadcast_if_small(open_), keys).where(
            (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high"))))
        shares = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
        pivots = inside.groupBy(*number, "_low", "_high", "_before").agg(F.array_distinct(F.percentile_approx("_v", shares, 100 * PIVOTS)).alias("_p"))
        pivots = stored(pivots, "median-pivots")
        # even cells lie between pivots, odd ones at them
        lower = F.size(F.filter("_p", lambda p: p < F.col("_v")))
        cell = 2 * lower + F.when(F.array_contains("_p", F.col("_v")), 1).otherwise(0)
        counted = inside.drop("_low", "_high", "_before").join(broadcast_if_small(pivots), number).groupBy(*number, cell.alias("_cell")).agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*number).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("_upto", F.sum("_c").over(upto)).join(broadcast_if_small(pivots), number).withColumn("_last", F.col("_before") + F.col("_upto"))
        hit = stored(placed.where((F.col("_last") >= F.col("_rank")) & (F.col("_last") - F.col("_c") < F.col("_rank"))), "median-cells")
        at = F.floor(F.col("_cell") / 2).cast("int")
        found.append(hit.where("_cell % 2 = 1").select(*number, F.get("_p", at).alias("_v")))
        # beyond the outer pivots the bounds stay
        open_ = hit.where("_cell % 2 = 0").select(
            *number, F.coalesce(F.get("_p", at - 1), F.col("_low")).alias("_low"), F.coalesce(F.get("_p", at), F.col("_high")).alias("_high"),
            (F.col("_last") - F.col("_c")).alias("_before"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
