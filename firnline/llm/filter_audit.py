"""Audit of filters that are applied one after the other, from one table of failing ids for each filter.

Every row of the documents gets a number; a filter's table holds the numbers of the rows that fail it. What a filter
removes after others depends on the set of those others, not on their order, so the audit goes by sets
(prefixes, kept as bits). Level by level, the survivors of each prefix are offered to each filter that is not
in it: a left semi join with the filter's ids gives what it removes there (with the labels lost), a left anti join the
survivors of the longer prefix. A left anti join of each filter's ids with the survivors of a prefix gives
its redundant failures. Rows that fail nothing survive every prefix: one anti join counts them, and
the levels hold failing rows alone. Joins are keyed by row numbers, which no row shares, so none is skewed.

Orders are put together from these counts at the end: n! * n steps for n filters, joined by prefix and filter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.texts import words
from firnline.session import shared_folder, stored

#: Failure by text and words, in the order of the filters' bits.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, w: F.size(w) < 100,
    "B": lambda text, w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
    "C": lambda text, w: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
    "D": lambda text, w: text.rlike(r"[#$%&*|]"),
}
#: The last filter: a text that a row of smaller doc_id has as well.
COPIES = "E"


def numbered(docs: DataFrame, part: str, rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """row (a number of its own), doc_id, part, digest of the text, and fails: the places of the rules it fails."""
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("words", words(F.col("text")))
    failed = F.array(*[F.when(fails(F.col("text"), F.col("words")), F.lit(i)) for i, fails in enumerate(rules.values())])
    return stored(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                              F.array_compact(failed).alias("fails")), "audit-rows")


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a row of smaller doc_id has; first ids are stored, so that Spark may split a text with many copies."""
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = stored(firsts.where("last > first").select(F.col("digest").alias("same"), "first"), "audit-firsts")
    return rows.join(firsts, (F.col("digest") == F.col("same")) & (F.col("doc_id") > F.col("first")), "left_semi")


def failing_ids(rows: DataFrame, n_rules: int) -> DataFrame:
    """filter, row, part: one id table, a folder of its own, for each filter."""
    path = shared_folder(rows.sparkSession, "audit-failing")
    by_rule = rows.select(F.explode("fails").alias("filter"), "row", "part")
    ids = by_rule.unionByName(copies(rows).select(F.lit(n_rules).alias("filter"), "row", "part"))
    ids.write.partitionBy("filter").parquet(path)
    return rows.sparkSession.read.schema("row long, part string, filter int").parquet(path)


def label_flags(labels: DataFrame) -> DataFrame:
    """id, good, toxic: one row for each labelled id; true if any of its labels says so."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return stored(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic")), "audit-labels")


def counted(rows: DataFrame, kept: Column, removed: Column, redundant: Column, *by: str) -> DataFrame:
    """Counts by part, prefix and filter in the columns that all relations of the audit share."""
    number = lambda on, c: F.sum(F.when(on, F.col(c).cast("long")).otherwise(0))
    lost = [number(removed, c).alias(f"{c}_lost") if c in rows.columns else F.lit(0).cast("long").alias(f"{c}_lost") for c in ("good", "toxic")]
    return rows.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for c, n in ((kept, "kept"), (removed, "removed"), (redundant, "redundant"))], *lost)


def prefix_counts(rows: DataFrame, ids: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """part, prefix, filter, kept, removed, redundant, good_lost, toxic_lost.

    Rows with filter -1 hold kept: the survivors of the prefix, those that fail nothing under prefix -1. The
    other rows hold what the filter does after the prefix. Counts of zero have no row.
    """
    bit = lambda f: F.get(F.lit([1 << i for i in range(n)]), f)
    yes, no = F.lit(True), F.lit(False)
    base = rows.join(label_flags(labels), F.col("doc_id") == F.col("id"), "left").select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    failing = ids.select("row").distinct()
    clean = rows.join(failing, "row", "left_anti").select("part", F.lit(-1).alias("prefix"), F.lit(-1).alias("filter"))
    alive = stored(base.join(failing, "row", "left_semi").withColumn("prefix", F.lit(0)), "audit-level")
    out, levels = [counted(clean, yes, no, no, "part", "prefix", "filter")], []
    for k in range(n):
        levels.append(alive)
        offered = alive.withColumn("filter", F.explode(F.filter(F.lit(list(range(n))), lambda f: bit(f).bitwiseAND(F.col("prefix")) == 0)))
        out.append(counted(offered.join(ids, ["row", "filter"], "left_semi"), no, yes, no, "part", "prefix", "filter"))
        if k < n - 1:  # all filters leave no failing row; each set is reached by its filters in ascending order
            longer = offered.where(bit(F.col("filter")) > F.col("prefix")).join(ids, ["row", "filter"], "left_anti")
            alive = stored(longer.select("row", "part", "good", "toxic", F.col("prefix").bitwiseOR(bit(F.col("filter"))).alias("prefix")), "audit-level")
    survivors = reduce(DataFrame.unionByName, levels)
    out.append(counted(survivors.withColumn("filter", F.lit(-1)), yes, no, no, "part", "prefix", "filter"))
    after = ids.withColumn("prefix", F.explode(F.filter(F.lit(list(range(1, 1 << n))), lambda p: p.bitwiseAND(bit(F.col("filter"))) == 0)))
    gone = after.join(survivors.select("row", "prefix"), ["row", "prefix"], "left_anti")
    out.append(counted(gone, no, no, yes, "part", "prefix", "filter"))
    numbers = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
    return stored(reduce(DataFrame.unionByName, out).groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in numbers]), "audit-counts")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", rules: dict[str, Callable[[Column, Column], Column]] = RULES) -> DataFrame:
    """One row for each part, order of the filters (the rules and COPIES) and step, zeros included.

    Columns: part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    NULL texts count as empty, NULL parts as the empty string. Every row of docs counts, repeated ones as well; rows
    without a doc_id are no copies, make no copies and have no label. An id with several labels is good
    (toxic) if one of them says so. Other columns are ignored; an empty table gives no rows.
    """
    spark, names = docs.sparkSession, "".join([*rules, COPIES])
    n = len(names)
    rows = numbered(docs, part, rules)
    counts = prefix_counts(rows, failing_ids(rows, n - 1), labels, n)
    at = {name: i for i, name in enumerate(names)}
    steps = []
    for order in permutations(names):
        before = 0
        for k, name in enumerate(order):
            steps.append(("".join(order), k + 1, before, at[name], before | 1 << at[name]))
            before |= 1 << at[name]
    steps = spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter int, longer int")  # n! * n rows
    cells = [F.struct(F.lit(p).alias("prefix"), F.lit(f).alias("filter"), F.lit(factorial(p.bit_count()) * factorial(n - 1 - p.bit_count())).alias("orders"))
             for p in range(1 << n) for f in range(n) if not p >> f & 1]
    parts = rows.select("part").distinct()
    grid = parts.select("part", F.explode(F.array(*cells)).alias("c")).select("part", "c.*").join(
        counts.select("part", "prefix", "filter", "removed", "redundant", "good_lost", "toxic_lost"), ["part", "prefix", "filter"], "left").na.fill(0)
    grid = stored(grid, "audit-grid")
    others = F.get(F.lit([(1 << n) - 1 - (1 << i) for i in range(n)]), F.col("filter"))
    alone = F.sum(F.when(F.col("prefix") == others, F.col("removed")))
    by_filter = grid.groupBy("part", "filter").agg(alone.alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    kept = counts.where("filter = -1")
    clean = kept.where("prefix = -1").select("part", F.col("kept").alias("clean"))
    left = kept.where("prefix >= 0").select("part", F.col("prefix").alias("longer"), F.col("kept").alias("left"))
    full = grid.join(F.broadcast(steps), ["prefix", "filter"]).join(by_filter, ["part", "filter"]).join(clean, "part", "left").join(left, ["part", "longer"], "left")
    return full.select("part", "filter_order", "step", (F.coalesce("clean", F.lit(0)) + F.coalesce("left", F.lit(0))).cast("long").alias("kept"), "removed",
                       "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """audit() with the rules above in DuckDB SQL: rows counted by the set of filters that they fail."""
    return r"""WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
flagged AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS bits,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
sets AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM one a JOIN one b ON b.b <> a.b JOIN one c ON c.b NOT IN (a.b, b.b)
  JOIN one d ON d.b NOT IN (a.b, b.b, c.b) JOIN one e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (SELECT filter_order, s.step::INT AS step, bs[s.step]::INT AS b, coalesce(list_sum(bs[1:s.step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
counted AS (SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (bits & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & b <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (bits & before <> 0 AND bits & b <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = b), 0) AS unique_fails,
  coalesce(sum(good) FILTER (bits & before = 0 AND bits & b <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & b <> 0), 0) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM counted"""
