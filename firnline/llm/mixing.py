"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A source of target / words = 1.4 gives one certain copy of every
document; the remaining 0.4 of its words are drawn as second copies with unequal probability. The
inclusion probability of a document is

    p = min(1, level * measure),   measure its size rounded down to three leading bits,

with the level of its source at which the expected words of second copies equal the rest of the target.
Documents with p = 1 get their second copy for certain and first; the others follow in the order of the
Pareto ranks

    (U / (1 - U)) / (p / (1 - p)),   U a hash of doc_id,

and each is taken if it still fits the words that are left (a sample of fixed size in words, as the
documents differ in size). At the end one more document is taken if that comes nearer to the target.

Only word counts and ranks are shuffled. A source has at most 256 measures. The order is walked in
passes: a pass takes what fits up to the first document that does not, and the next one goes on behind
it with what fits the smaller gap, until nothing does. In a pass the place of that document is found in
a histogram of ranks, whose cell is divided again until it has few rows, so that no task orders all
documents of a hot source. Documents are then judged by comparing with the cuts of their source, which
is a small table. Rows of one rank (repeated rows) share their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.llm.texts import count_words
from firnline.session import HOT_ROWS, stored

#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix holds, and copies of a source that it may hold at most.
SHARE, COPIES = 1.5, 2.0
#: Cells into which a range of ranks is divided at a time; a source's rows are ordered in one task once a cell has HOT_ROWS or less.
CELLS = 1024
BIG = 1e300
#: Rank of certain second copies.
FIRST = -1.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, copies=COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    sizes needs source and size. A target is the source's weight times a common level,
    but at most copies * source_size; the level makes the targets sum to share of all words.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(cycle, place % len(weights)))
    per = per.withColumn("cap", F.lit(float(copies)) * F.col("source_size"))
    by_ratio = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.sum("weight").over(onward)})
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("weights"))
    # sources are full as long as their cap lies below the level that holds if all before them are full
    per = per.withColumn("open_level", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("open_level")))
    return per.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of a digest; a NULL id counts as an empty one."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def measure(size: Column) -> Column:
    """Size rounded down to its three leading bits."""
    low = F.greatest(F.length(F.bin(size)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def inclusion(size: Column, level: Column) -> Column:
    """Probability of a second copy; documents without words have none."""
    return F.when(size > 0, F.least(F.lit(1.0), level * measure(size))).otherwise(F.lit(0.0))


def pareto_rank(u: Column, p: Column) -> Column:
    return F.when(p <= 0, F.lit(BIG)).when(p >= 1, F.lit(FIRST)).otherwise((u / (1 - u)) / (p / (1 - p)))


def inclusion_levels(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with level and gap: the words left for documents whose second copy is not certain.

    The windows run over the measures of a source, 256 at most.
    """
    per = sizes.where("size > 0").groupBy("source", measure(F.col("size")).alias("m")).agg(F.sum("size").cast("double").alias("words"))
    per = per.alias("d").join(targets.alias("t"), _same("d", "t")).select("d.source", "m", "words", "rest")
    large = W.partitionBy("source").orderBy(F.col("m").desc())
    per = per.withColumns({
        "full": F.coalesce(F.sum("words").over(large.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum(F.col("m") * F.col("words")).over(large.rowsBetween(W.currentRow, W.unboundedFollowing))})
    per = per.withColumn("level", (F.col("rest") - F.col("full")) / F.col("weights"))
    # the largest measures are certain as long as the level that holds if all before them are certain makes them so
    per = per.withColumn("level", F.max(F.when(F.col("m") * F.col("level") < 1, F.col("level"))).over(W.partitionBy("source")))
    per = per.groupBy("source").agg(F.max("level").alias("level"), F.sum(F.when(F.col("m") * F.col("level") >= 1, F.col("words")).otherwise(0.0)).alias("sure"))
    return targets.alias("t").join(per.alias("p"), _same("t", "p"), "left").select(
        "t.*", F.coalesce("level", F.lit(0.0)).alias("level"), (F.col("rest") - F.coalesce("sure", F.lit(0.0))).alias("gap"))


def mix_plan(docs: DataFrame, seed: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, rank of every row; per source its size, target, certain copies, level and cuts)."""
    sizes = stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, **how)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("certain", F.floor(ratio).cast("long"))
    targets = stored(targets.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")), "mix-targets")
    cut = "array<struct<after:double,upto:double,size:double>>"
    state = stored(inclusion_levels(sizes, targets).withColumns({"after": F.lit(0.0), "cuts": F.array().cast(cut)}), "mix-cuts")
    ranked = sizes.alias("d").join(state.alias("t"), _same("d", "t")).select(
        "d.*", pareto_rank(uniform(F.col("doc_id"), seed), inclusion(F.col("size"), F.col("level"))).alias("rank"))
    ranked = stored(ranked, "mix-ranks")
    while not state.where(F.col("after") < BIG).isEmpty():
        state = _one_pass(ranked, state)
    left = ranked.alias("d").join(state.select("source", "gap", "cuts").alias("s"), _same("d", "s")) \
        .where((F.col("rank") > 0) & (F.col("rank") < BIG) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & ~_in_cuts(F.col("rank"), F.col("size"), F.col("cuts")))
    left = left.groupBy("d.source", "rank").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where(F.col("size") < 2 * F.col("gap"))
    left = left.groupBy("source").agg(F.min("rank").alias("extra"))
    return ranked, stored(state.alias("s").join(left.alias("l"), _same("s", "l"), "left").select("s.*", "extra"), "mix-cuts")


def _one_pass(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """Adds one cut (ranks between after and upto, documents up to size words) to each source and shrinks its gap.

    Offered are the documents behind the last cut that fit the gap; upto is the first at which they no longer do.
    """
    offered = ranked.alias("d").join(state.select("source", "gap", "after").alias("s"), _same("d", "s")) \
        .where((F.col("rank") > F.col("after")) & (F.col("rank") < BIG) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))) \
        .select("d.source", "rank", "size", "gap")
    span = offered.groupBy("source").agg(F.sum("size").cast("double").alias("all_words"), F.min("rank").alias("bottom"), F.max("rank").alias("top"))
    span = stored(span.withColumn("before", F.lit(0.0)), "mix-spans")
    edge = stored(_narrowed(offered, span), "mix-edges")
    while (edge.agg(F.max(F.when(F.log("top") > F.log("bottom"), F.col("rows")))).first()[0] or 0) > HOT_ROWS:
        edge = stored(_narrowed(offered, edge), "mix-edges")
    steps = _within(offered, edge).groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    by_rank = W.partitionBy("source").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumn("through", F.col("before") + F.sum("size").over(by_rank))
    over = F.col("through") > F.col("gap")
    ends = steps.groupBy("source").agg(F.min(F.when(over, F.col("rank"))).alias("upto"), F.coalesce(F.max(F.when(~over, F.col("through"))), F.first("before")).alias("used"))
    upto = F.coalesce("upto", F.lit(BIG))
    used = F.coalesce("used", "all_words", F.lit(0.0))
    return stored(state.alias("s").join(span.alias("a"), _same("s", "a"), "left").join(ends.alias("e"), _same("s", "e"), "left").select(
        "s.source", "source_size", "target", "certain", "rest", "level", (F.col("gap") - used).alias("gap"), upto.alias("after"),
        F.concat("cuts", F.array(F.struct(F.col("after").alias("after"), upto.alias("upto"), F.col("gap").alias("size")))).alias("cuts")), "mix-cuts")


def _within(offered: DataFrame, ranges: DataFrame) -> DataFrame:
    """Offered rows with ranks in the range (bottom to top, both included) of their source."""
    return offered.alias("o").join(ranges.select("source", "bottom", "top", "before").alias("r"), _same("o", "r")) \
        .where(F.col("rank").between(F.col("bottom"), F.col("top"))).select("o.*", "bottom", "top", "before")


def _narrowed(offered: DataFrame, ranges: DataFrame) -> DataFrame:
    """source, bottom, top, before, rows: the cell of each range in which the gap is passed, and the words before it."""
    low, high = F.log("bottom"), F.log("top")
    share = F.when(high > low, (F.log("rank") - low) / (high - low)).otherwise(F.lit(0.0))
    cells = _within(offered, ranges).withColumn("cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int"))
    cells = cells.groupBy("source", "cell").agg(
        F.sum("size").cast("double").alias("words"), F.count("*").alias("rows"), F.min("rank").alias("bottom"), F.max("rank").alias("top"),
        F.first("gap").alias("gap"), F.first("before").alias("before"))
    earlier = F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.col("before") + F.coalesce(earlier, F.lit(0.0))).where(F.col("before") + F.col("words") > F.col("gap"))
    return cells.groupBy("source").agg(F.min_by(F.struct("bottom", "top", "before", "rows"), "cell").alias("edge")).select("source", "edge.*")


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def _in_cuts(rank: Column, size: Column, cuts: Column) -> Column:
    return F.exists(cuts, lambda c: (rank > c["after"]) & (rank < c["upto"]) & (size <= c["size"]) & (size > 0))


def copies_of(rank: Column, size: Column, certain: Column, cuts: Column, extra: Column) -> Column:
    """Copies that the mix takes of a document."""
    second = (rank == FIRST) | ((rank < BIG) & (_in_cuts(rank, size, cuts) | F.coalesce(rank == extra, F.lit(False))))
    return F.coalesce(certain, F.lit(0)) + F.when(second, 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies: one row per document.

    NULL or empty texts have no words and no copies beyond the certain ones; NULL is a source of its own,
    the last one. An empty table gives no rows. Other columns are ignored.
    """
    ranked, state = mix_plan(docs, seed, **how)
    copies = copies_of(F.col("rank"), F.col("size"), F.col("certain"), F.col("cuts"), F.col("extra"))
    return ranked.alias("d").join(state.alias("s"), _same("d", "s")).select(
        "doc_id", "d.source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The documents with each row as often as the mix takes it; all columns as before."""
    _, state = mix_plan(docs, seed, **how)
    size = count_words(F.col("d.text"))
    ranks = pareto_rank(uniform(F.col("d.doc_id"), seed), inclusion(size, F.col("s.level")))
    copies = copies_of(ranks, size, F.col("s.certain"), F.col("s.cuts"), F.col("s.extra"))
    return docs.alias("d").join(state.alias("s"), _same("d", "s")).select(
        F.struct("d.*").alias("doc"), F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("doc.*")


def oracle(table: str = "documents", seed: int = 1) -> str:
    """The same rows as mix() in DuckDB SQL: plain running sums over all documents of a source, repeated until nothing fits."""
    return f"""
WITH RECURSIVE sizes AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {table}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY 1),
weighed AS (SELECT *, ([5.0::DOUBLE, 2.0, 1.0])[1 + ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST)) - 1) % 3] AS weight, 2.0 * source_size AS cap FROM per),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce((sum(cap) OVER (ORDER BY cap / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0.0))
    / (sum(weight) OVER (ORDER BY cap / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM weighed),
opened AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS open_level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN open_level IS NULL THEN cap ELSE least(cap, weight * open_level) END::DOUBLE AS target FROM opened),
parts AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS certain FROM targets),
rests AS (SELECT *, target - certain * source_size AS rest FROM parts),
measured AS (SELECT *, CASE WHEN size < 8 THEN size ELSE (size >> (length(bin(size)) - 3)::BIGINT) << (length(bin(size)) - 3)::BIGINT END AS m FROM sizes),
classes AS (SELECT k.source, m, words, rest FROM (SELECT source, m, sum(size)::DOUBLE AS words FROM measured WHERE size > 0 GROUP BY 1, 2) k JOIN rests t ON k.source IS NOT DISTINCT FROM t.source),
tried AS (SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(m * words) OVER (PARTITION BY source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM classes),
fixed AS (SELECT source, m, words, max(CASE WHEN m * level < 1 THEN level END) OVER (PARTITION BY source) AS level FROM tried),
chances AS (SELECT source, max(level) AS level, sum(CASE WHEN m * level >= 1 THEN words ELSE 0.0 END) AS sure FROM fixed GROUP BY 1),
s0 AS MATERIALIZED (SELECT t.*, coalesce(level, 0.0) AS level, rest - coalesce(sure, 0.0) AS gap FROM rests t LEFT JOIN chances c ON t.source IS NOT DISTINCT FROM c.source),
us AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM measured),
odds AS (SELECT u.*, CASE WHEN size > 0 THEN least(1.0::DOUBLE, level * m) ELSE 0.0 END AS p FROM us u JOIN s0 s ON u.source IS NOT DISTINCT FROM s.source),
ranked AS MATERIALIZED (SELECT *, CASE WHEN p <= 0 THEN 1e300 WHEN p >= 1 THEN -1.0 ELSE (u / (1 - u)) / (p / (1 - p)) END::DOUBLE AS rank FROM odds),
cuts AS (SELECT source, gap::DOUBLE AS gap, 0.0::DOUBLE AS after, 0.0::DOUBLE AS was_after, 0.0::DOUBLE AS was_gap FROM s0
  UNION ALL
  SELECT source, any_value(gap) - coalesce(max(through) FILTER (through <= gap), 0.0), coalesce(min(rank) FILTER (through > gap), 1e300)::DOUBLE, any_value(after), any_value(gap)
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS through
    FROM (SELECT s.source, s.gap, s.after, rank, sum(size)::DOUBLE AS words FROM cuts s LEFT JOIN ranked r
      ON r.source IS NOT DISTINCT FROM s.source AND rank > s.after AND rank < 1e300 AND size > 0 AND size <= s.gap
      WHERE s.after < 1e300 GROUP BY 1, 2, 3, 4)) GROUP BY source),
seconds AS (SELECT r.*, rank = -1.0 OR rank < 1e300 AND EXISTS (SELECT 1 FROM cuts c WHERE c.source IS NOT DISTINCT FROM r.source
    AND r.rank > c.was_after AND r.rank < c.after AND r.size <= c.was_gap AND r.size > 0 AND c.was_gap > 0) AS second FROM ranked r),
extras AS (SELECT source, min(rank) AS extra FROM (SELECT r.source, rank, sum(size) AS words, any_value(c.gap) AS gap FROM seconds r JOIN cuts c ON c.source IS NOT DISTINCT FROM r.source
    WHERE c.after = 1e300 AND NOT second AND rank > 0 AND rank < 1e300 AND size > 0 AND size < 2 * c.gap GROUP BY 1, 2) WHERE words < 2 * gap GROUP BY 1),
taken AS (SELECT doc_id, size, source_size, target, certain + CASE WHEN second OR rank = extra THEN 1 ELSE 0 END AS copies
  FROM seconds r JOIN s0 s ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN extras e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM taken"""
