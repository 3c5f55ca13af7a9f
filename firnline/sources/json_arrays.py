"""Files that each hold one JSON array of records, read in many tasks however large a file is.

A file is cut at every closing brace by Spark's text source, which deals byte ranges of one file to several tasks.
What a piece does to the reader's state does not depend on where the piece lies: an odd number of quotes switches
between inside and outside of a string, and its brackets change the depth by one number if it begins
outside and by another if it begins inside. These effects are added up inside each byte range, the ranges' totals are
composed along the file (one row for each range), and so every piece learns its state and depth. A record
ends with a brace outside of strings that leads back to depth one. Most records are one piece and stay where
they are; only those with inner objects, or with braces in their texts, are put together by a grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.session import broadcast_if_small, stored

RANGE = ["file", "block"]


def _net(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"[\]}]"))


def _before(column: Column, spec) -> Column:
    return F.coalesce(F.sum(column).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its effects, and with the sums of effects before it in its byte range.

    odd is the state at the piece if the range begins outside of a string; depth0 and step0 hold for ranges that begin
    outside, depth1 and step1 for those that begin inside.
    """
    raw = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    bare = F.regexp_replace("text", r"(?s)\\.", "")  # no escaped quotes
    strings = r'"[^"]*("|\z)'
    outside, inside = F.regexp_replace("bare", strings, ""), F.regexp_replace(F.regexp_replace("bare", r'^[^"]*("|\z)', ""), strings, "")
    flips = F.regexp_count("bare", F.lit('"')) % 2
    # the brace that ends the piece counts where the piece ends outside
    raw = raw.withColumn("bare", bare).withColumn("flips", flips) \
        .withColumns({"out": _net(outside) - 1 + F.col("flips"), "in": _net(inside) - F.col("flips")}).drop("bare")
    along = Window.partitionBy(*RANGE).orderBy("seq")
    raw = raw.withColumns({"odd": _before(F.col("flips"), along) % 2, "at": _before(F.octet_length("text") + 1, along)})
    raw = raw.withColumns({"step0": F.when(F.col("odd") == 0, F.col("out")).otherwise(F.col("in")),
                           "step1": F.when(F.col("odd") == 0, F.col("in")).otherwise(F.col("out"))}).drop("out", "in")
    return stored(raw.withColumns({"depth0": _before(F.col("step0"), along), "depth1": _before(F.col("step1"), along)}), "json-pieces")


def _ranges(pieces: DataFrame) -> DataFrame:
    """State, depth and byte position at the beginning of each range; a file whose brackets do not match is an error."""
    totals = pieces.groupBy(*RANGE).agg(
        F.sum("flips").alias("flips"), F.sum("step0").alias("sum0"), F.sum("step1").alias("sum1"), F.sum(F.octet_length("text") + 1).alias("size"))
    along = Window.partitionBy("file").orderBy("block")
    totals = totals.withColumn("state", _before(F.col("flips"), along) % 2)
    totals = totals.withColumn("move", F.when(F.col("state") == 0, F.col("sum0")).otherwise(F.col("sum1")))
    whole = Window.partitionBy("file")
    # the reader counts a brace after the last piece too, so a complete array ends at depth -1
    complete = (F.sum("move").over(whole) == -1) & (F.sum("flips").over(whole) % 2 == 0)
    return stored(totals.select(
        *RANGE, "state", F.when(complete, _before(F.col("move"), along)).otherwise(_error("array is not complete")).alias("depth"),
        _before(F.col("size"), along).alias("offset")), "json-ranges")


def _error(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.col("file")))


def _record(text: Column) -> Column:
    """The record without what separates it from the one before."""
    cut = F.regexp_replace(text, r"^[\x{FEFF}\s]*[\[,]?\s*", "")
    return F.when(cut.startswith("{"), cut).otherwise(_error("not an array of records"))


def read_records(spark: SparkSession, path: str, schema: T.StructType, position: bool = False) -> DataFrame:
    """The records of all arrays below path; with position also file (its name) and nr (the byte where the record's piece begins).

    Elements must be objects, and each file one complete array (an empty file or array has no records); other
    files are an error. Fields that do not fit the schema are NULL, as in Spark's own reader.
    """
    pieces = _pieces(spark, path)
    placed = pieces.join(broadcast_if_small(_ranges(pieces)), RANGE).select(
        "file", "name", "block", "seq", "text", ((F.col("odd") + F.col("state")) % 2).alias("inside"), "flips",
        (F.col("offset") + F.col("at")).alias("nr"),
        (F.col("depth") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))).alias("before"),
        F.when(F.col("state") == 0, F.col("step0")).otherwise(F.col("step1")).alias("step"))
    placed = placed.withColumn("ends", ((F.col("inside") + F.col("flips")) % 2 == 0) & (F.col("before") + F.col("step") == 1))
    alone = F.col("ends") & (F.col("inside") == 0) & (F.col("before") <= 1)
    single = placed.where(alone).select("file", "name", "nr", F.concat(_record(F.col("text")), F.lit("}")).alias("json"))

    # what is left is numbered by the record ends before it: in the range, and in the ranges before
    rest = placed.where(~alone)
    ends = F.col("ends").cast("long")
    earlier = rest.groupBy(*RANGE).agg(F.sum(ends).alias("n")).select(*RANGE, _before(F.col("n"), Window.partitionBy("file").orderBy("block")).alias("earlier"))
    numbered = rest.withColumn("number", _before(ends, Window.partitionBy(*RANGE).orderBy("seq"))) \
        .join(broadcast_if_small(stored(earlier, "json-ends")), RANGE).withColumn("number", F.col("number") + F.col("earlier"))
    parts = F.array_sort(F.collect_list(F.struct("nr", "text")))
    joined = numbered.groupBy("file", "name", "number").agg(F.max("ends").alias("ends"), F.min("nr").alias("nr"), F.array_join(parts["text"], "}").alias("text"))
    tail = joined["text"].rlike(r"\A[\x{FEFF}\s]*\[?\s*\]?\s*\z")
    several = joined.where(F.when(joined["ends"], True).when(tail, False).otherwise(_error("not an array of records"))) \
        .select("file", "name", "nr", F.concat(_record(F.col("text")), F.lit("}")).alias("json"))

    parsed = single.unionByName(several).select(F.col("name").alias("_file"), F.col("nr").alias("_nr"), F.from_json("json", schema).alias("_record"))
    place = [F.col("_file").alias("file"), F.col("_nr").alias("nr")] if position else []
    return parsed.select(*place, *[F.col("_record")[f.name].alias(f.name) for f in schema.fields])
