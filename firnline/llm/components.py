"""Connected components of a graph given by its edges, by repeated contraction.

In each round every node joins the one among itself and its neighbours that comes first in a random
order drawn for the round; edges are rewritten to the joined nodes and repeats dropped, until no edge
is left. The number of edges falls by a constant factor per round in expectation, whatever the shape
of the graph. Each round is stored in the shared folder; only the number of edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node that it is connected with.

    Repeated edges and edges from a node to itself are allowed; NULL ends are not.
    """
    links = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "graph-links")
    found = stored(edges.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("node")).distinct().withColumn("top", F.col("node")), "graph-nodes")
    turn = 0
    while not links.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("n"))  # noqa: E731, B023
        ways = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        joins = ways.groupBy("u").agg(F.min(order(F.col("v"))).alias("v"))
        joins = stored(joins.select("u", F.least(order(F.col("u")), F.col("v"))["n"].alias("to")), "graph-joins")
        left = links.join(joins.select(F.col("u").alias("a"), F.col("to").alias("to_a")), "a")
        both = left.join(joins.select(F.col("u").alias("b"), F.col("to").alias("to_b")), "b")
        ends = both.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links = stored(ends.distinct(), "graph-links")
        moved = found.join(joins.select(F.col("u").alias("top"), "to"), "top", "left")
        found = stored(moved.select("node", F.coalesce("to", "top").alias("top")), "graph-nodes")
    least = stored(found.groupBy("top").agg(F.min("node").alias("component")), "graph-least")
    return stored(found.join(least, "top").select("node", "component"), "graph-components")
