"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two aggregations with partial sums and two joins; rounds are written to the
shared folder, so a lost executor costs one round at most. The number of rounds grows with
the square of the logarithm of the longest path; no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import dropped, stored, tables_stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are linked to the least of them; edges have a < b."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    moved = edges.join(least, F.col("b") == F.col("u")).filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, from columns a and b; root is the least node reachable.

    Self-edges and repeated edges change nothing; an empty table gives no rows."""
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    n, spark = -1, edges.sparkSession
    while True:
        since = tables_stored(spark) - 1  # the table of edges is the last one
        after = stored(_small_star(_large_star(edges)), "edges")
        done = (m := after.count()) == n and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        dropped(spark, since, keep=1)
        edges, n = after, m
        if done:  # the same edges as before
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select("a", F.col("a").alias("root")).distinct())
