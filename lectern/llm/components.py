"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise, materialise_told


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    told = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of one ordered type -> (node, component): the least node reachable, for every node with an edge.

    Nulls are not nodes; self-loops and repeated edges change nothing; no
    edges give no rows.  A node of any degree is met by minima that combine
    map-side and by a join with one row a node, never gathered in one task.
    Each round is written to the shared folder; it ends when two rounds agree,
    which needs about the logarithm of the longest path.
    """
    now = materialise(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        after, seen = materialise_told(_small_star(_large_star(now)), "stars", n=F.count(F.lit(1)), all=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        discard(now.sparkSession, now)
        now = after
        if seen == mark or not seen["n"]:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
