"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is aggregations and joins on the edges only: no neighbour list is ever collected, and the
edge table is checkpointed to the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, compact


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these. Edges must have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b")


#: Edges a task should have at least; small edge tables are not spread over many tiny files.
EDGES = 20_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge. `edges` has a and b; loops and repeats do no harm."""
    now = compact(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        tasks = 1 + mark[0] // EDGES
        now = checkpointed(_small_star(_large_star(now).coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
