"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a partial aggregation (the smallest neighbour per node) and a join
back, never a list of neighbours, so a node with any number of links is spread
over tasks: the aggregation merges before its shuffle and the join is one Spark's
skew join can split. Rounds grow with the logarithm of the nodes; each is written
to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a > b)."""
    if large:
        # every neighbour above a node hangs below the smallest of the node's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        above = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
        moved = above.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # every neighbour below a node, and the node, hang below the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = below.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges of longs to (node, root): root is the smallest node reachable. Nodes without edges are left out.

    Loops and repeated edges are ignored; null ends are dropped; no edges give an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges = store(_star(_star(edges, large=True), large=False), "stars")
        # A forest of stars is a fixed point; its edge count and sums no longer change.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
