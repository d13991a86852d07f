"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut, few


def _star(edges: DataFrame, small: bool, rows: int) -> DataFrame:
    """One large-star or small-star step over some `rows` edges (a, b), a > b."""
    around = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy(F.col("a").alias("hub")).agg(F.least(F.min("b"), F.col("hub")).alias("least"))
    near = few(around.join(least, around["a"] == least["hub"]), 2 * rows)  # a hub of many edges is split by AQE's skew join
    if small:
        kept = near.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        return few(kept.unionByName(few(least.select(F.col("hub").alias("a"), F.col("least").alias("b")), rows)).distinct(), 2 * rows)
    return few(near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct(), 2 * rows)


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and component (the least node reachable) of every node of edges (a, b: long);
    alternates large and small stars, with a checkpoint each, until nothing moves. Few edges go through few tasks."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            edges = few(edges, seen[0])
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = seen
        edges = few(edges, seen[0])
        edges = cut(_star(_star(edges, False, seen[0]), True, seen[0]))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
