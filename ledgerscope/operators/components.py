"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u")
    return (
        moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes, as a decimal: a sum of longs overflows beyond some 16 million edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Rows (node, component) for every node of links; component is the least node id of the part.

    Self-links and null ends are ignored, repeated links count once. An empty table
    gives an empty result. Each round is written to the shared folder; the test for
    the end is one count and one sum.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    edges = staged(edges, "edges")
    before = None
    for _ in range(max_rounds):
        edges = staged(_small_star(_large_star(edges)), "stars")
        state = _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
