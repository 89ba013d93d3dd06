"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with the least neighbour m of u. Both sides are read from tables, so AQE can split a hub."""
    return rows.join(written(least, "least"), "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node that it reaches) for every node with an edge.

    edges: columns a > b, any orderable type; none may be null. Every round is written to the shared
    folder. A round's stars keep connectivity and end, after a number of rounds that grows with the
    logarithm of the size, in one star around each component's least node.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_stars(both.filter("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        rows = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        small = _stars(rows, least).filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(rows.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
