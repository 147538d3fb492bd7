"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import stage

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of the component, for every node of an edge.

    ``edges`` has two columns of one orderable type. Self-loops, repeated edges and nulls are
    ignored; no edge gives no row. Minima are partial aggregates and the joins are on the node,
    where adaptive execution splits a node that holds many edges. Each round is a written table
    in the shared folder; about log2(n)^2 rounds at worst, three to five in practice.
    """
    first, second = edges.columns
    now = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a != b")
    now = stage(now.distinct(), "edges")
    seen = _mark(now)
    if seen[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        spread = _large_star(now).filter("a != b")
        now = stage(_small_star(spread).filter("a != b").distinct(), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
