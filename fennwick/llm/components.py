"""Connected components by alternating large-star and small-star steps; labels and edges never reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import materialize

MAX_ROUNDS = 60


def _least(rows: DataFrame, least: Column) -> DataFrame:
    """(a, m) of each node; written, so that the join with it deals both sides itself and can split a hub's edges."""
    return materialize(rows.groupBy("a").agg(least.alias("m")), "cc-least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both, F.least(F.min("b"), F.col("a"))), "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, F.min("b"))
    met = down.join(least, "a")
    return met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge table (a, b) of longs; the root is the smallest node reachable.

    Each round is written to the shared folder. Loops and repeated edges are harmless; no edges give no rows.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state = _state(current)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        current = materialize(_small_star(_large_star(current)), "cc-round")
        before, state = state, _state(current)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
