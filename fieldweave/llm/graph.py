"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.storage import drop, stage_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is its component's smallest node.

    Each round points every node at the smallest node it is joined to, for its larger and then
    its smaller neighbours. Rounds end when each node is a root or points at one, which may be so from the first; their number grows with the
    logarithm of the longest path. The state of a round is a table in shared storage, deleted once the next one is written, so
    lineage stays short and lost executors cost no earlier round.
    """
    state, path = stage_at(_oriented(edges).distinct(), "stars")
    while not _settled(state):
        after, new = stage_at(_small_star(_large_star(state)), "stars")
        drop(path)
        state, path = after, new
    stars = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) once ``edges`` (a, b) join the components of ``roots`` (node, root); only edges between components take part in rounds."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = components(between)
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return known.unionByName(moved.join(roots, "node", "left_anti"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))


def _large_star(state: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of the node and its neighbours."""
    both = state.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(state.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
    # Only the edges from a node to its larger neighbours move.
    return state.join(least, state.lo == least.node).where("hi <> m").select("hi", F.col("m").alias("lo")).distinct()


def _small_star(state: DataFrame) -> DataFrame:
    """Joins each node's smaller neighbours, and the node, to the smallest of them."""
    least = state.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = state.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _settled(state: DataFrame) -> bool:
    """Whether each node points at one other, if any, which points at none."""
    ends = state.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(state.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    told = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not told.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).first()[0]
