"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join. The minimum is pre-aggregated; edges of a node with very many of them, such as the
centre of a star, meet it by broadcast where they are, so no task gets them all. Each round is written to the shared folder;
rounds grow with the logarithm of a component's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_each, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    least = least.where("n > 0").select("a", F.least("a", "least").alias("least"), "n")
    return join_each(both.where("b > a"), least, "a", total).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")


def _small(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    # a node with one edge has nothing to move
    moved = join_each(edges, least.where("n > 1"), "a", total).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).unionByName(moved)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b of an orderable type. Returns node, root for every node of an edge; root is the smallest of its component.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "edges")
    state = _state(edges)
    while state[0]:
        total = 2 * state[0]  # no step makes more edges
        large = stage(_large(edges, total).distinct(), "edges")  # written, as plans of both steps together grow large
        edges = stage(_small(large, total).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
