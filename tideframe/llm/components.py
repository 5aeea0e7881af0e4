"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm import common

FEW_EDGES = 200_000  # up to which the nodes' minima are sent to all tasks
FEW_FILES = 8  # in which so many edges are written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame, side) -> DataFrame:
    """Each node sends its larger neighbours to its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = side(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, side) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(side(least), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node that a path reaches.

    Minima are combined before each shuffle, so a node with very many neighbours costs no more than others. Those of a small
    graph are broadcast, and its edges stay in a few files, so that a round costs little however many partitions a shuffle has.
    Those of a large one are written, so that both sides of a join are plain shuffles, which adaptive execution splits where
    a node's edges fill a partition. Each round is a written table.
    """
    edges = common.written(edges.select("a", "b").where("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        side = F.broadcast if before[0] <= FEW_EDGES else common.written
        half = _large_star(edges, side)
        edges = _small_star(half if side is F.broadcast else common.written(half.distinct()), side)
        edges = common.written(edges, partitions=FEW_FILES if side is F.broadcast else None)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
