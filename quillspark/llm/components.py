"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Workspace


#: At most so many nodes count as hot, and a node needs so many rows for it.
HOT_NODES, HOT_ROWS = 50_000, 256


def _with_least(rows: DataFrame, least: DataFrame, hot_rows: int) -> DataFrame:
    """Joins each node's least neighbour (u, m, n) to its rows.

    Nodes with more than ``hot_rows`` rows get theirs by a broadcast, so that no
    task has to read all rows of one; they are at most all rows / ``hot_rows``.
    """
    hot = F.broadcast(least.where(F.col("n") > hot_rows))
    others = rows.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hot_rows), "u")
    return rows.join(hot, "u").unionByName(others)


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _with_least(down, least, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) of each node with an edge; the component is its least node.

    edges: u, v (long). Self edges and repeated edges do no harm. Every node keeps
    one edge to a neighbour of less id each round; rounds are logarithmic in the
    longest chain. Minima are summed before the shuffle, and those of the at most
    ``HOT_NODES`` nodes with the most rows are broadcast (of two longs each).
    """
    now = space.save(edges.where("u != v").select("u", "v").distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if found == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, k = found, k + 1
        hot_rows = max(HOT_ROWS, 2 * found[0] // HOT_NODES)
        large = space.save(_large_star(now, hot_rows).where("u != v").distinct(), f"{name}-large-{k}")
        now = space.save(_small_star(large, hot_rows).where("u != v").distinct(), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}", f"{name}-large-{k}")
