"""Connected components of links by alternating stars, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, held, salted_group_min, settled


def _least_neighbours(near: DataFrame, few: bool) -> DataFrame:
    """near (a, b) plus m, the least b of each a: by broadcast where the edges were counted to be few, else in slices."""
    if few:
        return near.join(F.broadcast(near.groupBy("a").agg(F.min("b").alias("m"))), "a")
    return salted_group_min(near, ["a"], "b", "m", unique="b")


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star step: neighbours of a node (all, or the smaller ones) are linked to its least neighbour instead."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbours(near, few).withColumn("m", F.least("a", "m"))
        moved = least.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _least_neighbours(near, few)
        moved = least.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node's least reachable node, from edges (a, b) of longs.

    Large and small stars alternate until nothing moves (about the logarithm of the longest chain); stars of
    any size are met in slices. An empty table gives no rows; loops are ignored. The result is settled().
    """
    # tables hold distinct (a, b) with a > b: equal sizes and equal sums of hashes are the same sets
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = held(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(edges)
    while before[0]:
        few = 2 * before[0] <= BROADCAST_ROWS
        made = _star(_star(edges, True, few), False, few)
        new = settled(made.coalesce(2) if few else made)  # a plan that refers to itself four times a round must be cut each round
        after = sign(new)
        forget(edges)
        edges = new
        if before == after:
            break
        before = after
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = settled(found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    forget(edges)
    return roots
