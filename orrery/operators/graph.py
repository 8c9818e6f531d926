"""Graph operators on edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.durable import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component): each node that has an edge, with the smallest node that it reaches.

    Alternates large-star and small-star rewrites, which never add edges and
    end after a number of rounds that is logarithmic in the longest path.
    Minima are combined before the shuffle; nodes of very high degree go
    through plain equi-joins, whose large partitions adaptive execution
    splits. Self-loops give a component of one node; edges
    with a null end are ignored; an empty table gives an empty result.
    """
    pairs = cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null").distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, mark = cut(links.distinct()), None
    while mark != (now := _mark(links)):
        mark = now
        links = cut(_small_star(_large_star(links)))
    return (
        nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left")
        .groupBy("node")
        .agg(F.min("v").alias("v"))
        .select("node", F.coalesce("v", "node").alias("component"))
    )


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked to through any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
