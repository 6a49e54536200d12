"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


#: Parts that a node's edges are split into: a hub's edges go to so many tasks, and its least neighbour to each of them.
PARTS = 32


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with their part, and for each (u, part) that has edges the least of u's neighbours, over all parts."""
    parted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    by_part = parted.groupBy("u", "part").agg(F.min("v").alias("m"))
    return parted, by_part.select("u", "part").join(by_part.groupBy("u").agg(F.min("m").alias("m")), "u")


def _rewired(edges: DataFrame) -> DataFrame:
    """Large star: every node's greater neighbours move to the least node of its neighbourhood."""
    both, least = _least(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where("v > u").join(least, ["u", "part"]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _lowered(edges: DataFrame) -> DataFrame:
    """Small star: a node and its lesser neighbours all link to the least of these."""
    down, least = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.join(least, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Returns (node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Edges may repeat and name a node with itself; null ends are left out. Each round is written to the shared folder.
    The number of rounds follows the logarithm of the component size. A hub's edges stay in PARTS parts,
    each with its own minimum; only these meet.
    """
    nodes = edges.where("u is not null and v is not null").select("u", "v")
    now = saved(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        now = saved(_lowered(_rewired(now)), "edges")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, and no v is a u: then each v is the least node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)).distinct())
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up > 0 and least = 0)").isEmpty()
