"""Connected components of links, by label propagation to stars.

Each round joins every node's links with the smallest label near it, on both
sides of a link (large star, then small star), until no label changes. Links,
labels and components stay in Spark; the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """`edges` (u, v): each node's neighbours (the larger, or the smaller and itself) linked to the smallest near it."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v; any order, repeats and
    loops allowed): component is the smallest node that it reaches.

    A hot node is no hot task: per node only a minimum is gathered, before the
    shuffle already, and joins split what is skewed. Rounds grow with the
    logarithm of the longest chain."""
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "links")
    print_of = None
    while True:
        now = stage(_stars(_stars(now, True), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == print_of:
            break
        print_of = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
