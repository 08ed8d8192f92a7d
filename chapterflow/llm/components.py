"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chapterflow.llm.common import Scratch


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of an edge (a, b); a component is named by its smallest node.

    Each round joins every node's edges with the smallest neighbour, first
    for the larger neighbours, then for the smaller ones, and is written as a
    table; rounds grow with the logarithm of the longest path. Minima are
    pre-aggregated, and no node's neighbours are gathered.
    """
    found = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    found, before, k = scratch.store(f"{name}0", found), None, 0
    while (now := _checksum(found)) != before and now[0]:
        before, k = now, k + 1
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        found = scratch.store(f"{name}{k}", hung.where("u <> v").distinct())
        scratch.drop(f"{name}{k - 1}")
    return found.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()
