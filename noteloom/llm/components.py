"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs; a component is named by its least node.

    Each step's edges are written, so lineage stays short; the number of steps grows with the logarithm of the size.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        after = materialize(_small_star(materialize(_large_star(edges))))
        drop_materialized(edges)
        edges, before = after, mark
        mark = _mark(edges)
        if mark == before:
            break
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
