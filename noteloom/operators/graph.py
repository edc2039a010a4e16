"""Similarity graphs over the listed results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..schema import EDGE_CUTOFF, RESULT_CAP

CENTRE_X, CENTRE_Y = 180.0, 140.0
SINGLE_RING, INNER_RING, OUTER_RING, INNER_NOTES = 105.0, 60.0, 116.0, 10


def _listed(results: DataFrame, note: str) -> int:
    """Number of listed notes, checked: at most thirty, each once."""
    n, distinct = results.agg(F.count("*"), F.count_distinct(note)).first()
    if n > RESULT_CAP:
        raise ValueError("a graph has at most thirty listed notes")
    if n != distinct:
        raise ValueError("a note is listed twice")
    return n


def star_graph(results: DataFrame, anchor, note: str) -> DataFrame:
    """Edges from the anchor to each result, with the retrieval score as cosine; a score out of range is an error."""
    _listed(results, note)
    ok = ~F.isnan("score") & (F.col("score") >= -1) & (F.col("score") <= 1)
    score = F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("invalid connection score")))
    return results.select(F.lit(anchor).alias("source"), F.col(note).alias("target"), score.alias("cosine"))


def complete_graph(results: DataFrame, vectors: DataFrame, note: str, keys: list[str], vector: str) -> DataFrame:
    """Cosine of every pair of listed notes (435 at most), from the lower rank to the higher.

    The stored vectors must match the listed notes one to one on ``keys``. Both sides are the thirty listed rows.
    """
    n = _listed(results, note)
    held = vectors.join(F.broadcast(results.select(*keys, "rank")), keys)
    met, distinct = held.agg(F.count("*"), F.count_distinct("rank")).first()
    if met != n or distinct != n:
        raise LookupError("stored vectors do not match the listed notes")
    left = held.select(F.col(note).alias("source"), F.col("rank").alias("source_rank"), F.col(vector).alias("a"))
    right = F.broadcast(held.select(F.col(note).alias("target"), F.col("rank").alias("target_rank"), F.col(vector).alias("b")))
    return left.join(right, F.col("source_rank") < F.col("target_rank")).select("source", "target", "source_rank", "target_rank", cosine(F.col("a"), F.col("b")).alias("cosine"))


def edges_above(edges: DataFrame, cutoff: float = EDGE_CUTOFF) -> DataFrame:
    if not (math.isfinite(cutoff) and -1 <= cutoff <= 1):
        raise ValueError("an edge cutoff lies in [-1, 1]")
    return edges.where(F.col("cosine") >= cutoff)


def ring_layout(results: DataFrame, note: str) -> DataFrame:
    """Places on rings by rank: one ring up to ten notes, else the first ten inside and the rest outside."""
    n = _listed(results, note)
    place = F.col("rank") - 1
    inner = place < INNER_NOTES
    count = F.when(inner, min(n, INNER_NOTES)).otherwise(max(1, n - INNER_NOTES))
    angle = F.lit(-math.pi / 2) + F.when(inner, place).otherwise(place - INNER_NOTES) * (2 * math.pi) / count
    radius = F.lit(SINGLE_RING) if n <= INNER_NOTES else F.when(inner, INNER_RING).otherwise(OUTER_RING)
    return results.select(note, "rank", (F.lit(CENTRE_X) + F.cos(angle) * radius).alias("x"), (F.lit(CENTRE_Y) + F.sin(angle) * radius).alias("y"))


def strongest_pairs(edges: DataFrame) -> DataFrame:
    """The strongest edge at each node: (note, other, cosine); among equals the one that comes first in edge order."""
    order = ["source_rank", "target_rank"]
    ends = edges.select(F.col("source").alias("note"), F.col("target").alias("other"), "cosine", *order).unionByName(edges.select(F.col("target").alias("note"), F.col("source").alias("other"), "cosine", *order))
    w = Window.partitionBy("note").orderBy(F.desc("cosine"), *order)
    return ends.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("note", "other", "cosine")


def placed_edges(edges: DataFrame, places: DataFrame, note: str, anchor=None) -> DataFrame:
    """Edges with the places of both ends (x1, y1, x2, y2); the anchor stands in the centre, and an end without a place is an error.

    Places are the thirty listed notes at most, which is checked, so both joins broadcast them.
    """
    _listed(places, note)
    at = places.select(F.col(note).alias("_note"), "x", "y")
    if anchor is not None:
        centre = at.sparkSession.range(1).select(F.lit(anchor).alias("_note"), F.lit(CENTRE_X).alias("x"), F.lit(CENTRE_Y).alias("y"))
        at = at.where(F.col("_note") != F.lit(anchor)).unionByName(centre)
    placed = edges
    for end, i in (("source", 1), ("target", 2)):
        own = F.broadcast(at.select(F.col("_note").alias(end), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")))
        placed = placed.join(own, end, "left").withColumn(f"x{i}", F.coalesce(f"x{i}", F.raise_error(F.lit("an edge ends at a note without a place")).cast("double")))
    return placed.select(*edges.columns, "x1", "y1", "x2", "y2")
