"""Exact nearest vectors without a full scan: vectors laid out by pivot, parts ruled out by the triangle inequality.

Each vector belongs to its nearest pivot and there to one of a few rings of growing distance, so a part (pivot and ring)
is a folder with a known range of distances to its pivot. A query's distances to the pivots bound its distance to
everything in a part from below. Parts are read nearest bound first; the search ends when the bounds of all unread parts
exceed the distance of the k-th vector found, which proves the answer. Distances are chords between unit vectors, a metric
in which nearest means greatest cosine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import checked_similarity, cosine_to
from ..sources.commit_index import CommitIndex
from ..sources.store import SnapshotStore

#: Pivots and rings of a segment, and vectors that the pivots are chosen from. They bound the parts, and so what a search
#: holds on the driver.
PIVOTS, RINGS, SAMPLE = 64, 8, 4096
#: Parts of the first round; each further one reads twice as many.
FIRST_PARTS = 8
#: Chords are roots of differences: of nearly equal vectors they are good to some 1e-8.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorHits:
    """The nearest rows, and how many parts and vectors there are and were read."""

    hits: DataFrame
    parts: int
    read: int
    vectors: int
    scored: int


def chosen_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the sampled unit vectors, each the farthest from those before; the first is the farthest from the mean."""
    if not len(sample):
        return np.zeros((0, 0))
    apart = np.linalg.norm(sample - sample.mean(axis=0), axis=1)
    found = [int(apart.argmax())]
    left = np.linalg.norm(sample - sample[found[0]], axis=1)
    while len(found) < min(n, len(sample)) and left.max() > SLACK:
        found.append(int(left.argmax()))
        left = np.minimum(left, np.linalg.norm(sample - sample[found[-1]], axis=1))
    return sample[found]


def _placed(vector: Column, pivots: np.ndarray) -> Column:
    """(pivot, distance) of the nearest pivot."""

    @F.pandas_udf("pivot int, distance double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"pivot": [], "distance": []})
        v = np.stack(vectors).astype(float)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = (unit @ pivots.T).argmax(axis=1)
        return pd.DataFrame({"pivot": near, "distance": np.linalg.norm(unit - pivots[near], axis=1)})

    return place(vector)


class VectorIndex(CommitIndex):
    """Pivot layout of a store's note or passage vectors. Vectors without a direction (null, zero, not finite) are not in it."""

    KIND = "vectors"

    def __init__(self, store: SnapshotStore, generation: int, kind: str = "notes"):
        super().__init__(store, generation)
        self.kind = kind
        self.root = f"{store.root}/{self.KIND}/{kind}/generation={generation}"
        self.keys = ["note_id"] if kind == "notes" else ["note_id", "passage_id"]

    def build(self, folder: str, commit: str, before: list[str]) -> None:
        rows = self.store.read_at(self.kind, self.generation, [commit]).select(*self.keys, F.col("vector").cast("array<double>").alias("vector"))
        length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
        usable = rows.where((F.size("vector") > 0) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False)))
        # A bounded sample, drawn by hash: whatever it holds, the answers stay exact.
        drawn = usable.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()
        sample = np.array([r["vector"] for r in drawn])
        pivots = chosen_pivots(sample / np.linalg.norm(sample, axis=1, keepdims=True), PIVOTS) if len(drawn) else np.zeros((0, 1))
        placed = usable.withColumn("p", _placed(F.col("vector"), pivots)).select(*self.keys, "vector", "p.pivot", "p.distance")
        # Rings cut each pivot's distances at quantiles: one row for each pivot.
        cuts = placed.groupBy("pivot").agg(F.percentile_approx("distance", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
        ringed = placed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col("distance") > c).cast("int"))).drop("cuts")
        ringed.hint("rebalance", F.col("pivot"), F.col("ring")).write.partitionBy("pivot", "ring").parquet(f"{folder}/rows")
        written = self.spark.read.schema(ringed.schema).parquet(f"{folder}/rows")
        parts = written.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
        parts.coalesce(1).write.parquet(f"{folder}/parts")
        centres = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "pivot int, centre array<double>")
        centres.coalesce(1).write.parquet(f"{folder}/pivots")

    def schema(self, name: str) -> str | None:
        note = self.kinds(self.store.commits(self.generation), *self.keys)
        return ", ".join(f"{k} {t}" for k, t in zip(self.keys, note)) + ", vector array<double>, distance double, pivot int, ring int" if name == "rows" else None

    def nearest(self, query: Sequence[float], k: int, where: Column | None = None, tie: Sequence[str] | None = None) -> VectorHits:
        """The k live rows of the newest snapshot with the greatest cosine to the query: (keys, score), ties by the keys or ``tie``.

        ``where`` is a condition on the keys. Vectors of another length than the query's are an error.
        """
        if k < 1:
            raise ValueError("a limit must be positive")
        commits, tie = self.refresh(), list(tie or self.keys)
        q = np.asarray(query, float)
        size = np.linalg.norm(q)
        if not 0 < size < float("inf"):
            raise ValueError("query vector norm is zero or not finite")
        rows = self.table("rows", commits)
        # Both tables are bounded by the pivots and rings of at most a few commits.
        centres = {(r["segment"], r["pivot"]): np.array(r["centre"]) for r in self.table("pivots", commits).collect()}
        parts = [(r["segment"], r["pivot"], r["ring"], r["n"], r["low"], r["high"]) for r in self.table("parts", commits).collect()]
        away = {key: float(np.linalg.norm(q / size - c)) for key, c in centres.items()}
        closest: dict[int, float] = {}
        for (segment, _), d in away.items():
            closest[segment] = min(d, closest.get(segment, d))

        def bound(part: tuple) -> float:
            segment, pivot, _, _, low, high = part
            d = away[segment, pivot]
            # A row is no nearer than its ring's edge; and it is nearer to its own pivot than to the one next to the query.
            return max(low - d, d - high, (d - closest[segment]) / 2, 0.0)

        queue = sorted((bound(p), *p) for p in parts)
        columns = [*self.keys, "score"]
        found: list[tuple] = []
        done, take, scored = 0, FIRST_PARTS, 0
        schema = rows.select(*self.keys, F.lit(0.0).alias("score")).schema
        while done < len(queue):
            reach = (2 - 2 * found[-1][-1]) ** 0.5 if len(found) == k and found[-1][-1] < 1 else 0.0 if len(found) == k else float("inf")
            some = [p for p in queue[done : done + take] if p[0] <= reach + SLACK]
            if not some:
                break
            names = [f"{s}:{p}:{r}" for _, s, p, r, *_ in some]
            pruned = rows.where(F.col("pivot").isin(sorted({p[2] for p in some})) & F.col("ring").isin(sorted({p[3] for p in some})))
            mine = self.live(pruned.where(F.concat_ws(":", "segment", "pivot", "ring").isin(names)), commits)
            mine = mine if where is None else mine.where(where)
            near = mine.select(*self.keys, checked_similarity(cosine_to(F.col("vector"), q.tolist())).alias("score"))
            both = near if not found else near.unionByName(self.spark.createDataFrame(found, schema))
            found = [tuple(r) for r in both.orderBy(F.desc("score"), *tie).limit(k).select(columns).collect()]
            scored += sum(p[4] for p in some)
            done, take = done + len(some), take * 2
        return VectorHits(self.spark.createDataFrame(found, schema), len(queue), done, sum(p[4] for p in queue), scored)
