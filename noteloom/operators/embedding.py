"""Embedders as injected objects, and the standard and late ways to embed a note's passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import batches, bisect_spans, given_out, real, rows_of, units


class Embedder(Protocol):
    dims: int
    context_limit: int
    fingerprint: str

    def count(self, text: str) -> int: ...

    def encode(self, text: str) -> list[int]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def states(self, text: str) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A deterministic stand-in for a model: each code point has a pseudo-random state that its neighbours colour.

    Tokens are code points, with one special token before and one after.
    """

    dims: int = 64
    context_limit: int = 3584
    fingerprint: str = "hashing-v1"

    def count(self, text: str) -> int:
        return len(text) + 2

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def _state(self, token: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(self.dims)

    def states(self, text: str) -> list[list[float]]:
        own = {c: self._state(c) for c in set(text)}
        raw = np.array([self._state("<begin>"), *(own[c] for c in text), self._state("<end>")])
        mixed = raw.copy()
        mixed[1:] += 0.5 * raw[:-1]
        mixed[:-1] += 0.5 * raw[1:]
        return mixed.tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [pool(np.array(self.states(t)), 0, len(t) + 2).tolist() for t in texts]


def pool(states: np.ndarray, start: int, end: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Mean of the states in a half-open range, masked if wanted, scaled to unit length once."""
    if not 0 <= start < end <= len(states):
        raise ValueError("token range out of bounds")
    some = states[start:end]
    if mask is not None:
        held = mask[start:end]
        if not np.isin(held, (0, 1)).all() or not held.any():
            raise ValueError("a mask has zeros and ones, and one at least")
        some = some[held == 1]
    mean = some.mean(axis=0)
    size = float(np.sqrt((mean * mean).sum()))
    if not 0 < size < float("inf"):
        raise ValueError("vector norm is zero or not finite")
    return mean / size


def check_unit(vectors: list[list[float]], dims: int) -> list[list[float]]:
    for v in vectors:
        if len(v) != dims or not np.isfinite(v).all() or abs(float(np.linalg.norm(v)) - 1) > 1e-4:
            raise ValueError("an embedding must be finite, of full length and of unit norm")
    return vectors


def embed_texts(texts: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """(text, vector) for distinct texts, in batches that the model admits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = [v for some in batches(part[text].tolist(), embedder.context_limit, embedder.count) for v in check_unit(embedder.embed(some), embedder.dims)]
            yield pd.DataFrame({text: part[text], "vector": vectors})

    return texts.select(text).distinct().mapInPandas(run, f"{text} string, vector array<double>")


def reuse_vectors(new: DataFrame, old: DataFrame, body: str, vector: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(passages that take an old vector of the same body, passages still to embed). Of equal old bodies the last by ``order`` counts."""
    last = old.groupBy(body).agg(F.max_by(vector, order).alias(vector))
    joined = new.join(last, body, "left")
    return joined.where(F.col(vector).isNotNull()), joined.where(F.col(vector).isNull()).drop(vector)


def embed_passages(passages: DataFrame, embedder: Embedder, old: DataFrame | None = None) -> DataFrame:
    """Standard mode: a vector for each passage from its own body; equal bodies are embedded once, known ones not at all."""
    if old is None:
        return passages.join(embed_texts(passages, "body", embedder), "body")
    kept, missing = reuse_vectors(passages, old, "body", "vector", "passage_index")
    fresh = missing.join(embed_texts(missing, "body", embedder), "body")
    return kept.unionByName(fresh)


def embed_late(notes: DataFrame, passages: DataFrame, note: str, text: str, embedder: Embedder) -> DataFrame:
    """Late mode: each context window is encoded whole, and a passage's vector is the mean over its token range.

    Returns note_id, passage_index, vector. A note's passages travel with its text; each must get a vector.
    """
    plan = passages.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("passage_index", "window", "start_token", "end_token", "start", "end"))).alias("plan"))
    joined = notes.select(F.col(note).cast("string").alias("note_id"), F.col(text).alias("text")).join(plan, "note_id")

    schema = pa.schema([("note_id", pa.string()), ("passage_index", pa.int32()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors() -> Iterator[tuple]:
            for key, body, plan in rows_of(batches):
                held = units(body)
                windows = bisect_spans(held, embedder.context_limit, embedder.count)
                states: dict[int, np.ndarray] = {}
                for p in plan:
                    k = p["window"]
                    if k not in states:
                        states = {k: np.array(embedder.states(real(held[windows[k][0] : windows[k][1]])))}
                    yield key, p["passage_index"], pool(states[k], p["start_token"], p["end_token"])

        yield from given_out(vectors(), schema, lambda row: len(row[2]))

    return joined.mapInArrow(run, "note_id string, passage_index int, vector array<double>")


def embed_notes(notes: DataFrame, note: str, text: str, embedder: Embedder) -> DataFrame:
    """(note_id, mode, vector): the one window's vector, or the unit sum of all windows' vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, body in part.itertuples(index=False):
                held = units(body)
                spans = bisect_spans(held, embedder.context_limit, embedder.count)
                vectors = np.array([embedder.embed([real(held[a:b])])[0] for a, b in spans])
                total = vectors.sum(axis=0)
                rows.append((key, "direct" if len(spans) == 1 else "aggregated", (total / np.linalg.norm(total)).tolist()))
            yield pd.DataFrame(rows, columns=["note_id", "mode", "vector"])

    return notes.select(F.col(note).cast("string").alias("note_id"), F.col(text).alias("text")).mapInPandas(run, "note_id string, mode string, vector array<double>")
