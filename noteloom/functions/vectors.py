"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _usable(n: Column) -> Column:
    """The norm itself; zero, NaN and infinity are errors."""
    return F.when(finite(n) & (n > 0), n).otherwise(F.raise_error(F.lit("vector norm is zero or not finite")))


def clamp(s: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def cosine(a: Column, b: Column) -> Column:
    """Signed cosine in [-1, 1]; unequal lengths and unusable norms are errors."""
    value = dot(a, b) / _usable(norm(a)) / _usable(norm(b))
    return F.when(F.size(a) == F.size(b), clamp(value)).otherwise(F.raise_error(F.lit("vectors differ in length")))


def cosine_to(v: Column, query: Sequence[float]) -> Column:
    """Cosine to one fixed vector, a literal of the plan: no join, and the query's norm is taken once."""
    fixed = [float(x) for x in query]
    size = sum(x * x for x in fixed) ** 0.5
    if not 0 < size < float("inf"):
        raise ValueError("query vector norm is zero or not finite")
    value = dot(v, F.lit(fixed)) / _usable(norm(v)) / F.lit(size)
    return F.when(F.size(v) == len(fixed), clamp(value)).otherwise(F.raise_error(F.lit("vectors differ in length")))


def checked_similarity(s: Column) -> Column:
    """A store's similarity: within 1e-4 of [-1, 1], clamped to it; anything else is an error."""
    return F.when(finite(s) & (F.abs(s) <= 1.0001), clamp(s)).otherwise(F.raise_error(F.lit("similarity out of range")))


def is_unit(v: Column, dims: int) -> Column:
    return F.coalesce((F.size(v) == dims) & F.forall(doubles(v), finite) & (F.abs(norm(v) - 1) <= 1e-4), F.lit(False))


def normalized(v: Column) -> Column:
    length = _usable(norm(v))
    return F.transform(F.array(length), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def aggregate_vectors(df: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """Unweighted sum of each group's vectors, scaled to unit length.

    One partial sum for each component: rows are combined before the shuffle and never multiplied by the dimensions.
    """
    held = F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(F.lit("vectors differ in length")))
    sums = df.withColumn(vector, held).groupBy(*keys).agg(*[F.sum(F.get(vector, i).cast("double")).alias(f"_{i}") for i in range(dims)])
    return sums.select(*keys, normalized(F.array(*[F.col(f"_{i}") for i in range(dims)])).alias(vector))


def pool_ranges(tokens: DataFrame, ranges: DataFrame, window: str, position: str, state: str, dims: int) -> DataFrame:
    """Mean of the token states in each half-open range [start_token, end_token) of a window, scaled to unit length once.

    ``tokens`` has the window, position, state and optionally a mask of 0 or 1; ``ranges`` has window, passage_index,
    start_token and end_token. Tokens meet the ranges of their own window only.
    """
    kept = tokens.where(F.col("mask") == 1) if "mask" in tokens.columns else tokens
    inside = (F.col(position) >= F.col("start_token")) & (F.col(position) < F.col("end_token"))
    met = kept.select(window, position, state).join(ranges, window).where(inside)
    means = met.groupBy(window, "passage_index").agg(*[F.avg(F.get(state, i).cast("double")).alias(f"_{i}") for i in range(dims)])
    return means.select(window, "passage_index", normalized(F.array(*[F.col(f"_{i}") for i in range(dims)])).alias("vector"))
