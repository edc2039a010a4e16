"""Embedding whitening: MLlib's computeSVD on centred distributed rows, singular values rescaled by divisor n.

Vectors become whole numbers first, so sums, the centring and the total variance are exact whatever the order of the
rows; only the decomposition and the projection are floating point. The squared singular values of the centred rows,
over n, are the eigenvalues of their covariance. The share that a component explains is held against the total
variance, which is computed by itself from exact deviations. Rows are read in a few aggregates and never shuffled; the
driver holds sums, components and the Gram matrix of MLlib, all bounded by the width of a vector.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

SCALE, SHIFT = 1024, 100_000
#: A component whose singular value is less than this share of the first is rounding noise and is left out.
LEAST_SHARE = 1e-6


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: rows, exact sums and total variance, eigenvalues (falling) and unit components (a row each)."""

    n: int
    sums: tuple[int, ...]
    total: Fraction
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """Width by components: a centred vector times this is whitened."""
        return self.components.T / np.sqrt(self.eigenvalues)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null, not empty and holds finite numbers only, with ``x``: the scaled whole numbers.

    Vectors must have one width: that which most of these rows have (the greater of equals). Others count as holding
    missing entries and are left out.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    whole = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(F.forall(vector_col, entry))
    widths = whole.groupBy(F.size(vector_col).alias("width")).count().agg(F.max_by("width", F.struct("count", "width"))).first()[0]
    scaled = F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    return whole.where(F.size(vector_col) == F.lit(widths or 0)).withColumn("x", scaled)


def deviations(x: Column, n: int, sums: tuple[int, ...]) -> Column:
    """n*x - S for each dimension, as whole numbers."""
    totals = F.array(*[F.lit(s).cast("long") for s in sums])
    return F.zip_with(x, totals, lambda v, s: v * F.lit(n).cast("long") - s)


def squared_deviation(x: Column, n: int, sums: tuple[int, ...]) -> Column:
    """Sum of the squared deviations, exact: up to 38 digits."""
    wide = lambda v: v.cast("decimal(19,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(deviations(x, n, sums), zero, lambda t, v: (t + wide(v) * wide(v)).cast("decimal(38,0)"))


def centred(x: Column, n: int, sums: tuple[int, ...]) -> Column:
    """x - S/n in doubles; the difference is taken in whole numbers, so nothing cancels."""
    return F.transform(deviations(x, n, sums), lambda v: v.cast("double") / F.lit(float(n)))


def fit(rows: DataFrame) -> Whitening:
    """Components of all rows of ``x``. Without rows, or where all rows are equal, there are none."""
    width = rows.select(F.size("x")).first()
    if width is None:
        return Whitening(0, (), Fraction(0), np.empty(0), np.empty((0, 0)))
    d = width[0]
    n, *sums = rows.agg(F.count("*"), *[F.sum(F.get("x", F.lit(i))) for i in range(d)]).first()
    sums = tuple(sums)
    spread = rows.agg(F.sum(squared_deviation(F.col("x"), n, sums))).first()[0]
    total = Fraction(int(spread), n**3)
    if not total:
        return Whitening(n, sums, total, np.empty(0), np.empty((0, d)))
    vectors = rows.select(array_to_vector(centred(F.col("x"), n, sums)).alias("v"))
    # All d values are asked for: MLlib then decomposes the Gram matrix to double precision instead of by iteration.
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, d).computeSVD(d, computeU=False, rCond=LEAST_SHARE)
    return Whitening(n, sums, total, np.asarray(svd.s.toArray()) ** 2 / n, np.asarray(svd.V.toArray()).T)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """The rows with ``whitened``: their centred ``x`` on each component, over the root of its eigenvalue."""
    weights = model.matrix

    @pandas_udf("array<double>")
    def onto(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors) @ weights) if len(vectors) else [], dtype=object)

    return rows.withColumn("whitened", onto(centred(F.col("x"), model.n, model.sums)))


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (k numbers, centred in the aggregate, divisor n) minus the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    entries = [F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i + 1)]
    return projected.agg(F.array_max(F.array(*entries))).first()[0]


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each usable vector and component, components numbered from 1 by falling eigenvalue up to ``k``, signs
    arbitrary but the same for all rows. Vectors that are null, empty, of another width than most, or hold null or
    non-finite entries take no part. Repeated rows and rows with a null id are rows of their own; other columns are not
    read. Fewer components come where the vectors span fewer dimensions; none for an empty table or equal vectors.
    A deviation that exceeds 64 bits is null. A number beyond about 9e15 in a vector exceeds 64 bits and is an error.
    """
    rows = usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_vector")), "_vector").select("vec_id", "x")
    model = fit(rows)
    found = min(k, len(model.eigenvalues))
    if not found:
        kind = rows.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    model = Whitening(model.n, model.sums, model.total, model.eigenvalues[:found], model.components[:found])
    projected = project(rows, model)
    error = identity_error(projected, found)
    explained = F.array(*[F.lit(float(Fraction(float(e)) / model.total)) for e in model.eigenvalues])
    deviation = squared_deviation(F.col("x"), model.n, model.sums).try_cast("long")
    each = projected.select("vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
