"""Vector expressions over array columns; arithmetic is done in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x))


def normalize(vector: Column) -> Column:
    """The unit vector; NULL for the zero vector, which has no direction."""
    # The length is bound to a name, or every element would take it anew.
    scaled = lambda length: F.when(length > 0, F.transform(as_double(vector), lambda x: x / length))
    return F.element_at(F.transform(F.array(norm(vector)), scaled), 1)


def cosine_similarity(left: Column, right: Column) -> Column:
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def cosine_distance(left: Column, right: Column) -> Column:
    return 1.0 - cosine_similarity(left, right)


def distance_to(vector: Column, target: list[float]) -> Column:
    """Cosine distance to one fixed vector, a matrix product per Arrow batch; NULL for the zero vector or another length."""
    fixed = np.asarray(target, dtype=float)
    length = float(np.sqrt(fixed @ fixed))

    @F.pandas_udf(DoubleType())
    def distance(vectors: pd.Series) -> pd.Series:
        fits = np.array([v is not None and len(v) == len(fixed) for v in vectors], dtype=bool)
        found = np.full(len(vectors), np.nan)
        if fits.any() and length:
            rows = np.vstack(vectors[fits].to_numpy()).astype(float)
            lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            with np.errstate(divide="ignore", invalid="ignore"):
                found[fits] = np.where(lengths > 0, 1.0 - rows @ fixed / (lengths * length), np.nan)
        return pd.Series(np.round(found, 12)).astype(object).where(~np.isnan(found), None)

    return distance(vector)


def is_valid_vector(vector: Column, size: int) -> Column:
    """Right length, no NULL, no NaN, no infinity. NULL vectors are not valid."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))
