"""Distances between vectors, as Catalyst expressions (no Python in the plan) and as NumPy kernels.

Sums run in double precision, in order of the index, so results don't depend on partitioning. Inputs are arrays of
numbers; a null vector gives a null distance, and so do vectors of different dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12  # vectors whose squared norm is no larger are left as they are


def vector(values: Sequence[float]) -> Column:
    """A literal vector, of single precision as stored vectors are."""
    return F.array(*[F.lit(float(np.float32(v))) for v in values])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(_double(a), lambda x: x * x))


def normalize(a: Column) -> Column:
    """Unit length, unless the squared norm is at most 1e-12."""
    n = norm_squared(a)
    inverse = F.when(n > TINY, F.lit(1.0) / F.sqrt(n)).otherwise(F.lit(1.0))
    return F.transform(_double(a), lambda x: x * inverse)


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences; no root is taken."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    """1 - a.b, which may be negative."""
    return F.lit(1.0) - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - a.b of the normalized vectors; exactly 1 where either is zero."""
    return inner_product(normalize(a), normalize(b))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": squared_l2, "cosine": cosine, "inner_product": inner_product}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def similarity(d: Column) -> Column:
    """1 / (1 + distance); null where the distance is -1 or less."""
    return F.when(d > -1, F.lit(1.0) / (F.lit(1.0) + d))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, by the same rule as ``normalize``."""
    n = np.einsum("ij,ij->i", x, x)
    return x * np.where(n > TINY, 1 / np.sqrt(np.maximum(n, TINY)), 1.0)[:, None]


def kernel(metric: str, queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every query to every row of x, by one matrix product."""
    if metric == "euclidean":
        return np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", x, x)[None, :] - 2 * (queries @ x.T)
    return 1 - queries @ x.T


def pairs(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, without the cancellation of the matrix form."""
    if metric == "euclidean":
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    return 1 - np.einsum("ij,ij->i", a, b)
