"""Parameter rules of indexes, and the seeded level draw."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1


def recommended_ef_construction(n: int, m: int = 16) -> int:
    """Width of the search when a graph over n vectors with m links is built."""
    return max(2 * m, 100 if n < 1_000 else 150 if n < 10_000 else 200 if n < 100_000 else 400)


def recommended_ef_search(k: int, n: int) -> int:
    """Width of a search for k of n vectors."""
    return max(k, 50, 100 if n >= 1_000 else 0, 150 if n >= 10_000 else 0, 200 if n >= 100_000 else 0)


def ef_construction_column(n: Column, m: Column) -> Column:
    return F.greatest(2 * m, F.when(n < 1_000, 100).when(n < 10_000, 150).when(n < 100_000, 200).otherwise(400))


def ef_search_column(k: Column, n: Column) -> Column:
    return F.greatest(k, F.lit(50), F.when(n >= 100_000, 200).when(n >= 10_000, 150).when(n >= 1_000, 100).otherwise(0))


def max_capacity(dim: int) -> int:
    """How many vectors of single precision fit in a 2 GiB mapping with a 64-byte header."""
    return (2**31 - 1 - 64) // (dim * 4)


def default_capacity(dim: int) -> int:
    return min(10_000_000, max_capacity(dim))


def max_capacity_column(dim: Column) -> Column:
    return F.floor(F.lit(2**31 - 1 - 64) / (dim * 4)).cast("long")


def uuid_column(text: Column) -> Column:
    """The canonical text of a UUID, with or without hyphens and in either case; null where it is none."""
    bare = F.regexp_replace(F.lower(text), "-", "")
    parts = [F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.lower(text).rlike("^([0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"), F.concat_ws("-", *parts))


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(nodes: np.ndarray, seed: int, ml: float, top: int) -> np.ndarray:
    """floor(-ln(u) * ml) by node, u drawn from the seed and the node alone; at most ``top``."""
    u = (splitmix(splitmix(np.array([seed & _M64], np.uint64)) ^ nodes.astype(np.uint64)) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.minimum(np.floor(-np.log(np.maximum(u, 2.0**-54)) * ml), top).astype(np.int32)


def level_draw(node: Column, seed: int = 42, m: int = 16, top: int = 16) -> Column:
    ml = 1 / math.log(m)

    @F.arrow_udf("int")
    def draw(n: pa.Array) -> pa.Array:
        return pa.array(levels(np.asarray(n.fill_null(0)), seed, ml, top), mask=np.asarray(n.is_null()))

    return draw(node.cast("long"))


def chunk_of(node: Column, size: int = 1000) -> Column:
    return F.floor(node / F.lit(size)).cast("long")


def chunk_offset(node: Column, size: int = 1000) -> Column:
    return F.pmod(node, F.lit(size)).cast("long")


def as_uuid(value: object) -> uuid.UUID:
    """A UUID of a UUID or its text; anything else raises."""
    if isinstance(value, uuid.UUID):
        return value
    try:
        return uuid.UUID(str(value))
    except ValueError as e:
        raise ValueError(f"{value!r} is no UUID") from e
