"""Operator 4: the nearest neighbours of every vector, by a block matrix join over int8 product tiles.

Vectors fall into blocks by a hash of their id; each pair of blocks is one tile, computed once for both sides. In a tile
vectors are quantised to int8 with a scale of their own, x = s * c + e, and |e| is kept: the product of two code vectors
gives x.y within |s c||e'| + |e||y|, so squared distances are known within a bound. Per query, the k-th smallest upper
bound of a tile prunes all pairs whose lower bound exceeds it; pairs that survive are recomputed in float (double sums),
and each tile gives at most k neighbours a query. The sorted lists of a query's tiles are merged by a heap. Nothing is
lost to quantisation: recall is 1.

Every vector is a query, itself excluded. Distances are squared Euclidean, rounded to six digits; ties go to the smaller
id. The product of the codes runs in single precision BLAS, which is exact up to 1,040 dimensions, and in slices of
those beyond. All pairs are compared, as the method has it: work grows with the square of the rows, spread evenly over
tiles; each vector is sent to one tile per block (``BLOCK`` rows), so that the shuffle is rows * blocks.

Defined cases: rows with a null id or vector, an empty vector, or a null, infinite or NaN element are left out; finite elements of any size are compared right; vectors
are only compared within their dimension; of rows repeated under one id the smallest vector counts; fewer than k others
give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X

K, BLOCK, STRIP, EXACT, LARGE = 10, 8192, 256, 1040, 1e15


class Codes:
    """int8 codes of the rows of x, with what their error bounds need."""

    def __init__(self, x: np.ndarray):
        self.x = x
        scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
        self.codes = np.rint(x / scale[:, None]).astype(np.int8)
        self.scale = scale
        near = self.codes * scale[:, None]
        self.near = np.linalg.norm(near, axis=1)
        self.error = np.linalg.norm(x - near, axis=1)
        self.square = np.einsum("ij,ij->i", x, x)
        self.norm = np.sqrt(self.square)

    def products(self, lo: int, hi: int, other: Codes) -> np.ndarray:
        """Whole-number products of the codes of rows lo:hi with all of ``other``."""
        out = None
        for d in range(0, self.x.shape[1], EXACT):
            part = self.codes[lo:hi, d : d + EXACT].astype(np.float32) @ other.single[:, d : d + EXACT].T
            out = part if out is None else out.astype(np.float64) + part
        return out

    @property
    def single(self) -> np.ndarray:
        if not hasattr(self, "_single"):
            self._single = self.codes.astype(np.float32)
        return self._single


def tile(a: Codes, b: Codes, ida: np.ndarray, idb: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of queries, ids of neighbours, distances), the k nearest in ``b`` of each row of ``a``, strip by strip."""
    if len(ida) == 0 or len(idb) == 0:
        return
    most = max(a.norm.max(), b.norm.max())
    unit = 2.0 ** -np.ceil(np.log2(most)) if most > LARGE else 1.0  # keeps single precision from overflowing
    worst_error, worst_norm = b.error.max() * unit, b.norm.max() * unit
    grain = 1e-6 * unit**2 + 1e-6 * float(worst_norm) ** 2  # rounding of results, and of the single precision sums below
    bscale, bsquare = (b.scale * unit).astype(np.float32), (b.square * unit**2).astype(np.float32)
    for lo in range(0, len(ida), STRIP):
        hi = min(lo + STRIP, len(ida))
        dots = a.products(lo, hi, b)
        dots *= bscale
        dots *= (-2 * unit * a.scale[lo:hi, None]).astype(np.float32)
        dots += bsquare  # squared distance without the query's own square
        own = ida[lo:hi, None] == idb[None, :] if ida is idb else None
        if own is not None:
            dots[own] = np.inf
        bound = 2 * (a.near[lo:hi] * unit * worst_error + a.error[lo:hi] * unit * worst_norm) + grain + 1e-6 * unit**2 * a.square[lo:hi]
        if len(idb) > k:
            cut = np.partition(dots, k - 1, axis=1)[:, k - 1] + 2 * bound
        else:
            cut = np.full(hi - lo, np.inf)
        row, col = np.nonzero(dots <= cut[:, None].astype(np.float32))
        if own is not None:
            other = ida[lo + row] != idb[col]
            row, col = row[other], col[other]
        diff = a.x[lo + row] - b.x[col]
        d = np.round(np.einsum("ij,ij->i", diff, diff), 6)
        order = np.lexsort((idb[col], d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        yield ida[lo + row[best]], idb[col[best]], d[best]


def _lists(query: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    offs = pa.array(np.append(first, len(query)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (d, other)]
    return pa.RecordBatch.from_arrays([pa.array(query[first]), *lists], names=["id", "d", "other"])


def _tiles(k: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids = np.asarray(table.column("side")), np.asarray(table.column("id"))
        dim = table.column("dim")[0].as_py()
        raw = table.column("vector").combine_chunks()
        x = np.asarray(raw.flatten()).reshape(len(ids), dim).astype(np.float64)
        order = np.lexsort((ids, side))
        side, ids, x = side[order], ids[order], x[order]
        n = int(np.searchsorted(side, 1))
        a, ida = Codes(x[:n]), ids[:n]
        if n == len(ids):  # a block with itself
            for part in tile(a, a, ida, ida, k):
                yield _lists(*part)
            return
        b, idb = Codes(x[n:]), ids[n:]
        for one in (tile(a, b, ida, idb, k), tile(b, a, idb, ida, k)):
            for part in one:
                yield _lists(*part)

    return compute


def _merger(k: int):
    kind = "array<struct<neighbour_id:bigint,distance:double>>"

    @F.arrow_udf(kind)
    def merge(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists.to_pylist():
            runs = [list(zip(r["d"], r["other"], strict=True)) for r in row]
            out.append([{"neighbour_id": i, "distance": d} for d, i in islice(heapq.merge(*runs), k)])
        return pa.array(out, pa.list_(pa.struct([("neighbour_id", pa.int64()), ("distance", pa.float64())])))

    return merge


def neighbours(vectors: DataFrame, k: int = K, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest others of every vector."""
    if k < 1:
        raise ValueError("k must be at least 1")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = x.where(F.col("id").isNotNull() & (F.size("vector") > 0) & usable).groupBy("id").agg(F.min("vector").alias("vector"))
    x = X.stored(x.withColumn("dim", F.size("vector")), "vectors")
    blocks = max(1, -(-x.count() // block))
    sent = x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sent = sent.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    i, j = F.least("block", "to"), F.greatest("block", "to")
    sent = sent.select("id", "vector", "dim", i.alias("i"), j.alias("j"), (F.col("block") != i).cast("int").alias("side"))
    lists = sent.groupBy("dim", "i", "j").applyInArrow(_tiles(k), "id long, d array<double>, other array<long>")
    merged = lists.groupBy("id").agg(F.collect_list(F.struct("d", "other")).alias("lists")).select("id", F.posexplode(_merger(k)("lists")).alias("at", "n"))
    return merged.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("rank"), "n.neighbour_id", "n.distance")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id,
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM pairs)
SELECT vec_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10"""
