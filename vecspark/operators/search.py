"""Nearest-neighbour search: exact, filtered, batched, by range; recall.

Results are ordered by (distance, id) and carry an explicit rank. Filters apply before the k nearest are chosen, so a
filtered search always has k rows if k vectors pass. Vectors that are null, or of another dimension than the query, are
never results.

A single query is one ``TakeOrderedAndProject``: each partition keeps its k best, the driver merges. A batch runs in one
of four ways. ``kernel`` ships the queries to the executors in slices of at most ``SHIPPED`` bytes, computes matrix
products over Arrow batches and keeps k rows a query and partition: no vector is moved. ``blocks`` writes the vectors once,
as blocks in the shared folder, and every task walks its queries over all blocks, with one block and k rows a query at hand:
nothing but the queries is shuffled. ``expr`` joins queries and vectors by expressions, for plans that must stay within SQL;
beyond ``EXPR_PAIRS`` pairs the pairs that may count are found as by ``blocks``, and expressions compute their distances only.
``vectors`` ships the vectors, where these fit ``FEW_VECTORS`` bytes, to the queries, which are spread over all cores: each
query is done within one task. ``auto`` (the default) measures both sides: ``vectors`` if they fit and the queries take
``FEW_QUERIES`` bytes, else ``blocks`` if the queries don't fit one slice, or take an eighth of the vectors' bytes, else
``kernel``. The last step of ``kernel`` and ``expr`` is a ranking window over k rows a query and partition. Query ids are
distinct.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecspark.functions import distance as D
from vecspark.sources.store import Store, scratch

SHIPPED = 64 << 20
FEW_QUERIES = 256 << 10
FEW_VECTORS = 8 << 20
EXPR_PAIRS = 1 << 22
ROWS = 4096
BLOCK = 16384
BLOCK_BYTES = 32 << 20
TASK_BYTES = 2 << 20
PAIRED = 1 << 20
WIDE = 10_000


def id_filter(vectors: DataFrame, ids: DataFrame | Iterable, id_col: str = "vec_id") -> DataFrame:
    """Rows whose id is in ``ids`` (a one-column DataFrame, or values); unknown ids are dropped, no ids give no rows."""
    if isinstance(ids, DataFrame):
        own = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        return vectors.join(own, vectors[id_col] == own["__id"], "left_semi")
    values = list(ids)
    return vectors.where(F.col(id_col).isin(values)) if values else vectors.where(F.lit(False))


def restrict(vectors: DataFrame, where: Column | str | DataFrame | Iterable | None, id_col: str) -> DataFrame:
    """``vectors`` restricted by a predicate or a set of ids; any other type raises."""
    if where is None:
        return vectors
    if isinstance(where, Column):
        return vectors.where(F.coalesce(where, F.lit(False)))
    if isinstance(where, (DataFrame, list, tuple, set, frozenset)):
        return id_filter(vectors, where, id_col)
    raise TypeError(f"a filter is a Column, a DataFrame of ids or a collection of ids, not {type(where).__name__}")


def search(
    vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "euclidean", where=None, min_similarity: float = 0.0,
    metadata: Sequence[str] = (), id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, distance, rank[, metadata]) of the k nearest vectors."""
    if k < 1:
        raise ValueError("k must be at least 1")
    own = restrict(vectors, where, id_col).where(F.size(vector_col) == len(query))
    d = D.distance(metric, F.col(vector_col), D.vector(query))
    found = own.select(F.col(id_col).alias("id"), d.alias("distance"))
    if min_similarity > 0:
        found = found.where(D.similarity(F.col("distance")) >= min_similarity)
    if k > WIDE:
        k = max(1, min(k, found.count()))  # room for k rows is set aside in every task
    best = found.orderBy("distance", "id").limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # k rows
    if not metadata:
        return best
    # metadata is read for k rows only; they are shipped where they are few
    return vectors.select(F.col(id_col).alias("id"), *metadata).join(F.broadcast(best) if k <= WIDE else best, "id").select("id", "distance", "rank", *metadata)


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), order: Sequence[str] = ("distance", "id")) -> DataFrame:
    """The k first rows of each group with their rank; Spark limits groups before the shuffle as well."""
    window = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search_batch(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "euclidean", where=None, min_similarity: float = 0.0, exclude_self: bool = False,
    strategy: str = "auto", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query",
) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest vectors of every query."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in D.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    own = restrict(vectors, where, id_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    if strategy == "auto":
        size = asked.agg((8 * F.sum(F.size("q").cast("long"))).alias("bytes")).first()["bytes"] or 0
        strategy = "kernel"
        if size > FEW_QUERIES:
            other = own.agg((8 * F.sum(F.size("v").cast("long"))).alias("bytes")).first()["bytes"] or 0
            strategy = "vectors" if other <= FEW_VECTORS else "blocks" if size > SHIPPED or 8 * size >= other else "kernel"
    if strategy == "blocks":
        return _blocks(own, asked, k, metric, exclude_self, min_similarity)
    elif strategy == "vectors":
        return _vectors(own, asked, k, metric, exclude_self, min_similarity)
    elif strategy == "kernel":
        scored = _kernel(own, asked, k + exclude_self, metric)
    elif strategy == "expr":
        scored = own.join(asked, F.size("v") == F.size("q"))
        if own.count() * asked.count() > EXPR_PAIRS:
            scored = _blocks(own, asked, k + exclude_self, metric, pairs=True)
        scored = scored.select("query_id", "id", D.distance(metric, F.col("v"), F.col("q")).alias("distance"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if exclude_self:
        scored = scored.where(F.col("query_id") != F.col("id"))
    if min_similarity > 0:
        scored = scored.where(D.similarity(F.col("distance")) >= min_similarity)
    return top_k(scored, k).select("query_id", "id", "distance", "rank")


def _nearest(metric: str, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, radius: float | None = None, single: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, row, distance) of the k nearest rows by (distance, id), or of all within ``radius``, for strips of queries.

    The matrix form, in single precision where numbers allow it, only narrows the rows down, within its rounding error; distances are
    computed again in double precision, pair by pair. ``single`` is x in single precision, if it is at hand."""
    strip = max(1, (4 << 20) // max(1, len(x)))
    largest = float(np.einsum("ij,ij->i", x, x).max(initial=0.0))
    eps = 1e-9
    if radius is None and len(x) > k and largest < 1e15:
        single, eps = (x.astype(np.float32) if single is None else single), 1.2e-7 * (x.shape[1] + 16)
    for lo in range(0, len(queries), strip):
        part = queries[lo : lo + strip]
        fast = eps > 1e-9 and float(np.einsum("ij,ij->i", part, part).max(initial=0.0)) < 1e15
        rough = D.kernel(metric, part.astype(np.float32), single) if fast else D.kernel(metric, part, x)
        if radius is not None:
            scale = 1 + abs(radius) + float(np.abs(rough).max())
            row, col = np.nonzero(rough <= radius + 1e-9 * scale)
            d = _apart(metric, part, row, x, col)
            yield lo + row[d <= radius], col[d <= radius], d[d <= radius]
            continue
        if len(x) > k:
            cut = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64)
            slack = (eps if fast else 1e-9) * (1 + np.abs(cut) + (2 * (largest + np.einsum("ij,ij->i", part, part)) if fast else 0))  # covers the rounding of the matrix form
            row, col = np.nonzero(rough <= (cut + slack)[:, None])
        else:
            row, col = (a.ravel() for a in np.indices(rough.shape))
        d = _apart(metric, part, row, x, col)
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield lo + row[best], col[best], d[best]


def _apart(metric: str, a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, pair by pair, ``PAIRED`` numbers at a time."""
    out, step = np.empty(len(row)), max(1, PAIRED // max(1, a.shape[1]))
    for lo in range(0, len(row), step):
        out[lo : lo + step] = D.pairs(metric, a[row[lo : lo + step]].astype(np.float64), b[col[lo : lo + step]].astype(np.float64))
    return out


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``dim`` numbers without nulls, and where they stand."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    at = np.flatnonzero(size == dim)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    x = values[start[at, None] + np.arange(dim)] if len(at) != len(size) else values.reshape(-1, dim)
    good = ~np.isnan(x).any(axis=1)
    return x[good], at[good]


def _kernel(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, id {kind}, distance double"
    found = None
    for part in _slices(queries):
        sizes = {}
        for n, r in enumerate(part):
            sizes.setdefault(len(r["q"]), []).append(n)
        sets = [(dim, np.array(at), np.array([part[n]["q"] for n in at], dtype=np.float64)) for dim, at in sizes.items() if dim]
        if metric == "cosine":
            sets = [(dim, at, D.unit_rows(q)) for dim, at, q in sets]
        shipped = spark.sparkContext.broadcast((sets, pa.array([r["query_id"] for r in part], to_arrow_type(queries.schema["query_id"].dataType))))

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            sets, names = shipped.value
            best: list = [None] * len(sets)
            for b in _gathered(batches):
                for n, (dim, at, q) in enumerate(sets):
                    x, rows = matrix(b.column("v"), dim)
                    if not len(x):
                        continue
                    if metric == "cosine":
                        x = D.unit_rows(x)
                    ids = b.column("id").combine_chunks().take(pa.array(rows))
                    code = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False)))
                    new = [(at[row], ids.take(pa.array(col)), d) for row, col, d in _nearest(metric, q, x, code, k)]
                    best[n] = _merged([*([best[n]] if best[n] else []), *new], k)
            for one in best:
                if one:
                    row, ids, d = one
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids, pa.array(d)], names=["query_id", "id", "distance"])

        own = vectors.where(F.col("v").isNotNull()).mapInArrow(scan, schema)
        found = own if found is None else found.union(own)
    return found if found is not None else spark.createDataFrame([], schema)


def _vectors(vectors: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool, min_similarity: float) -> DataFrame:
    """The vectors, of a measured size, are shipped; each query is ranked within its task."""
    spark = vectors.sparkSession
    table = vectors.where("id IS NOT NULL AND v IS NOT NULL").toArrow()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double, rank int"
    ids = table.column("id").combine_chunks()
    sets = {}
    for dim in {n.as_py() for n in table.column("v").combine_chunks().value_lengths().unique()} - {0, None} if len(table) else ():
        x, rows = matrix(table.column("v"), dim)
        own = ids.take(pa.array(rows))
        code = own.to_numpy(zero_copy_only=False) if pa.types.is_integer(own.type) else np.argsort(np.argsort(own.to_numpy(zero_copy_only=False)))
        sets[dim] = (D.unit_rows(x) if metric == "cosine" else x, own, code)
    shipped = spark.sparkContext.broadcast(sets)
    kinds = [to_arrow_type(t.dataType) for t in (queries.schema["query_id"], vectors.schema["id"])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles: dict[int, np.ndarray] = {}
        for b in _gathered(batches):
            for dim, (x, ids, code) in shipped.value.items():
                q, at = matrix(b.column("q"), dim)
                if not len(q) or not len(x):
                    continue
                q = D.unit_rows(q) if metric == "cosine" else q
                names = b.column("query_id").combine_chunks().take(pa.array(at))
                if dim not in singles:
                    singles[dim] = x.astype(np.float32)
                for row, col, d in _nearest(metric, q, x, code, k + exclude_self, single=singles[dim]):
                    who, other = names.take(pa.array(row)), ids.take(pa.array(col))
                    keep = np.ones(len(row), dtype=bool)
                    if exclude_self:
                        keep &= ~pc.equal(who.cast(other.type), other).fill_null(False).to_numpy(zero_copy_only=False)
                    if min_similarity > 0:
                        keep &= (d > -1) & (1 / (1 + np.maximum(d, -0.999999999)) >= min_similarity)
                    row, d, who, other = row[keep], d[keep], who.filter(pa.array(keep)), other.filter(pa.array(keep))
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    best = rank < k
                    mask = pa.array(best)
                    yield pa.RecordBatch.from_arrays([who.filter(mask).cast(kinds[0]), other.filter(mask).cast(kinds[1]), pa.array(d[best]), pa.array((rank[best] + 1).astype(np.int32))], names=["query_id", "id", "distance", "rank"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    return queries.where("q IS NOT NULL AND query_id IS NOT NULL").repartition(tasks).mapInArrow(scan, schema)


def _blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool = False, min_similarity: float = 0.0, radius: float | None = None, pairs: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest, or (query_id, id, distance) of all within ``radius``.

    ``pairs`` gives (query_id, id, q, v) instead of distances, of the k nearest and of whatever may be as near by another rounding."""
    spark = vectors.sparkSession
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": vectors.schema["id"].dataType}
    arrow, number = {c: to_arrow_type(t) for c, t in kinds.items()}, to_arrow_type(vectors.schema["v"].dataType).value_type
    written = _packed(vectors.where("id IS NOT NULL AND v IS NOT NULL"), arrow["id"], number)
    asked = queries.where("query_id IS NOT NULL AND q IS NOT NULL")
    size = asked.agg((8 * F.sum(F.size("q").cast("long"))).alias("bytes")).first()["bytes"] or 0
    asked = asked.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    names = ["query_id", "id", *(["q", "v"] if pairs else ["distance"] if radius is not None else ["distance", "rank"])]
    types = {c: t.simpleString() for c, t in kinds.items()} | {"distance": "double", "rank": "int", "q": "array<double>", "v": "array<double>"}
    schema = ", ".join(f"{c} {types[c]}" for c in names)

    def listed(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 4 * TASK_BYTES):
            for dim in {n.as_py() for n in table.column("q").combine_chunks().value_lengths().unique()} - {0, None}:
                q, at = matrix(table.column("q"), dim)
                if not len(q):
                    continue
                who = table.column("query_id").combine_chunks().take(pa.array(at))
                q = D.unit_rows(q) if metric == "cosine" else q
                if radius is not None:
                    for x, ids in _written(written, dim, metric, arrow["id"], number):
                        for row, col, d in _within(metric, q, x, radius):
                            yield pa.RecordBatch.from_arrays([who.take(pa.array(row)), ids.take(pa.array(col)), pa.array(d)], names=names)
                    continue
                best = _Best(q, k + exclude_self, metric, keep=pairs)
                for x, ids in _written(written, dim, metric, arrow["id"], number):
                    best.add(x, ids)
                for row, ids, d, x in best.parts():
                    mine = who.take(pa.array(row))
                    if pairs:
                        step = max(1, PAIRED // dim)
                        for lo in range(0, len(row), step):
                            some = slice(lo, lo + step)
                            yield pa.RecordBatch.from_arrays([mine[some], ids[some], listed(q[row[some]]), listed(x[some])], names=names)
                        continue
                    keep = np.ones(len(row), dtype=bool)
                    if exclude_self:
                        keep &= ~pc.equal(mine.cast(ids.type), ids).fill_null(False).to_numpy(zero_copy_only=False)
                    if min_similarity > 0:
                        keep &= (d > -1) & (1 / (1 + np.maximum(d, -0.999999999)) >= min_similarity)
                    row, d, mine, ids = row[keep], d[keep], mine.filter(pa.array(keep)), ids.filter(pa.array(keep))
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    first = rank < k
                    yield pa.RecordBatch.from_arrays([mine.filter(pa.array(first)), ids.filter(pa.array(first)), pa.array(d[first]), pa.array((rank[first] + 1).astype(np.int32))], names=names)

    return asked.mapInArrow(walk, schema)


def _packed(vectors: DataFrame, kind: pa.DataType, number: pa.DataType) -> Store:
    """``vectors(id, v)`` as rows of some ``ROWS`` vectors (their ids, their numbers as bytes) in the shared folder."""
    path = scratch(vectors.sparkSession, "blocks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            for dim in {n.as_py() for n in table.column("v").combine_chunks().value_lengths().unique()} - {0, None}:
                x, rows = matrix(table.column("v"), dim)
                ids = table.column("id").combine_chunks().take(pa.array(rows)).cast(kind)
                for lo in range(0, len(x), ROWS):
                    part, own = x[lo : lo + ROWS].astype(_plain(number)), ids[lo : lo + ROWS]
                    cols = [pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([part.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["dim", "ids", "x"])

    packed = vectors.mapInArrow(pack, f"dim int, ids array<{vectors.schema['id'].dataType.simpleString()}>, x binary")
    small = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    packed.write.options(**small).parquet(path)
    return Store(path)


def _plain(number: pa.DataType) -> type:
    return np.float32 if pa.types.is_float32(number) else np.float64


def _written(store: Store, dim: int, metric: str, kind: pa.DataType, number: pa.DataType) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(vectors, ids) of ``dim`` numbers, by blocks of some ``BLOCK`` rows or ``BLOCK_BYTES``."""
    some: list[tuple[np.ndarray, pa.Array]] = []

    def block() -> tuple[np.ndarray, pa.Array]:
        x = np.concatenate([x for x, _ in some])
        return D.unit_rows(x) if metric == "cosine" else x, pa.concat_arrays([i for _, i in some])

    for name, _, _ in store.files():
        if name.endswith(".parquet"):
            with store.fs.open_input_file(f"{store.base}/{name}") as f:
                for b in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1, columns=["dim", "ids", "x"]):
                    if b.column("dim")[0].as_py() != dim:
                        continue
                    x = np.frombuffer(b.column("x")[0].as_buffer(), _plain(number)).reshape(-1, dim).astype(np.float64)
                    some.append((x, b.column("ids").flatten().cast(kind)))
                    n = sum(len(x) for x, _ in some)
                    if n >= BLOCK or 8 * n * dim >= BLOCK_BYTES:
                        yield block()
                        some = []
    if some:
        yield block()


class _Rough:
    """Lower bounds of distances, up to a part of each query alone, by one product; in single precision where numbers allow it.

    ``slack`` covers the rounding, so whatever is within a bound by exact distances is within the bound and the slack here."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.own = metric, np.einsum("ij,ij->i", q, q)
        self.q = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1) if metric == "euclidean" else -q
        self.shift = self.own if metric == "euclidean" else np.ones(len(q))
        self.largest_q = float(self.own.max(initial=0.0))
        self.single = self.q.astype(np.float32) if self.largest_q < 1e15 else None

    def against(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        norms = np.einsum("ij,ij->i", x, x)
        y = np.concatenate([x, norms[:, None]], axis=1) if self.metric == "euclidean" else x
        largest = float(norms.max(initial=0.0))
        if self.single is None or largest >= 1e15:
            return self.q, y, 1e-9, largest
        return self.single, y.astype(np.float32), 1.2e-7 * (x.shape[1] + 16), largest

    def slack(self, bound: np.ndarray, part: slice, eps: float, largest: float) -> np.ndarray:
        return eps * (1 + np.abs(bound) + 2 * (largest + self.own[part]))


def _hits(rough: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(rough <= bound.astype(rough.dtype)[:, None])
    return at // rough.shape[1], at % rough.shape[1]


def _within(metric: str, q: np.ndarray, x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, row, distance) of all rows within ``radius``, by bounded batches."""
    rough = _Rough(metric, q)
    a, b, eps, largest = rough.against(x)
    strip = max(1, (4 << 20) // max(1, len(x)))
    for lo in range(0, len(q), strip):
        part = slice(lo, lo + strip)
        bound = np.full(len(q[part]), float(radius))
        row, col = _hits(a[part] @ b.T, bound - rough.shift[part] + rough.slack(bound, part, eps, largest))
        step = max(1, PAIRED // q.shape[1])
        for n in range(0, len(row), step):
            r, c = lo + row[n : n + step], col[n : n + step]
            d = D.pairs(metric, q[r], x[c])
            good = d <= radius
            yield r[good], c[good], d[good]


class _Best:
    """The k nearest of each query by (distance, id), over blocks of vectors: a block is compared by a product that only narrows it down to
    what may be nearer than the k-th so far; distances are computed again in double precision, pair by pair. ``keep`` also keeps the
    vectors, and all that are as near as the k-th but for rounding."""

    def __init__(self, q: np.ndarray, k: int, metric: str, keep: bool = False):
        self.q, self.k, self.metric, self.keep = q, k, metric, keep
        self.rough = _Rough(metric, q)
        self.kth = np.full(len(q), np.inf)
        self.strip = 256
        self.best: dict[int, tuple] = {}

    def add(self, x: np.ndarray, ids: pa.Array) -> None:
        a, b, eps, largest = self.rough.against(x)
        bt = np.ascontiguousarray(b.T)
        out = np.empty((min(self.strip, len(self.q)), len(x)), dtype=a.dtype)
        for lo in range(0, len(self.q), self.strip):
            part = slice(lo, lo + self.strip)
            rough = np.matmul(a[part], bt, out=out[: len(a[part])])
            kth = self.kth[part]
            if len(x) > self.k and not np.isfinite(kth).all():
                cut = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + self.rough.shift[part]
                # as many as k have a distance of at most this cut and a slack
                kth = np.minimum(kth, cut + self.rough.slack(cut, part, eps, largest))
            slack = np.where(np.isfinite(kth), self.rough.slack(np.where(np.isfinite(kth), kth, 0), part, eps, largest), 0)
            row, col = _hits(rough, kth - self.rough.shift[part] + slack)
            if len(row):
                self._merge(lo, row, col, x, ids)

    def _merge(self, lo: int, row: np.ndarray, col: np.ndarray, x: np.ndarray, ids: pa.Array) -> None:
        for n in range(0, len(row), PAIRED):
            r, c = row[n : n + PAIRED], col[n : n + PAIRED]
            d = _apart(self.metric, self.q, lo + r, x, c)
            near = d <= self.kth[lo + r] + self._loose(self.kth[lo + r])
            r, c, d = r[near], c[near], d[near]
            names, own = ids.take(pa.array(c)), x[c] if self.keep else None
            if lo in self.best:
                r0, ids0, d0, x0 = self.best[lo]
                r, d, names = np.concatenate([r0, r]), np.concatenate([d0, d]), pa.concat_arrays([ids0, names])
                own = np.concatenate([x0, own]) if self.keep else None
            order = np.lexsort((_codes(names), d, r))
            r, d = r[order], d[order]
            start = np.searchsorted(r, r)
            rank = np.arange(len(r)) - start
            last = np.flatnonzero(rank == self.k - 1)
            self.kth[lo + r[last]] = d[last]
            good = rank < self.k
            if self.keep:
                good |= d <= self.kth[lo + r] + self._loose(self.kth[lo + r])
            self.best[lo] = (r[good], names.take(pa.array(order[good])), d[good], own[order[good]] if self.keep else None)

    def _loose(self, bound: np.ndarray) -> np.ndarray | float:
        """What rounding in double precision may come to, where that counts."""
        return np.where(np.isfinite(bound), 1e-11 * (1 + np.abs(bound)), 0.0) if self.keep else 0.0

    def parts(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray | None]]:
        """(query number, ids, distances, vectors) by rising query number, distance and id."""
        for lo in sorted(self.best):
            row, ids, d, x = self.best[lo]
            yield lo + row, ids, d, x


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers that order ids."""
    names = ids.to_numpy(zero_copy_only=False)
    return names if pa.types.is_integer(ids.type) else np.unique(names, return_inverse=True)[1]


def _merged(parts: list, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    row = np.concatenate([p[0] for p in parts])
    ids = pa.concat_arrays([p[1] for p in parts])
    d = np.concatenate([p[2] for p in parts])
    name = ids.to_numpy(zero_copy_only=False)
    order = np.lexsort((name if pa.types.is_integer(ids.type) else np.argsort(np.argsort(name)), d, row))
    row, d = row[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids.take(pa.array(order[keep])), d[keep]


def _gathered(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Batches joined to some ``ROWS`` rows, so that matrix products are worth it; or to ``most`` bytes."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(x.nbytes for x in some) >= most if most else sum(x.num_rows for x in some) >= ROWS:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _slices(queries: DataFrame) -> Iterator[list]:
    """The queries by slices of at most ``SHIPPED`` bytes; every slice is one pass over the vectors."""
    usable = queries.where(F.col("q").isNotNull())
    part, size = [], 0
    for r in usable.toLocalIterator(prefetchPartitions=True):
        part.append(r)
        size += 8 * len(r["q"]) + 64
        if size >= SHIPPED:
            yield part
            part, size = [], 0
    if part:
        yield part


def range_search(
    vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "euclidean",
    id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query",
) -> DataFrame:
    """(query_id, id, distance) of all vectors within ``radius`` of a query: every task walks its queries over blocks of the vectors."""
    if metric not in D.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    return _blocks(own, asked, 1, metric, radius=radius)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact results that the approximate ones hold."""
    hit = approx.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def quality(recalls: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: mean, least and greatest recall, and whether the mean reaches the threshold."""
    return recalls.agg(
        F.count("*").alias("n_queries"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall")
    ).withColumn("passed", F.col("mean_recall") >= threshold)
