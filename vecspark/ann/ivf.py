"""Inverted-file search: vectors live in the cell of their nearest centroid, queries visit the nearest cells only.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows at most, by hash of the id). ``probe`` groups rows by a
cell column; ``pack`` stores cells as rows of at most some ``CELL_ROWS`` vectors in folders by cell, so that ``probe_packed``
reads the folders of the probed cells only, in as many tasks as they have rows, and shuffles nothing but results.
Every visited vector is compared exactly, so results differ from exact search only in what isn't visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecspark.functions import distance as D
from vecspark.operators import search
from vecspark.operators.sampling import smallest_hashes

SAMPLE, CELL_ROWS = 100_000, 20_000
PACKED = "cell int, keys array<string>, seqs array<long>, x binary"


def fit(vectors: DataFrame, cells: int, metric: str = "euclidean", rounds: int = 15, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids (cells x dim), by Lloyd's rounds over a bounded sample; fewer where there are fewer vectors."""
    own = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    rows = smallest_hashes(own, F.xxhash64(id_col, F.lit(seed)), SAMPLE).orderBy(id_col).select(vector_col).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    col = rows.column(0).combine_chunks()
    dim = int(np.median(col.value_lengths().to_numpy(zero_copy_only=False)))
    x, _ = search.matrix(col, dim)
    if metric == "cosine":
        x = D.unit_rows(x)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest_cell(x, c)
        count = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = count == 0
        sums[empty], count[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        new = sums / count[:, None]
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest_cell(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The nearest centroid of each row; for n > 1 the n nearest, in order."""
    d = np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * x @ centroids.T
    return d.argmin(axis=1) if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]


def _celled(df: DataFrame, centroids: np.ndarray, metric: str, col: str, n: int) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def cell(v: pa.Array) -> pa.Array:
        own = shipped.value
        out: list = [None] * len(v)
        if len(own):
            x, rows = search.matrix(v, own.shape[1])
            if len(x):
                x = D.unit_rows(x) if metric == "cosine" else x
                for r, c in zip(rows.tolist(), nearest_cell(x, own, max(2, n))[:, :n].tolist(), strict=True):
                    out[r] = c
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn("cell", F.explode(cell(F.col(col))))


def assigned(vectors: DataFrame, centroids: np.ndarray, metric: str = "euclidean", vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with their ``cell``; vectors that can't be compared are left out."""
    return _celled(vectors, centroids, metric, vector_col, 1)


def write(vectors: DataFrame, centroids: np.ndarray, path: str, metric: str = "euclidean", vector_col: str = "embedding") -> None:
    """Parquet by cell. Rows are shuffled by cell once, and large cells by a few files each."""
    own = assigned(vectors, centroids, metric, vector_col)
    own.repartition("cell", F.pmod(F.xxhash64(vector_col), F.lit(4))).write.partitionBy("cell").parquet(path)


def probe(
    celled: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = 4, metric: str = "euclidean",
    id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query",
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest among the ``probes`` nearest cells of each query."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    asked = _celled(asked, centroids, metric, "q", probes)
    own = celled.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "cell")

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        dim = centroids.shape[1]
        if len(a) and len(b):
            (q, qrow), (x, rows) = search.matrix(a.column("q"), dim), search.matrix(b.column("v"), dim)
            if metric == "cosine":
                q, x = D.unit_rows(q), D.unit_rows(x)
            ids, names = b.column("id").combine_chunks().take(pa.array(rows)), a.column("query_id").combine_chunks().take(pa.array(qrow))
            code = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False)))
            if len(q) and len(x):
                parts = [pa.table({"query_id": names.take(pa.array(r)), "id": ids.take(pa.array(c)), "distance": pa.array(d)}) for r, c, d in search._nearest(metric, q, x, code, k)]
        return pa.concat_tables(parts) if parts else pa.table({"query_id": a.column("query_id")[:0], "id": b.column("id")[:0], "distance": pa.array([], pa.float64())})

    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, distance double"
    scored = asked.groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(join, schema)
    return search.top_k(scored, k).select("query_id", "id", "distance", "rank")


def overfetched(search_fn, keep, k: int, factors: tuple[int, ...] = (3, 10, 30)) -> DataFrame:
    """Post-filtering for searches that can't filter first: asks for 3k, 10k, 30k until k pass; gives what there is."""
    found = None
    for f in factors:
        found = search_fn(k * f).where(keep)
        if found.limit(k).count() >= k:
            break
    return found.orderBy("distance", "id").limit(k)


def cell_count(n: int) -> int:
    return int(min(4096, max(1, round(n**0.5))))


def pack(vectors: DataFrame, centroids: np.ndarray, rows: int, metric: str = "euclidean") -> DataFrame:
    """Rows (cell, keys, seqs, x) of ``vectors(key, seq, v)``, to be written by cell; large cells take several rows."""
    parts = max(1, 4 * rows // max(1, len(centroids)) // CELL_ROWS)
    own = _celled(vectors.select("key", "seq", "v"), centroids, metric, "v", 1).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    dim = centroids.shape[1]

    def one(table: pa.Table) -> pa.Table:
        x, at = search.matrix(table.column("v"), dim)
        keys, seqs = (table.column(c).combine_chunks().take(pa.array(at)) for c in ("key", "seq"))
        offs = pa.array([0, len(at)], pa.int32())
        cols = [pa.array([table.column("cell")[0].as_py()], pa.int32()), pa.ListArray.from_arrays(offs, keys), pa.ListArray.from_arrays(offs, seqs), pa.array([x.astype(np.float32).tobytes()], pa.binary())]
        return pa.table(cols, names=["cell", "keys", "seqs", "x"])

    return own.groupBy("cell", "part").applyInArrow(one, PACKED)


def probe_packed(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int, metric: str, ok: Callable[[pa.Array, np.ndarray], np.ndarray | None]) -> DataFrame:
    """(query_id, key, distance) of the k nearest of each stored row in the ``probes`` nearest cells; ``ok(keys, seqs)`` marks what may be returned."""
    spark = index.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema, dim = f"query_id {kind}, key string, distance double", centroids.shape[1]
    found = None
    for part in search._slices(queries):
        part = [r for r in part if len(r["q"]) == dim]
        if not part:
            continue
        q = np.array([r["q"] for r in part], dtype=np.float64)
        q = D.unit_rows(q) if metric == "cosine" else q
        cells = nearest_cell(q, centroids, max(2, probes))[:, :probes]
        shipped = spark.sparkContext.broadcast((pa.array([r["query_id"] for r in part], to_arrow_type(queries.schema["query_id"].dataType)), q, cells))

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, q, cells = shipped.value
            for b in batches:
                for n in range(b.num_rows):
                    keys, seqs = b.column(1).slice(n, 1).flatten(), np.asarray(b.column(2).slice(n, 1).flatten())
                    x = np.frombuffer(b.column(3)[n].as_py(), np.float32).reshape(-1, dim).astype(np.float64)
                    mask = ok(keys, seqs)
                    if mask is not None:
                        keys, x = keys.filter(pa.array(mask)), x[mask]
                    x = D.unit_rows(x) if metric == "cosine" else x
                    mine = np.flatnonzero((cells == b.column(0)[n].as_py()).any(axis=1))
                    if len(mine) and len(x):
                        for row, col, d in search._nearest(metric, q[mine], x, np.arange(len(x)), k):
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(mine[row])), keys.take(pa.array(col)), pa.array(d)], names=["query_id", "key", "distance"])

        wanted = np.unique(cells).tolist()
        own = index if len(wanted) == len(centroids) else index.where(F.col("cell").isin(wanted))
        now = own.select("cell", "keys", "seqs", "x").mapInArrow(scan, schema)
        found = now if found is None else found.union(now)
    return found if found is not None else spark.createDataFrame([], schema)
