"""Neighbour graphs, sharded: hierarchical small-world graphs built and searched per shard.

Vectors fall into shards by a hash of their id; each shard is a graph of its own, built in one task from exact distances,
and a search merges the best of all shards. Builds are deterministic: levels are drawn from the seed and the id, links by
the diversity rule (a candidate is kept unless a neighbour chosen before is nearer to it than the node is), and back
links are pruned by the same rule. ``build`` gives the links as rows; ``pack`` stores a shard (ids, vectors, links) as one
row, so that a search reads shards where they lie and shuffles nothing but results.

All queries of a batch walk a shard in lockstep, one expanded node a step each, by NumPy. Nodes that may not be returned
(deleted, or ruled out by a filter) are traversed all the same; where few of a shard may be returned, those are compared
exactly, by products. Links to vectors that are gone are left out; ``repaired`` fills their room.

A beam as wide as a shard would visit all that can be reached, one node a step; it is never walked, all of the shard is compared
instead. If that holds for every shard, ``probe`` is an exact search, and a table's too.
"""

from __future__ import annotations

import io
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions.params import levels
from vecspark.operators import search

EDGES = "shard int, layer int, src long, dst long, pos int"
SHARD_ROWS, GROUP, FEW = 20_000, 256, 1000
TOP = 16
ENDLESS = 86_400_000


def default_patience(k: int) -> int:
    return max(7, int(0.3 * k))


def exhaustive(rows: int, k: int, ef: int, budget: int = 0, patience: int = 0, timeout_ms: int = 0) -> bool:
    """Whether a beam holds all of ``rows`` nodes and nothing ends its walk before (a time limit of a day never does)."""
    return max(k, ef) >= rows and not 0 < budget < rows and not 0 < patience < rows and not 0 < timeout_ms < ENDLESS


def _far(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances within each group: a (groups, n, dim), b (groups, m, dim)."""
    dots = a @ b.transpose(0, 2, 1)
    if metric != "euclidean":
        return 1 - dots
    return np.einsum("gnd,gnd->gn", a, a)[:, :, None] + np.einsum("gmd,gmd->gm", b, b)[:, None, :] - 2 * dots


def diverse(x: np.ndarray, candidates: np.ndarray, d: np.ndarray, most: int, metric: str, chosen: np.ndarray | None = None) -> np.ndarray:
    """Which candidates (nodes x n, by rising distance d, -1 for none) become links, by the diversity rule; some may be chosen already."""
    own = x[np.maximum(candidates, 0)]
    apart = _far(metric, own, own)
    chosen = np.zeros(candidates.shape, dtype=bool) if chosen is None else chosen.copy()
    before = chosen.copy()
    count = chosen.sum(axis=1)
    for j in range(candidates.shape[1]):
        ok = (candidates[:, j] >= 0) & (count < most) & ~before[:, j]
        if ok.any():
            ok &= ~((apart[:, :, j] < d[:, j, None]) & chosen).any(axis=1)
            chosen[:, j] |= ok
            count += ok
    return chosen


def _padded(src: np.ndarray, dst: np.ndarray, d: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as rows of ``width`` by rising distance, with their distances."""
    order = np.lexsort((dst, d, src))
    src, dst, d = src[order], dst[order], d[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    keep = rank < width
    out, far = np.full((nodes, width), -1, dtype=np.int32), np.full((nodes, width), np.inf, dtype=np.float32)
    out[src[keep], rank[keep]], far[src[keep], rank[keep]] = dst[keep], d[keep]
    return out, far


def shard_links(x: np.ndarray, ids: np.ndarray, m: int, ef: int, seed: int, metric: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, their links) of each layer; rows are numbered as in x, links are -1 where there are no more."""
    x = x.astype(np.float32)
    level = levels(ids, seed, 1 / math.log(m), TOP)
    out = []
    for layer in range(int(level.max(initial=0)) + 1):
        members = np.flatnonzero(level >= layer)
        most, n, own = (2 * m if layer == 0 else m), len(members), x[members]
        if n < 2:
            out.append((members, np.full((n, most), -1, dtype=np.int32)))
            continue
        width = min(ef, n - 1)
        step = max(1, min(256, (8 << 20) // (width * (width + own.shape[1]))))
        found = []
        for lo in range(0, n, step):
            rough = D.kernel(metric, own[lo : lo + step], own)
            rough[np.arange(len(rough)), lo + np.arange(len(rough))] = np.inf
            near = np.argpartition(rough, width - 1, axis=1)[:, :width]
            d = np.take_along_axis(rough, near, axis=1)
            order = np.lexsort((near, d), axis=1)
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            row, col = np.nonzero(diverse(own, near, d, m, metric))
            found.append((lo + row, near[row, col], d[row, col]))
        src, dst, d = (np.concatenate(c) for c in zip(*found, strict=True))
        key, at = np.unique(np.concatenate([src * n + dst, dst * n + src]), return_index=True)
        src, dst, d = key // n, key % n, np.concatenate([d, d])[at]
        wide = int(min(max(ef, most), np.bincount(src, minlength=n).max(initial=1)))
        links, far = _padded(src, dst, d, n, max(wide, most))
        crowded = np.flatnonzero(links[:, most:].max(axis=1, initial=-1) >= 0)
        for lo in range(0, len(crowded), step):
            rows = crowded[lo : lo + step]
            keep = diverse(own, links[rows], far[rows], most, metric)
            slim = np.where(keep, links[rows], -1)
            links[rows] = np.take_along_axis(slim, np.argsort(~keep, axis=1, kind="stable"), axis=1)
        links = links[:, :most]
        out.append((members, np.where(links >= 0, members[np.maximum(links, 0)], -1).astype(np.int32)))
    return out


def shard_edges(x: np.ndarray, ids: np.ndarray, m: int, ef: int, seed: int, metric: str) -> np.ndarray:
    """Rows (layer, src, dst, pos) of one shard; nodes are numbered as in x."""
    out = []
    for layer, (members, links) in enumerate(shard_links(x, ids, m, ef, seed, metric)):
        row, pos = np.nonzero(links >= 0)
        out.append(np.stack([np.full(len(row), layer), members[row], links[row, pos], pos], axis=1))
    return np.concatenate(out).astype(np.int64).reshape(-1, 4)


def _sharded(vectors: DataFrame, shards: int, id_col: str, vector_col: str) -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return own.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def shard_count(n: int) -> int:
    return max(1, -(-n // SHARD_ROWS))


def _read(table: pa.Table, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, ids, rows of the table), by rising id."""
    dims = table.column("v").combine_chunks().value_lengths()
    x, rows = search.matrix(table.column("v"), dims[0].as_py())
    ids = np.asarray(table.column("id"))[rows]
    order = np.argsort(ids, kind="stable")
    x = D.unit_rows(x) if metric == "cosine" else x
    return x[order], ids[order], rows[order]


def build(vectors: DataFrame, m: int = 16, ef_construction: int = 100, shards: int | None = None, seed: int = 42, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``edges(shard, layer, src, dst, pos)``: at most 2m links on layer 0, m above. Shards hold some ``SHARD_ROWS`` vectors unless told."""
    shards = shards or shard_count(vectors.count())

    def one(table: pa.Table) -> pa.Table:
        x, ids, _ = _read(table, metric)
        edges = shard_edges(x, ids, m, ef_construction, seed, metric)
        shard = np.full(len(edges), table.column("shard")[0].as_py(), np.int32)
        cols = [pa.array(shard), pa.array(edges[:, 0].astype(np.int32)), pa.array(ids[edges[:, 1]]), pa.array(ids[edges[:, 2]]), pa.array(edges[:, 3].astype(np.int32))]
        return pa.table(cols, names=["shard", "layer", "src", "dst", "pos"])

    return _sharded(vectors, shards, id_col, vector_col).groupBy("shard").applyInArrow(one, EDGES)


class Shard:
    """Vectors and links of one shard; ``ok`` says which nodes may be returned (all, if None)."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], metric: str, ok: np.ndarray | None = None):
        self.x, self.metric, self.ok = np.ascontiguousarray(x, dtype=np.float32), metric, ok
        self.layers = []
        for members, links in layers:
            at = np.full(len(x), -1, dtype=np.int32)
            at[members] = np.arange(len(members))
            self.layers.append((at, links))
        self.entry = int(layers[-1][0].min()) if layers and len(layers[-1][0]) else 0

    @classmethod
    def of_edges(cls, x: np.ndarray, edges: np.ndarray, metric: str, ok: np.ndarray | None = None) -> Shard:
        """From rows (layer, src, dst, pos)."""
        layers = []
        for layer in range(int(edges[:, 0].max(initial=0)) + 1):
            own = edges[edges[:, 0] == layer]
            own = own[np.lexsort((own[:, 3], own[:, 1]))]
            members = np.arange(len(x)) if layer == 0 else np.unique(own[:, 1])
            rank = np.arange(len(own)) - np.searchsorted(own[:, 1], own[:, 1])
            links = np.full((len(members), max(1, int(rank.max(initial=0)) + 1)), -1, dtype=np.int32)
            links[np.searchsorted(members, own[:, 1]), rank] = own[:, 2]
            layers.append((members, links))
        while len(layers) > 1 and not len(layers[-1][0]):
            layers.pop()
        return cls(x, layers, metric, ok)

    def _to(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of each query to its own row of nodes; infinite for -1."""
        y = self.x[np.maximum(nodes, 0)]
        if self.metric == "euclidean":
            y = y - q[:, None, :]
            d = np.einsum("qnd,qnd->qn", y, y)
        else:
            d = 1 - np.einsum("qnd,qd->qn", y, q)
        d[nodes < 0] = np.inf
        return d

    def search(self, q: np.ndarray, k: int, ef: int, budget: int = 0, patience: int = 0, saturation: float = 0.95, timeout_ms: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, node, distance): the k nearest that a beam of ``ef`` finds. A query ends early after ``budget`` distances,
        once the best k have stayed (to the share ``saturation``) the same for more than ``patience`` steps, or after
        ``timeout_ms``; 0 switches each off."""
        until = time.monotonic() + timeout_ms / 1000 if timeout_ms else math.inf
        some = np.flatnonzero(self.ok) if self.ok is not None else np.arange(len(self.x))
        whole = exhaustive(len(self.x), k, ef, budget, patience) or (self.ok is not None and len(some) <= max(FEW, 8 * ef))
        mine = self.x[some].astype(np.float64) if whole else None
        out = []
        for lo in range(0, len(q), GROUP):
            part = np.ascontiguousarray(q[lo : lo + GROUP], dtype=np.float32)
            if whole and time.monotonic() < until:
                if len(some):
                    out += [(lo + row, some[col], d) for row, col, d in search._nearest(self.metric, q[lo : lo + GROUP].astype(np.float64), mine, some, k)]
                continue
            near = self._beam(part, k, min(max(k, ef), len(self.x)), budget, patience, saturation, until)
            row, col = np.nonzero(near >= 0)
            node = near[row, col]
            d = D.pairs(self.metric, q[lo + row].astype(np.float64), self.x[node].astype(np.float64))
            order = np.lexsort((node, d, row))
            row, node, d = row[order], node[order], d[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((lo + row[best], node[best], d[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def _descend(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy walks over the upper layers: (node, distance, distances computed) of each query."""
        node = np.full(len(q), self.entry)
        d = self._to(q, node[:, None])[:, 0]
        spent = np.ones(len(q), dtype=np.int64)
        for at, links in self.layers[:0:-1]:
            walking = np.arange(len(q))
            while len(walking):
                row = at[node[walking]]
                near = np.where(row[:, None] >= 0, links[np.maximum(row, 0)], -1)
                dist = self._to(q[walking], near)
                spent[walking] += (near >= 0).sum(axis=1)
                j = dist.argmin(axis=1)
                best = dist[np.arange(len(j)), j]
                moved = best < d[walking]
                node[walking[moved]], d[walking[moved]] = near[np.arange(len(j)), j][moved], best[moved]
                walking = walking[moved]
        return node, d, spent

    def _beam(self, q: np.ndarray, k: int, ef: int, budget: int, patience: int, saturation: float, until: float) -> np.ndarray:
        """Nodes (-1 for none) that the beam of each query ends with."""
        node, d, spent = self._descend(q)
        n = len(q)
        pool_d, pool = np.full((n, ef), np.inf, dtype=np.float32), np.full((n, ef), -1, dtype=np.int64)
        pool_d[:, 0], pool[:, 0] = d, node
        done = np.ones((n, ef), dtype=bool)
        done[:, 0] = False
        ok = self.ok
        if ok is not None:
            kept_d, kept = np.where(ok[pool], pool_d, np.inf), np.where((pool >= 0) & ok[pool], pool, -1)
            kept_d[kept < 0] = np.inf
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[np.arange(n), node] = True
        still = np.zeros(n, dtype=np.int64)
        at, links = self.layers[0]
        alive = np.arange(n)
        while len(alive) and time.monotonic() < until:
            open_d = np.where(done[alive], np.inf, pool_d[alive])
            j = open_d.argmin(axis=1)
            now = open_d[np.arange(len(alive)), j]
            go = np.isfinite(now)
            if ok is not None:  # enough found, and whatever is left is further away
                go &= ~(np.isfinite(kept_d[alive, k - 1]) & (now > kept_d[alive, min(ef, len(kept_d[0])) - 1]))
            if budget:
                go &= spent[alive] < budget
            if patience:
                go &= still[alive] <= patience
            alive, j = alive[go], j[go]
            if not len(alive):
                break
            done[alive, j] = True
            near = links[at[pool[alive, j]]].astype(np.int64)
            near[seen[alive[:, None], np.maximum(near, 0)]] = -1
            some, col = np.nonzero(near >= 0)
            seen[alive[some], near[some, col]] = True
            dist = self._to(q[alive], near)
            spent[alive] += (near >= 0).sum(axis=1)
            every_d, every = np.concatenate([pool_d[alive], dist], axis=1), np.concatenate([pool[alive], near], axis=1)
            order = np.argsort(every_d, axis=1, kind="stable")[:, :ef]
            pool_d[alive], pool[alive] = np.take_along_axis(every_d, order, axis=1), np.take_along_axis(every, order, axis=1)
            done[alive] = np.take_along_axis(np.concatenate([done[alive], near < 0], axis=1), order, axis=1)
            moved = (order[:, :k] >= ef) & np.isfinite(pool_d[alive][:, :k])
            if ok is not None:
                dist = np.where((near >= 0) & ok[np.maximum(near, 0)], dist, np.inf)
                every_d, every = np.concatenate([kept_d[alive], dist], axis=1), np.concatenate([kept[alive], near], axis=1)
                order = np.argsort(every_d, axis=1, kind="stable")[:, :ef]
                kept_d[alive], kept[alive] = np.take_along_axis(every_d, order, axis=1), np.take_along_axis(every, order, axis=1)
                moved = (order[:, :k] >= ef) & np.isfinite(kept_d[alive][:, :k])
            full = np.isfinite((pool_d if ok is None else kept_d)[alive, k - 1])
            same = ((k - np.minimum(moved.sum(axis=1), k)) / k >= saturation) & full
            still[alive] = np.where(same, still[alive] + 1, 0)
        if ok is None:
            return pool
        return np.where(np.isfinite(kept_d), kept, -1)


def _inside(edges: pa.Table, ids: np.ndarray) -> np.ndarray:
    """Rows (layer, src, dst, pos) with nodes numbered as in ``ids``; links of which an end isn't there are left out."""
    src, dst = np.asarray(edges.column("src")), np.asarray(edges.column("dst"))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    if not len(ids):
        return np.zeros((0, 4), dtype=np.int64)
    there = (ids[np.minimum(a, len(ids) - 1)] == src) & (ids[np.minimum(b, len(ids) - 1)] == dst)
    return np.stack([np.asarray(edges.column("layer"))[there], a[there], b[there], np.asarray(edges.column("pos"))[there]], axis=1).astype(np.int64)


def _asked(part: list, metric: str) -> list[tuple[list, np.ndarray]]:
    """(names, matrix) of the queries, by dimension."""
    sizes: dict[int, list[int]] = {}
    for n, r in enumerate(part):
        sizes.setdefault(len(r["q"]), []).append(n)
    out = [([part[n]["query_id"] for n in at], np.array([part[n]["q"] for n in at], dtype=np.float64)) for dim, at in sizes.items() if dim]
    return [(names, D.unit_rows(q)) for names, q in out] if metric == "cosine" else out


def _found(shard: Shard, ids: pa.Array, sets: list, names: list[str], types: tuple, search_for: Callable) -> Iterator[pa.RecordBatch]:
    for queries, q in sets:
        if q.shape[1] == shard.x.shape[1]:
            row, node, d = search_for(shard, q)
            yield pa.RecordBatch.from_arrays([pa.array([queries[r] for r in row.tolist()], types[0]), ids.take(pa.array(node)).cast(types[1]), pa.array(d)], names=names)


def _of_two(f: Callable, shipped) -> Callable:
    """A function of two groups: Spark goes by the number of parameters."""
    return lambda a, b: f(a, b, shipped)


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def probe(
    vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, ef: int = 100, shards: int | None = None, metric: str = "euclidean", budget: int = 0, patience: int = 0,
    saturation: float = 0.95, timeout_ms: int = 0, where: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query",
) -> DataFrame:
    """(query_id, id, distance, rank): every shard is searched by its graph, the best of all are merged.

    ``where`` has the ids that may be returned; the others are traversed. Queries are shipped to all shards, in slices of bounded size."""
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    kind = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, id long, distance double"
    own = _sharded(vectors, shards or shard_count(vectors.count()), id_col, vector_col)
    largest = own.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if exhaustive(largest, k, ef, budget, patience, timeout_ms):
        allowed = where.select(F.col(where.columns[0]).cast("long")) if where is not None else None
        return search.search_batch(own, queries, k, metric, allowed, id_col="id", vector_col="v", query_id=query_id, query_vector=query_vector)
    if where is not None:
        allowed = where.select(F.col(where.columns[0]).cast("long").alias("id")).distinct().withColumn("ok", F.lit(True))
        own = own.join(allowed, "id", "left").withColumn("ok", F.col("ok").isNotNull())
    else:
        own = own.withColumn("ok", F.lit(True))
    links = edges.select("shard", "layer", "src", "dst", "pos")
    filtered = where is not None
    found = None
    for part in search._slices(asked):
        shipped = spark.sparkContext.broadcast(_asked(part, metric))

        def look_at(a: pa.Table, b: pa.Table, shipped) -> pa.Table:
            names, types = ["query_id", "id", "distance"], (_TYPES[kind], pa.int64())
            empty = pa.table([pa.array([], t) for t in (*types, pa.float64())], names=names)
            if not len(a):
                return empty
            x, ids, rows = _read(a, metric)
            ok = np.asarray(a.column("ok").combine_chunks().take(pa.array(rows)).to_numpy(zero_copy_only=False), dtype=bool) if filtered else None
            shard = Shard.of_edges(x, _inside(b, ids), metric, ok)
            look = lambda s, q: s.search(q, k, ef, budget, patience, saturation, timeout_ms)
            batches = list(_found(shard, pa.array(ids), shipped.value, names, types, look))
            return pa.Table.from_batches(batches) if batches else empty

        one = _of_two(look_at, shipped)
        now = own.groupBy("shard").cogroup(links.groupBy("shard")).applyInArrow(one, schema)
        found = now if found is None else found.union(now)
    return search.top_k(found if found is not None else spark.createDataFrame([], schema), k).select("query_id", "id", "distance", "rank")


def repaired(vectors: DataFrame, edges: DataFrame, gone: DataFrame, m: int = 16, shards: int | None = None, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``edges`` without the vectors in ``gone``: nodes that were linked to one keep their other links, and fill the room with its
    neighbours by the diversity rule. ``vectors`` still holds what is gone."""
    own = _sharded(vectors, shards or shard_count(vectors.count()), id_col, vector_col)
    dead = gone.select(F.col(gone.columns[0]).cast("long").alias("id")).distinct().withColumn("dead", F.lit(True))
    own = own.join(dead, "id", "left").withColumn("dead", F.col("dead").isNotNull())

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            x, ids, rows = _read(a, metric)
            dead = np.asarray(a.column("dead").combine_chunks().take(pa.array(rows)).to_numpy(zero_copy_only=False), dtype=bool)
            links = _inside(b, ids)
            for layer in np.unique(links[:, 0]).tolist():
                most = 2 * m if layer == 0 else m
                near: dict[int, list[int]] = {}
                mine = links[links[:, 0] == layer]
                for _, s, t, _ in mine[np.lexsort((mine[:, 3], mine[:, 1]))].tolist():
                    near.setdefault(s, []).append(t)
                for s, old in near.items():
                    if dead[s]:
                        continue
                    kept = [t for t in old if not dead[t]]
                    new = sorted({u for t in old if dead[t] for u in near.get(t, ()) if not dead[u] and u != s} - set(kept))
                    if len(kept) < len(old) and new:
                        both = np.array(kept + new)
                        d = D.pairs(metric, np.repeat(x[s : s + 1], len(both), axis=0), x[both])
                        order = np.lexsort((both, d))
                        both = both[order]
                        chosen = diverse(x, both[None], d[order][None], max(most, len(kept)), metric, np.isin(both, kept)[None])[0]
                        kept = both[chosen].tolist()
                    out += [(layer, s, t, pos) for pos, t in enumerate(kept)]
            rows_ = np.array(out, dtype=np.int64).reshape(-1, 4)
            shard = np.full(len(rows_), a.column("shard")[0].as_py(), np.int32)
        else:
            rows_, shard, ids = np.zeros((0, 4), dtype=np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        cols = [pa.array(shard), pa.array(rows_[:, 0].astype(np.int32)), pa.array(ids[rows_[:, 1]]), pa.array(ids[rows_[:, 2]]), pa.array(rows_[:, 3].astype(np.int32))]
        return pa.table(cols, names=["shard", "layer", "src", "dst", "pos"])

    return own.groupBy("shard").cogroup(edges.select("shard", "layer", "src", "dst", "pos").groupBy("shard")).applyInArrow(one, EDGES)


# packed shards

PACKED = "shard int, n int, keys array<string>, seqs array<long>, body binary"


def pack(vectors: DataFrame, m: int = 16, ef_construction: int = 100, shards: int = 1, seed: int = 42, metric: str = "euclidean") -> DataFrame:
    """One row a shard of ``vectors(key, seq, v)``: ids, vectors and links, as a search reads them."""
    own = vectors.select("key", "seq", "v", F.xxhash64("key", "seq").alias("id")).where("v IS NOT NULL").withColumn("shard", F.pmod("id", F.lit(shards)).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        x, ids, rows = _read(table, metric)
        parts = {"x": x.astype(np.float32)}
        for layer, (members, links) in enumerate(shard_links(x, ids, m, ef_construction, seed, metric)):
            parts |= {f"m{layer}": members.astype(np.int32), f"l{layer}": links}
        body = io.BytesIO()
        np.savez(body, **parts)
        keys, seqs = (table.column(c).combine_chunks().take(pa.array(rows)) for c in ("key", "seq"))
        offs = pa.array([0, len(ids)], pa.int32())
        cols = [pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(offs, keys), pa.ListArray.from_arrays(offs, seqs), pa.array([body.getvalue()], pa.binary())]
        return pa.table(cols, names=["shard", "n", "keys", "seqs", "body"])

    return own.groupBy("shard").applyInArrow(one, PACKED)


def unpacked(body: bytes, metric: str, ok: np.ndarray | None) -> Shard:
    parts = np.load(io.BytesIO(body))
    layers = [(parts[f"m{n}"], parts[f"l{n}"]) for n in range(sum(k[0] == "l" for k in parts.files))]
    return Shard(parts["x"], layers, metric, ok)


def probe_packed(index: DataFrame, queries: DataFrame, k: int, ef: int, metric: str, ok: Callable[[pa.Array, np.ndarray], np.ndarray | None], budget: int = 0, patience: int = 0, saturation: float = 0.95, timeout_ms: int = 0) -> DataFrame:
    """(query_id, key, distance) of the k nearest of each shard; ``ok(keys, seqs)`` marks what may be returned."""
    spark = index.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, key string, distance double"
    found = None
    for part in search._slices(queries):
        shipped = spark.sparkContext.broadcast(_asked(part, metric))

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            look = lambda s, q: s.search(q, k, ef, budget, patience, saturation, timeout_ms)
            for b in batches:
                for n in range(b.num_rows):
                    keys, seqs = b.column(0).slice(n, 1).flatten(), np.asarray(b.column(1).slice(n, 1).flatten())
                    shard = unpacked(b.column(2)[n].as_py(), metric, ok(keys, seqs))
                    yield from _found(shard, keys, shipped.value, ["query_id", "key", "distance"], (_TYPES[kind], pa.string()), look)

        now = index.select("keys", "seqs", "body").mapInArrow(scan, schema)
        found = now if found is None else found.union(now)
    return found if found is not None else spark.createDataFrame([], schema)
