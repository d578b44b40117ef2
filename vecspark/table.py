"""``VectorTable``: a versioned table of vectors with external ids and metadata, as an immutable value.

A table is a log of three kinds of rows: vectors, tombstones and metadata changes, each with a sequence number. The live
rows are the vectors without a later tombstone, with their latest metadata: two joins, left out while there are no
tombstones or changes. Changes give a new handle whose log has further rows; ``sync`` writes these as Parquet files and a
manifest that lists all files of the snapshot, so that commits share files, and branches copy none.

Ids are long, string or UUID; their type is part of the id (1 and "1" differ). Ids of None or blank text become random
UUIDs. Metadata are JSON objects. Null vectors or vectors of another dimension are refused.

``index_type`` says how committed tables are searched: "exact" compares all vectors; with "hnsw" and "ivf" every commit adds
an index segment of its new vectors (shards of a graph, or cells), which searches read in place of the vectors; deleted
vectors are traversed, not returned, and filters hold within the search. Searches are exact, whatever the type, while
there are changes that aren't synced, where more than ``MASKED`` ids are deleted or allowed (they are shipped), and where all of
every segment would be visited: a beam as wide as the segment, or probes of all cells.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.ann import graph, ivf
from vecspark.functions import distance as D
from vecspark.functions import params
from vecspark.operators import filters, search
from vecspark.operators import metrics as M
from vecspark.sources.store import Conflict, Store

MASKED = 1_000_000
VECTORS = "id string, id_type string, embedding array<float>, metadata string, seq long, batch string, pid int, idx long"
TOMBSTONES = "id string, id_type string, seq long"
METADATA = "id string, id_type string, metadata string, seq long"


@dataclass(frozen=True)
class Config:
    dim: int
    distance: str = "euclidean"
    index_type: str = "exact"
    m: int = 16
    ef_construction: int | None = None
    ef_search: int | None = None
    capacity: int | None = None
    max_levels: int | None = None
    crypto_hash: bool = False
    seed: int | None = None

    def checked(self) -> Config:
        if not isinstance(self.dim, int) or self.dim < 1:
            raise ValueError("dim must be a positive number")
        if self.distance not in D.METRICS:
            raise ValueError(f"unknown metric {self.distance!r}")
        if self.index_type not in ("exact", "ivf", "hnsw"):
            raise ValueError(f"unknown index type {self.index_type!r}")
        if self.seed is not None and not isinstance(self.seed, int):
            raise ValueError("seed must be a whole number or None")
        capacity = self.capacity or params.default_capacity(self.dim)
        efc = self.ef_construction or params.recommended_ef_construction(capacity, self.m)
        efs = self.ef_search or params.recommended_ef_search(10, capacity)
        return replace(self, capacity=capacity, ef_construction=efc, ef_search=efs)

    @property
    def m0(self) -> int:
        return 2 * self.m

    @property
    def ml(self) -> float:
        return 1 / math.log(self.m)


def encoded(value: Any) -> tuple[str, str]:
    """(id, type) of an external id; None and blank text give a random UUID."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return str(uuid.uuid4()), "uuid"
    if isinstance(value, bool):
        raise TypeError("a boolean is no id")
    if isinstance(value, int):
        return str(value), "long"
    if isinstance(value, uuid.UUID):
        return str(value), "uuid"
    if isinstance(value, str):
        return value, "string"
    raise TypeError(f"{type(value).__name__} is no type of ids")


def decoded(value: str, kind: str) -> Any:
    return int(value) if kind == "long" else uuid.UUID(value) if kind == "uuid" else value


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


class VectorTable:
    def __init__(self, spark: SparkSession, store: Store, config: Config, base: dict | None, branch: str, pending: tuple = (), seq: int | None = None, slots: int | None = None, parent: str | None = None):
        self.spark, self.store, self.config, self.base, self.current = spark, store, config, base, branch
        self.pending = pending  # (kind, DataFrame), in order
        self.seq_no = seq if seq is not None else (base or {}).get("seq", 0)
        self.slots = slots if slots is not None else (base or {}).get("slots", 0)
        self.parent = parent if parent is not None else (base or {}).get("id")
        self._live_count: int | None = None if pending else (base or {}).get("live", 0)

    # creation and loading

    @classmethod
    def create(cls, spark: SparkSession, root: str, dim: int, branch: str = "main", **options: Any) -> VectorTable:
        config = Config(dim=dim, **options).checked()
        store = Store(root)
        store.write(asdict(config) | {"created": time.time(), "table_id": str(uuid.uuid4())}, "config.json", exclusive=True)
        return cls(spark, store, config, None, branch)

    @classmethod
    def _open(cls, root: str) -> tuple[Store, Config]:
        store = Store(root)
        if not store.exists("config.json"):
            raise FileNotFoundError(f"there is no table at {root}")
        known = store.read("config.json")
        missing = [k for k in Config.__dataclass_fields__ if k not in known]
        if missing:
            raise ValueError(f"the configuration lacks {', '.join(missing)}")
        return store, Config(**{k: known[k] for k in Config.__dataclass_fields__})

    @classmethod
    def load(cls, spark: SparkSession, root: str, branch: str = "main") -> VectorTable:
        store, config = cls._open(root)
        head = store.head(branch)
        if head is None:
            raise KeyError(f"there is no branch {branch}; there are {', '.join(store.branches()) or 'none'}")
        return cls(spark, store, config, store.commit(head), branch)

    @classmethod
    def load_commit(cls, spark: SparkSession, root: str, commit_id: str | uuid.UUID, branch: str | None = None) -> VectorTable:
        store, config = cls._open(root)
        base = store.commit(str(params.as_uuid(commit_id)))
        return cls(spark, store, config, base, branch or base["branch"])

    def _with(self, **changes: Any) -> VectorTable:
        own = {"base": self.base, "branch": self.current, "pending": self.pending, "seq": self.seq_no, "slots": self.slots, "parent": self.parent} | changes
        return VectorTable(self.spark, self.store, self.config, **own)

    def fork(self) -> VectorTable:
        """A handle of its own; handles never change, so nothing is copied."""
        return self._with()

    def close(self) -> None:
        """Nothing is held open."""

    # the log

    def _log(self, kind: str, schema: str) -> DataFrame | None:
        frames = []
        if self.base and self.base[kind]:
            frames.append(self.spark.read.schema(schema).parquet(*[self.store.path("data", p) for p in self.base[kind]]))
        frames += [df for k, df in self.pending if k == kind]
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def entries(self) -> DataFrame:
        """(id, id_type, embedding, metadata, seq, batch, pid, idx) of the live vectors."""
        rows = self._log("vectors", VECTORS)
        if rows is None:
            return self.spark.createDataFrame([], VECTORS)
        gone = self._log("tombstones", TOMBSTONES)
        if gone is not None:
            last = gone.groupBy("id", "id_type").agg(F.max("seq").alias("__gone"))
            rows = rows.join(last, ["id", "id_type"], "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col("seq"))).drop("__gone")
        changed = self._log("metadata", METADATA)
        if changed is not None:
            last = changed.groupBy("id", "id_type").agg(F.max_by(F.struct("metadata", "seq"), "seq").alias("__new"))
            new = F.when(F.col("__new.seq") > F.col("seq"), F.col("__new.metadata")).otherwise(F.col("metadata"))
            rows = rows.join(last, ["id", "id_type"], "left").withColumn("metadata", new).drop("__new")
        return rows

    def vectors(self, node_ids: bool = False) -> DataFrame:
        """(id, id_type, embedding, metadata[, node_id]) of the live vectors."""
        rows = self.entries()
        if not node_ids:
            return rows.select("id", "id_type", "embedding", "metadata")
        starts = self.spark.createDataFrame([(s["batch"], int(p), n) for s in self._starts() for p, n in s["parts"].items()], "batch string, pid int, start long")
        return rows.join(starts, ["batch", "pid"]).select("id", "id_type", "embedding", "metadata", (F.col("start") + F.col("idx")).alias("node_id"))

    def _starts(self) -> list[dict]:
        return [*(self.base or {}).get("starts", []), *(x for k, x in self.pending if k == "starts")]

    def seq(self) -> DataFrame:
        """(id, id_type, embedding) of all live vectors, ordered by id: numbers before text."""
        return self.vectors().select("id", "id_type", "embedding").orderBy(F.expr("CASE WHEN id_type = 'long' THEN CAST(id AS long) END").asc_nulls_last(), "id_type", "id")

    def __iter__(self) -> Iterator[tuple[Any, list[float]]]:
        for r in self.seq().toLocalIterator():
            yield decoded(r["id"], r["id_type"]), r["embedding"]

    # lookups

    def _at(self, key: Any) -> Column:
        i, kind = encoded(key)
        return (F.col("id") == i) & (F.col("id_type") == kind)

    def get_vector(self, key: Any) -> list[float] | None:
        row = self.vectors().where(self._at(key)).select("embedding").first()
        return None if row is None else row[0]

    def get_metadata(self, key: Any) -> dict | None:
        row = self.vectors().where(self._at(key)).select("metadata").first()
        return None if row is None else json.loads(row[0] or "{}") | {"external-id": key}

    def lookup_internal_id(self, key: Any) -> int | None:
        row = self.vectors(node_ids=True).where(self._at(key)).select("node_id").first()
        return None if row is None else row[0]

    def contains(self, key: Any) -> bool:
        return self.vectors().where(self._at(key)).limit(1).count() > 0

    __contains__ = contains

    def contains_batch(self, ids: DataFrame) -> DataFrame:
        """(id, present) of every id in the first column of ``ids``: one join, however many."""
        own = self.vectors().select("id", "id_type", F.lit(True).alias("there"))
        asked = self._framed(ids).drop("seq")
        name = ids.columns[0]
        typed = F.col("id").cast(ids.schema[0].dataType).alias(name)
        return asked.join(own, ["id", "id_type"], "left").select(typed, F.col("there").isNotNull().alias("present"))

    # changes

    def _rows(self, rows: Iterable[tuple[Any, Sequence[float], dict | None]]) -> tuple[DataFrame, int]:
        out, batch, seq = [], uuid.uuid4().hex, self.seq_no + 1
        for n, (key, vector, meta) in enumerate(rows):
            v = [float(x) for x in vector]
            if len(v) != self.config.dim:
                raise ValueError(f"a vector has {len(v)} elements; the table has {self.config.dim}")
            out.append((*encoded(key), v, canonical({k: x for k, x in (meta or {}).items() if k != "external-id"}), seq, batch, 0, n))
        self._check_room(len(out))
        return self.spark.createDataFrame(out, VECTORS), len(out)

    def _check_room(self, n: int) -> None:
        if n > self.remaining_capacity():
            raise ValueError(f"{n} vectors don't fit: there is room for {self.remaining_capacity()}")

    def _refuse_conflicts(self, new: DataFrame) -> None:
        repeated = new.groupBy("id", "id_type").count().where("count > 1").select("id")
        present = self.entries().select("id", "id_type").join(new.select("id", "id_type"), ["id", "id_type"], "left_semi").select("id")
        if bad := repeated.unionByName(present).limit(5).collect():
            raise ValueError("these ids are there already: " + ", ".join(r[0] for r in bad))

    def _inserted(self, df: DataFrame, n: int, parts: dict[str, int], batch: str) -> VectorTable:
        starts, at = {}, self.slots
        for p in sorted(parts, key=int):
            starts[p] = at
            at += parts[p]
        return self._with(pending=(*self.pending, ("vectors", df), ("starts", {"batch": batch, "parts": starts})), seq=self.seq_no + 1, slots=self.slots + n)

    def insert(self, vector: Sequence[float], key: Any = None, metadata: dict | None = None) -> VectorTable:
        return self.insert_batch([vector], [key], [metadata])

    def insert_batch(self, vectors: Sequence[Sequence[float]] | DataFrame, ids: Sequence[Any] | None = None, metadata: Sequence[dict | None] | None = None) -> VectorTable:
        """All or nothing; ids that are there, or come twice, raise. A DataFrame has (id, embedding[, metadata JSON])."""
        if isinstance(vectors, DataFrame):
            return self._insert_frame(vectors)
        ids = [None] * len(vectors) if ids is None else ids
        metadata = [None] * len(vectors) if metadata is None else metadata
        if not len(vectors) == len(ids) == len(metadata):
            raise ValueError(f"there are {len(vectors)} vectors, {len(ids)} ids and {len(metadata)} metadata")
        if not len(vectors):
            return self
        df, n = self._rows(zip(ids, vectors, metadata, strict=True))
        self._refuse_conflicts(df)
        return self._inserted(df, n, {"0": n}, df.first()["batch"])

    def _insert_frame(self, new: DataFrame) -> VectorTable:
        """Stages the rows once, as the files that a later commit will list; ids are dense by partition sizes."""
        kind = {"string": "string"}.get(new.schema["id"].dataType.simpleString(), "long")
        key = F.col("id").cast("string")
        blank = key.isNull() | (F.trim(key) == "")
        meta = F.coalesce(F.col("metadata").cast("string"), F.lit("{}")) if "metadata" in new.columns else F.lit("{}")
        batch = uuid.uuid4().hex
        rows = new.select(
            F.when(blank, F.uuid()).otherwise(key).alias("id"), F.when(blank, "uuid").otherwise(kind).alias("id_type"), F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("metadata"),
            F.lit(self.seq_no + 1).cast("long").alias("seq"), F.lit(batch).alias("batch"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("idx"),
        )
        path = f"vectors-{batch}"
        rows.write.parquet(self.store.path("data", path))
        staged = self.spark.read.schema(VECTORS).parquet(self.store.path("data", path))
        try:
            usable = F.col("embedding").isNotNull() & (F.size("embedding") == self.config.dim)
            sizes = staged.groupBy("pid").agg(F.count("*").alias("n"), F.count_if(~usable).alias("bad")).collect()
            if any(r["bad"] for r in sizes):
                raise ValueError(f"{sum(r['bad'] for r in sizes)} vectors are null or don't have {self.config.dim} elements")
            n = sum(r["n"] for r in sizes)
            if n == 0:
                return self
            self._check_room(n)
            self._refuse_conflicts(staged)
        except ValueError:
            self.store.remove("data", path)
            raise
        staged.vecspark_path = path
        return self._inserted(staged, n, {str(r["pid"]): r["n"] for r in sizes}, batch)

    def _keys(self, keys: Iterable[Any]) -> DataFrame:
        return self.spark.createDataFrame([(*encoded(k), self.seq_no + 1) for k in keys], TOMBSTONES)

    def _framed(self, ids: DataFrame) -> DataFrame:
        kind = "string" if ids.schema[0].dataType.simpleString() == "string" else "long"
        typed = F.col("id_type") if "id_type" in ids.columns else F.lit(kind)
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id"), typed.alias("id_type"), F.lit(self.seq_no + 1).cast("long").alias("seq"))

    def delete(self, key: Any) -> VectorTable:
        return self.delete_batch([key])

    dissoc = delete

    def delete_batch(self, keys: Iterable[Any] | DataFrame) -> VectorTable:
        """Soft delete; absent ids change nothing."""
        gone = self._framed(keys) if isinstance(keys, DataFrame) else self._keys(keys)
        return self._with(pending=(*self.pending, ("tombstones", gone)), seq=self.seq_no + 1)

    def delete_where(self, predicate: Column | str) -> VectorTable:
        return self.delete_batch(self._filtered(predicate).select("id", "id_type"))

    def with_metadata(self, key: Any, metadata: dict | None) -> VectorTable:
        """Replaces the metadata; None changes nothing; an absent id raises."""
        if metadata is None:
            return self
        if not self.contains(key):
            raise KeyError(f"there is no vector {key!r}")
        row = [(*encoded(key), canonical({k: x for k, x in metadata.items() if k != "external-id"}), self.seq_no + 1)]
        return self._with(pending=(*self.pending, ("metadata", self.spark.createDataFrame(row, METADATA))), seq=self.seq_no + 1)

    def upsert(self, vectors: Sequence[Sequence[float]], ids: Sequence[Any], metadata: Sequence[dict | None] | None = None) -> VectorTable:
        return self.delete_batch(ids).insert_batch(vectors, ids, metadata)

    def assoc(self, key: Any, value: Sequence[float] | dict) -> VectorTable:
        if isinstance(value, dict):
            return self.insert(value["vector"], key, value.get("metadata"))
        return self.insert(value, key)

    def assoc_ex(self, key: Any, value: Sequence[float] | dict) -> VectorTable:
        """``assoc`` that says so in its name: an id that is there raises."""
        if self.contains(key):
            raise ValueError(f"{key!r} is there already")
        return self.assoc(key, value)

    def conj(self, entry: tuple[Any, Any]) -> VectorTable:
        return self.assoc(*entry)

    def into(self, entries: Iterable[tuple[Any, Any]]) -> VectorTable:
        rows = [(k, v["vector"], v.get("metadata")) if isinstance(v, dict) else (k, v, None) for k, v in entries]
        return self.insert_batch([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows])

    def transient(self) -> Transient:
        return Transient(self)

    def __setitem__(self, key: Any, value: Any) -> None:
        raise TypeError("tables are values: use assoc")

    # counts and configuration

    def count(self) -> int:
        """Live vectors."""
        if self._live_count is None:
            self._live_count = self.entries().count()
        return self._live_count

    count_vectors = __len__ = count

    def count_total(self) -> int:
        return self.slots

    def count_deleted(self) -> int:
        return self.slots - self.count()

    def capacity(self) -> int:
        return self.config.capacity

    def remaining_capacity(self) -> int:
        """Deleted vectors still take their slot."""
        return self.config.capacity - self.slots

    def index_type(self) -> str:
        return self.config.index_type

    def index_config(self) -> dict:
        return {k: v for k, v in asdict(self.config).items() if k != "capacity"}

    def metrics(self) -> dict:
        total, live = self.slots, self.count()
        gone = total - live
        share = gone / total if total else 0.0
        return {
            "vector_count": total, "deleted_count": gone, "live_count": live, "deletion_ratio": share, "needs_compaction": share > M.COMPACT_ABOVE,
            "capacity": self.config.capacity, "utilization": total / self.config.capacity, "branch": self.current, "commit_id": self.get_commit_id(),
        }

    def needs_compaction(self, threshold: float = M.COMPACT_ABOVE) -> bool:
        return self.slots > 0 and self.count_deleted() / self.slots > threshold

    # search

    def _filtered(self, where: Any) -> DataFrame:
        rows = self.vectors()
        if where is None:
            return rows
        if isinstance(where, str):
            return rows.where(filters.compile(where, filters.json("metadata")))
        if callable(where) and not isinstance(where, Column):
            return self._by_predicate(rows, where)
        if isinstance(where, Column):
            return rows.where(F.coalesce(where, F.lit(False)))
        if isinstance(where, DataFrame):
            ids = self._framed(where).drop("seq").distinct()
        elif isinstance(where, list | tuple | set | frozenset):
            ids = self._keys(where).drop("seq").distinct()
        else:
            raise TypeError(f"a filter is a text, a Column, a DataFrame of ids or a collection of ids, not {type(where).__name__}")
        return rows.join(ids, ["id", "id_type"], "left_semi")

    def _by_predicate(self, rows: DataFrame, keep: Any) -> DataFrame:
        """Rows for which ``keep(id, metadata)`` holds, by Arrow batches; text filters and Columns stay within the plan and are faster."""

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, kinds, meta = (b.column(c).to_pylist() for c in ("id", "id_type", "metadata"))
                keys = [decoded(i, kind) for i, kind in zip(ids, kinds, strict=True)]
                yield b.filter(pa.array([bool(keep(key, json.loads(m or "{}") | {"external-id": key})) for key, m in zip(keys, meta, strict=True)], pa.bool_()))

        return rows.mapInArrow(kept, rows.schema)

    def make_id_filter(self, keys: Iterable[Any]) -> DataFrame:
        """A set of ids to be used in many searches; ``unpersist()`` it after the last."""
        return self._keys(keys).drop("seq").distinct().persist()

    def search(self, query: Sequence[float], k: int = 10, where: Any = None, min_similarity: float = 0.0, with_metadata: bool = False, exact: bool = False, **options: Any) -> list[dict]:
        """The k nearest, nearest first. ``where`` is a filter text, a Column, a predicate (id, metadata), or a set of ids. Options of indexes
        are those of ``search_batch``."""
        if len(query) != self.config.dim:
            raise ValueError(f"the query has {len(query)} elements; the table has {self.config.dim}")
        if self._indexed(exact):
            asked = self.spark.createDataFrame([(0, [float(np.float32(v)) for v in query])], "query_id int, query array<double>")
            found = self.search_batch(asked, k, where, min_similarity, **options).orderBy("rank").collect()
            keys = [(r["id"].partition(":")[2], r["id"].partition(":")[0], r["distance"]) for r in found]
            meta = {}
            if with_metadata and keys:
                wanted = self.spark.createDataFrame([x[:2] for x in keys], "id string, id_type string")
                meta = {(r["id"], r["id_type"]): r["metadata"] for r in self.vectors().join(wanted, ["id", "id_type"], "left_semi").select("id", "id_type", "metadata").collect()}
        else:
            self._only_exact(options)
            rows = self._filtered(where).select(F.struct("id_type", "id").alias("key"), "embedding", "metadata")
            found = search.search(rows, query, k, self.config.distance, None, min_similarity, ["metadata"] if with_metadata else [], "key", "embedding").orderBy("rank").collect()
            keys = [(r["id"]["id"], r["id"]["id_type"], r["distance"]) for r in found]
            meta = {(r["id"]["id"], r["id"]["id_type"]): r["metadata"] for r in found} if with_metadata else {}
        out = []
        for i, kind, d in keys:
            one = {"id": decoded(i, kind), "distance": d}
            out.append(one | ({"metadata": json.loads(meta.get((i, kind)) or "{}") | {"external-id": one["id"]}} if with_metadata else {}))
        return out

    nearest = search

    def search_filtered(self, query: Sequence[float], k: int, where: Any, **options: Any) -> list[dict]:
        return self.search(query, k, where, **options)

    nearest_filtered = search_filtered

    def search_with_metadata(self, query: Sequence[float], k: int = 10, **options: Any) -> list[dict]:
        return self.search(query, k, with_metadata=True, **options)

    OPTIONS = ("ef", "probes", "budget", "patience", "saturation", "timeout_ms")

    def _only_exact(self, options: dict) -> None:
        if unknown := set(options) - set(self.OPTIONS):
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")

    def search_batch(self, queries: DataFrame, k: int = 10, where: Any = None, min_similarity: float = 0.0, exact: bool = False, strategy: str = "auto", exclude_self: bool = False, **options: Any) -> DataFrame:
        """(query_id, id, distance, rank) for a DataFrame of (query_id, query); id is "type:id".

        Options, for tables with an index: ``ef`` (width of the beam; else the table's, or 10k with a filter), ``probes`` (cells to visit;
        else half of them), ``budget``, ``patience`` (True: max(7, 0.3k)), ``saturation`` and ``timeout_ms`` end a walk early."""
        self._only_exact(options)
        found = self._approximate(queries, k, where, options) if self._indexed(exact) and not exclude_self and strategy == "auto" else None
        if found is None:
            rows = self._filtered(where).select(F.concat_ws(":", "id_type", "id").alias("vec_id"), "embedding")
            return search.search_batch(rows, queries, k, self.config.distance, None, min_similarity, exclude_self, strategy)
        if min_similarity > 0:
            found = found.where(D.similarity(F.col("distance")) >= min_similarity)
        return search.top_k(found.withColumnRenamed("key", "id"), k).select("query_id", "id", "distance", "rank")

    def _indexed(self, exact: bool) -> bool:
        return not exact and self.config.index_type != "exact" and not self.pending and bool((self.base or {}).get("index"))

    def _approximate(self, queries: DataFrame, k: int, where: Any, options: dict) -> DataFrame | None:
        """(query_id, key, distance) from the index segments; None where the search is an exact one: all would be visited, or the ids
        to leave out, or to allow, are too many to ship."""
        if k < 1:
            raise ValueError("k must be at least 1")
        key = F.concat_ws(":", "id_type", "id").alias("key")
        patience = graph.default_patience(k) if options.get("patience") is True else int(options.get("patience") or 0)
        ef = options.get("ef") or (10 * k if where is not None else self.config.ef_search)
        ends = [options.get("budget") or 0, patience, options.get("timeout_ms") or 0]
        if all(graph.exhaustive(s["rows"], k, ef, *ends) if s["kind"] == "hnsw" else (options.get("probes") or 0) >= s["cells"] for s in self.base["index"]):
            return None
        gone = self._log("tombstones", TOMBSTONES)
        gone = None if gone is None else gone.groupBy(key).agg(F.max("seq").alias("seq")).limit(MASKED + 1).toArrow()
        allowed = None if where is None else self._filtered(where).select(key).limit(MASKED + 1).toArrow()
        if max(len(x) if x is not None else 0 for x in (gone, allowed)) > MASKED:
            return None
        shipped = self.spark.sparkContext.broadcast((None if gone is None else (gone["key"].combine_chunks(), np.asarray(gone["seq"])), None if allowed is None else allowed["key"].combine_chunks()))

        def ok(keys: pa.Array, seqs: np.ndarray) -> np.ndarray | None:
            gone, allowed = shipped.value
            if gone is None and allowed is None:
                return None
            mask = np.ones(len(keys), dtype=bool)
            if gone is not None and len(gone[0]):
                at = pc.index_in(keys, gone[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                mask &= (at < 0) | (gone[1][np.maximum(at, 0)] < seqs)
            if allowed is not None:
                mask &= pc.is_in(keys, allowed).to_numpy(zero_copy_only=False)
            return mask

        asked = queries.select("query_id", F.col("query").alias("q"))
        found = None
        for s in self.base["index"]:
            if s["kind"] == "hnsw":
                index = self.spark.read.schema(graph.PACKED).parquet(self.store.path("data", s["path"]))
                now = graph.probe_packed(index, asked, k, ef, self.config.distance, ok, options.get("budget", 0), patience, options.get("saturation", 0.95), options.get("timeout_ms", 0))
            else:
                index = self.spark.read.schema(ivf.PACKED).parquet(self.store.path("data", s["path"]))
                centroids = np.array(self.store.read("data", s["path"] + "-centroids", "centroids.json"))
                now = ivf.probe_packed(index, asked, centroids, k, options.get("probes") or -(-len(centroids) // 2), self.config.distance, ok)
            found = now if found is None else found.unionByName(now)
        return found

    def _segment(self, paths: list[str]) -> dict | None:
        """An index segment of the vectors in these folders."""
        rows = self.spark.read.schema(VECTORS).parquet(*[self.store.path("data", p) for p in paths]).select(F.concat_ws(":", "id_type", "id").alias("key"), "seq", F.col("embedding").alias("v"))
        n = rows.count()
        if n == 0:
            return None
        c, path = self.config, f"index-{uuid.uuid4().hex}"
        if c.index_type == "hnsw":
            shards = graph.shard_count(n)
            graph.pack(rows, c.m, c.ef_construction, shards, c.seed or 42, c.distance).write.parquet(self.store.path("data", path))
            return {"kind": "hnsw", "path": path, "rows": n, "shards": shards}
        centroids = ivf.fit(rows, ivf.cell_count(n), c.distance, seed=c.seed or 42, id_col="key", vector_col="v")
        ivf.pack(rows, centroids, n, c.distance).write.partitionBy("cell").parquet(self.store.path("data", path))
        self.store.write(centroids.tolist(), "data", path + "-centroids", "centroids.json")
        return {"kind": "ivf", "path": path, "rows": n, "cells": len(centroids)}

    # commits

    def get_branch(self) -> str:
        return self.current

    def get_commit_id(self) -> str | None:
        """None while there are changes that aren't synced."""
        return None if self.pending else (self.base or {}).get("id")

    def is_dirty(self) -> bool:
        return bool(self.pending)

    def flush(self) -> VectorTable:
        """Writes what is pending; no manifest lists the files yet."""
        kept = []
        for kind, df in self.pending:
            if kind != "starts" and not hasattr(df, "vecspark_path"):
                path = f"{kind}-{uuid.uuid4().hex}"
                df.write.parquet(self.store.path("data", path))
                df = self.spark.read.schema({"vectors": VECTORS, "tombstones": TOMBSTONES, "metadata": METADATA}[kind]).parquet(self.store.path("data", path))
                df.vecspark_path = path
            kept.append((kind, df))
        return self._with(pending=tuple(kept))

    def digests(self, paths: list[str]) -> dict[str, str]:
        """SHA-512 of every data file of these folders, computed on the executors."""
        if not paths:
            return {}
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([self.store.path("data", p) for p in paths])
        rows = files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 512).alias("digest")).collect()
        return {r["file"]: r["digest"] for r in sorted(rows)}

    def sync(self, message: str | None = None, parents: Sequence[str] | None = None) -> VectorTable:
        """A durable commit at the head of the branch; raises ``Conflict`` where the branch has moved on."""
        if self.base is not None and not self.pending and parents is None:
            return self
        head = self.store.head(self.current)
        if head != self.parent:
            raise Conflict(f"{self.current} is at {head}; this table was read at {self.parent}")
        flushed = self.flush()
        base = self.base or {}
        paths = {kind: [*base.get(kind, []), *(df.vecspark_path for k, df in flushed.pending if k == kind)] for kind in ("vectors", "tombstones", "metadata")}
        manifest = {
            "parents": list(dict.fromkeys([*([self.parent] if self.parent else []), *(parents or [])])), "branch": self.current, "message": message, "seq": self.seq_no, "slots": self.slots,
            "live": flushed.entries().count(), "starts": flushed._starts(), "created": base.get("created", time.time()), "updated": time.time(), **paths,
        }
        if self.config.index_type != "exact":
            fresh = [df.vecspark_path for k, df in flushed.pending if k == "vectors"]
            segment = self._segment(fresh) if fresh else None
            manifest["index"] = [*base.get("index", []), *([segment] if segment else [])]
        if self.config.crypto_hash:
            known = base.get("digests", {})
            new = [p for kind in paths for p in paths[kind] if not any(f.startswith(p + "/") for f in known)]
            manifest["digests"] = known | self.digests(new)
        return self._committed(manifest, self.parent)

    def _committed(self, manifest: dict, expected: str | None) -> VectorTable:
        manifest["id"] = commit_hash(manifest) if self.config.crypto_hash else str(uuid.uuid4())
        self.store.write(manifest, "commits", f"{manifest['id']}.json")
        self.store.advance(manifest["branch"], expected, manifest["id"])
        return VectorTable(self.spark, self.store, self.config, manifest, manifest["branch"])

    # branches and history

    def branches(self) -> list[str]:
        return self.store.branches()

    def make_branch(self, name: str, message: str | None = None) -> VectorTable:
        """A new branch from this table's commit, which may be an old one. No file is copied."""
        if self.base is None:
            raise ValueError("there is nothing to branch from before the first sync")
        if self.pending:
            raise ValueError(f"there are changes that aren't synced: {self.count()} vectors now, {self.base['live']} in the commit")
        if name in self.store.branches():
            raise ValueError(f"there is a branch {name} already")
        manifest = {k: v for k, v in self.base.items() if k != "id"} | {"parents": [self.base["id"]], "branch": name, "message": message, "updated": time.time()}
        return self._committed(manifest, None)

    def checkout(self, name: str) -> VectorTable:
        return VectorTable.load(self.spark, self.store.root, name)

    def delete_branch(self, name: str) -> None:
        if name in (self.current, "main"):
            raise ValueError(f"{name} can't be deleted")
        if name not in self.store.branches():
            raise KeyError(f"there is no branch {name}")
        self.store.remove("refs", name)

    def reset(self, commit_id: str | uuid.UUID) -> VectorTable:
        commit = self.store.commit(str(params.as_uuid(commit_id)))
        self.store.advance(self.current, self.store.head(self.current), commit["id"])
        return VectorTable(self.spark, self.store, self.config, commit, self.current)

    def commit_info(self, commit_id: str | uuid.UUID) -> dict | None:
        try:
            c = self.store.commit(str(params.as_uuid(commit_id)))
        except KeyError:
            return None
        return {k: c[k] for k in ("id", "parents", "created", "updated", "branch", "message")} | {"vector_count": c["slots"], "deleted_count": c["slots"] - c["live"]}

    def history(self, limit: int | None = None) -> list[dict]:
        """Commits from this table's on, newest first, along first parents."""
        out, at = [], self.parent
        while at and (limit is None or len(out) < limit):
            out.append(self.commit_info(at))
            at = out[-1]["parents"][0] if out[-1]["parents"] else None
        return out

    def parents(self) -> list[str]:
        return list((self.base or {}).get("parents", []))

    def ancestors(self, commit_id: str | uuid.UUID | None = None, include_self: bool = True) -> list[str]:
        """Breadth-first, nearest first."""
        start = str(commit_id or self.parent)
        out, todo, seen = [], [start], {start}
        while todo:
            at = todo.pop(0)
            out.append(at)
            for p in self.store.commit(at)["parents"]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return out if include_self else out[1:]

    def is_ancestor(self, ancestor: str, commit_id: str) -> bool:
        return str(ancestor) in self.ancestors(commit_id)

    def common_ancestor(self, a: str, b: str) -> str | None:
        known = set(self.ancestors(a))
        return next((c for c in self.ancestors(b) if c in known), None)

    def commit_graph(self) -> dict:
        commits = self.store.commits()
        nodes = {i: {"parents": c["parents"], "branch": c["branch"], "vector_count": c["slots"]} for i, c in commits.items()}
        return {"nodes": nodes, "branches": {b: self.store.head(b) for b in self.branches()}, "roots": sorted(i for i, c in commits.items() if not c["parents"])}

    def commits_frame(self) -> DataFrame:
        rows = [(i, c["parents"], c["branch"], c["message"], c["slots"], c["live"]) for i, c in self.store.commits().items()]
        return self.spark.createDataFrame(rows, "commit_id string, parents array<string>, branch string, message string, vector_count long, live_count long")

    def merge(self, source: str | VectorTable, ids: Iterable[Any] | str | None = None, message: str | None = None) -> VectorTable:
        """Copies the chosen ids ("all", or a collection) that this table doesn't have; a commit of two parents."""
        if ids is None:
            raise ValueError('say which ids to merge: a collection, or "all"')
        other = self.checkout(source) if isinstance(source, str) else source
        if other.base is None or other.pending or self.pending:
            raise ValueError("both sides must be synced before they are merged")
        rows = other.vectors() if isinstance(ids, str) and ids == "all" else other._filtered(list(ids))
        new = rows.join(self.entries().select("id", "id_type"), ["id", "id_type"], "left_anti")
        merged = self._copied(new)
        return merged.sync(message or f"merge of {other.current}", [other.base["id"]])

    def _copied(self, rows: DataFrame) -> VectorTable:
        batch = uuid.uuid4().hex
        path = f"vectors-{batch}"
        out = rows.select("id", "id_type", "embedding", "metadata", F.lit(self.seq_no + 1).cast("long").alias("seq"), F.lit(batch).alias("batch"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("idx"))
        out.write.parquet(self.store.path("data", path))
        staged = self.spark.read.schema(VECTORS).parquet(self.store.path("data", path))
        sizes = {str(r["pid"]): r["count"] for r in staged.groupBy("pid").count().collect()}
        self._check_room(sum(sizes.values()))
        staged.vecspark_path = path
        return self._inserted(staged, sum(sizes.values()), sizes, batch) if sizes else self

    def diff(self, other: VectorTable) -> DataFrame:
        """(id, id_type, change) from this table to ``other``."""
        a, b = self.entries().select("id", "id_type"), other.entries().select("id", "id_type")
        added = b.join(a, ["id", "id_type"], "left_anti").withColumn("change", F.lit("added"))
        return added.unionByName(a.join(b, ["id", "id_type"], "left_anti").withColumn("change", F.lit("removed")))

    def __eq__(self, other: object) -> bool:
        if self is other:
            return True
        same = isinstance(other, VectorTable) and self.config.crypto_hash and other.config.crypto_hash
        return bool(same and self.get_commit_id() and self.get_commit_id() == other.get_commit_id())

    __hash__ = object.__hash__

    # integrity

    def crypto_hash(self) -> bool:
        return self.config.crypto_hash

    def get_commit_hash(self) -> str | None:
        return self.get_commit_id() if self.config.crypto_hash else None

    merkle_root = get_commit_hash


class Transient:
    """Collects changes; on ``persistent`` deletes apply first, then one batch of inserts."""

    def __init__(self, table: VectorTable):
        self.table, self.rows, self.gone = table, [], []

    def insert(self, vector: Sequence[float], key: Any = None, metadata: dict | None = None) -> Transient:
        self.rows.append((vector, key, metadata))
        return self

    def delete(self, key: Any) -> Transient:
        self.gone.append(key)
        return self

    def count(self) -> int:
        there = sum(self.table.contains(k) for k in dict.fromkeys(self.gone))
        return self.table.count() + len(self.rows) - there

    def persistent(self) -> VectorTable:
        table = self.table.delete_batch(self.gone) if self.gone else self.table
        return table.insert_batch(*(list(x) for x in zip(*self.rows, strict=True))) if self.rows else table


def commit_hash(manifest: dict) -> str:
    """UUID of a manifest's content, its parents and digests included; its own id and times left out."""
    own = {k: v for k, v in manifest.items() if k not in ("id", "created", "updated")}
    return str(uuid.UUID(bytes=hashlib.sha512(canonical(own).encode()).digest()[:16], version=5))
