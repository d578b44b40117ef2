from __future__ import annotations

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import maintenance as M
from vecspark.sources.readers import read_vectors
from vecspark.sources.store import Conflict, Store
from vecspark.streaming.ingest import ingest
from vecspark.table import VectorTable


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def ids(table) -> list:
    return [k for k, _ in table]


def ramp(n: int) -> list[list[float]]:
    return [[float(i), i + 1.0, i + 2.0, i + 3.0] for i in range(n)]


def test_ids_keep_their_type(spark, root):
    key = uuid.uuid4()
    t = VectorTable.create(spark, root, 4).into([(1, [1, 0, 0, 0]), ("1", [2, 0, 0, 0]), (key, {"vector": [3, 0, 0, 0], "metadata": {"a": 1}})])
    assert set(ids(t)) == {1, "1", key}
    assert t.get_vector(1) == [1, 0, 0, 0] and t.get_vector("1") == [2, 0, 0, 0] and t.get_metadata(key) == {"a": 1, "external-id": key}
    assert t.get_vector("absent") is None and t.get_metadata("absent") is None and t.lookup_internal_id("absent") is None and "absent" not in t
    assert sorted(t.lookup_internal_id(k) for k in (1, "1", key)) == [0, 1, 2]
    t = t.insert([9, 9, 9, 9], "  ")
    assert t.count() == 4 and sum(isinstance(k, uuid.UUID) for k in ids(t)) == 2
    with pytest.raises(TypeError):
        t.insert([0, 0, 0, 0], 1.5)


def test_refusals(spark, root):
    t = VectorTable.create(spark, root, 4, capacity=3).insert_batch(ramp(2), ["a", "b"])
    for bad in (lambda: t.insert([1, 2, 3], "c"), lambda: t.insert([1, 2, 3, 4], "a"), lambda: t.insert_batch(ramp(2), ["x", "x"]), lambda: t.insert_batch(ramp(2), ["x", "y"]), lambda: t.insert_batch(ramp(2), ["x"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        t.insert_batch(spark.createDataFrame([("q", [1.0])], "id string, embedding array<float>"))
    with pytest.raises(KeyError):
        t.with_metadata("zz", {})
    with pytest.raises(Conflict):
        VectorTable.create(spark, root, 4)
    for options in ({"distance": "inner product"}, {"index_type": "tree"}, {"seed": "x"}):
        with pytest.raises(ValueError):
            VectorTable.create(spark, root + "2", 4, **options)
    assert t.count() == 2 and t.remaining_capacity() == 1 and t.delete("a").remaining_capacity() == 1


def test_values_never_change(spark, root):
    t = VectorTable.create(spark, root, 4).insert_batch(ramp(3), [0, 1, 2])
    u = t.delete(1).delete(77).with_metadata(2, {"x": 1}).with_metadata(2, None)
    v = u.insert([9, 9, 9, 9], 1)
    assert (ids(t), ids(u), ids(v)) == ([0, 1, 2], [0, 2], [0, 1, 2])
    assert u.get_metadata(2) == {"x": 1, "external-id": 2} and t.get_metadata(2) == {"external-id": 2}
    assert v.get_vector(1) == [9, 9, 9, 9] and v.upsert([[8, 8, 8, 8]], [1]).get_vector(1) == [8, 8, 8, 8]
    w = t.transient().insert([5, 5, 5, 5], 1).delete(1).delete(2)
    assert w.count() == 2 and w.persistent().get_vector(1) == [5, 5, 5, 5]


def test_time_travel_branches_merge(spark, root):
    t = VectorTable.create(spark, root, 4)
    with pytest.raises(ValueError):
        t.make_branch("early")
    c1 = t.insert_batch(ramp(10), list(range(10))).sync("one")
    c2 = c1.insert_batch(ramp(5), list(range(10, 15))).sync("two")
    assert VectorTable.load_commit(spark, root, c1.get_commit_id()).count() == 10 and VectorTable.load(spark, root).count() == 15
    with pytest.raises(Conflict):
        c1.insert(ramp(1)[0], "late").sync()
    assert c1.insert(ramp(1)[0], "late").get_commit_id() is None
    with pytest.raises(ValueError):
        c2.insert(ramp(1)[0], "x").make_branch("dirty")
    f = c1.make_branch("feature").insert(ramp(1)[0], "f").insert(ramp(1)[0], 12).sync()
    assert sorted(t.branches()) == ["feature", "main"] and f.get_branch() == "feature"
    assert c2.common_ancestor(c2.get_commit_id(), f.get_commit_id()) == c1.get_commit_id()
    with pytest.raises(ValueError):
        c2.merge("feature")
    m = c2.merge("feature", "all")
    assert m.count() == 16 and m.get_vector(12) == ramp(3)[2] and m.parents() == [c2.get_commit_id(), f.get_commit_id()]
    assert [h["message"] for h in m.history()][-2:] == ["two", "one"] and m.is_ancestor(f.get_commit_id(), m.get_commit_id())
    assert m.ancestors()[0] == m.get_commit_id() and m.get_commit_id() not in m.ancestors(include_self=False)
    assert {tuple(r) for r in c2.diff(m).collect()} == {("f", "string", "added")}
    assert m.commit_graph()["roots"] == [c1.get_commit_id()] and m.commit_info(uuid.uuid4()) is None
    r = m.reset(c1.get_commit_id())
    assert r.count() == 10 and VectorTable.load(spark, root).count() == 10
    with pytest.raises(KeyError):
        m.reset(uuid.uuid4())
    for name, error in (("main", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            m.delete_branch(name)
    m.delete_branch("feature")
    assert m.branches() == ["main"]
    with pytest.raises(KeyError):
        VectorTable.load(spark, root, "feature")


def test_search(spark, root):
    t = VectorTable.create(spark, root, 4).insert_batch(ramp(20), list(range(20)), [{"category": "a" if i < 10 else "b"} for i in range(20)]).sync()
    q = ramp(13)[12]
    assert [r["id"] for r in t.search(q, 3)] == [12, 11, 13]
    assert [r["id"] for r in t.search_filtered(q, 5, "category == 'a'")] == [9, 8, 7, 6, 5]
    assert [r["id"] for r in t.search_filtered(q, 5, [0, 2, 4, "4", 99])] == [4, 2, 0]
    assert t.search_filtered(q, 5, []) == [] and len(t.search(q, 40)) == 20
    assert t.search_with_metadata(q, 1) == [{"id": 12, "distance": 0.0, "metadata": {"category": "b", "external-id": 12}}]
    assert [r["id"] for r in t.search(q, 3, t.make_id_filter([1, 2]))] == [2, 1]
    with pytest.raises(ValueError):
        t.search([1.0], 1)
    assert [r["id"] for r in t.search(q, 2, where=lambda key, meta: key < 5 and meta["category"] == "a")] == [4, 3]
    for bad in ({"where": 7}, {"width": 3}):
        with pytest.raises(TypeError):
            t.search(q, 1, **bad)
    assert t.delete_where("category == 'b'").count() == 10
    asked = spark.createDataFrame([(1, q)], "query_id long, query array<double>")
    assert [r["id"] for r in t.search_batch(asked, 2).orderBy("rank").collect()] == ["long:12", "long:11"]
    assert VectorTable.create(spark, root + "e", 4).search(q, 3) == []


def test_metrics_and_compaction(spark, root):
    t = VectorTable.create(spark, root, 4).insert_batch(ramp(10), list("abcdefghij")).delete_batch(list("ceg")).sync()
    m = t.metrics()
    assert (m["vector_count"], m["deleted_count"], m["live_count"], m["deletion_ratio"], m["needs_compaction"]) == (10, 3, 7, 0.3, True)
    assert t.needs_compaction() and not t.needs_compaction(0.5)
    c = M.compacted(t, root + "-c")
    assert c.metrics()["deleted_count"] == 0 and ids(c) == ids(t) and sorted(c.lookup_internal_id(k) for k in ids(c)) == list(range(7)) and c.capacity() == t.capacity()


def test_online_compaction(spark, root):
    t = VectorTable.create(spark, root, 4).insert_batch(ramp(10), list(range(10))).sync()
    run = M.OnlineCompaction(t, root + "-o").run()
    now = t.insert_batch(ramp(2), [10, 11]).delete(3).with_metadata(4, {"k": 1}).sync()
    assert run.progress(now)["delta_count"] == 4 and not run.progress(now)["finished"]
    done = run.finish(now)
    assert ids(done) == ids(now) and done.get_metadata(4) == {"k": 1, "external-id": 4} and run.progress()["finished"]
    with pytest.raises(ValueError):
        run.finish(now)
    small = M.OnlineCompaction(t, root + "-p", max_delta=3).run()
    with pytest.raises(OverflowError):
        small.finish(now)
    assert small.progress()["failed"] and not Store(root + "-p").exists("config.json")
    assert M.OnlineCompaction(t, root + "-q").run().abort() is t


def test_gc(spark, root):
    t = VectorTable.create(spark, root, 4).insert_batch(ramp(3), [0, 1, 2]).sync()
    time.sleep(0.05)
    since = time.time()
    u = t.insert_batch(ramp(2), [3, 4]).sync()
    assert M.gc(u, guard_seconds=-1) == []
    assert M.gc(u, keep_since=since, guard_seconds=3600) == []
    assert M.gc(u, keep_since=since, guard_seconds=-1) == [f"commits/{t.get_commit_id()}.json"]
    assert VectorTable.load(spark, root).count() == 5
    u.flush()
    lost = u.insert_batch(spark.createDataFrame([(9, [1.0] * 4)], "id long, embedding array<float>"))
    assert len(M.gc(u, guard_seconds=-1)) == 1 and lost.is_dirty() and u.count() == 5


def test_verification(spark, root, tmp_path):
    t = VectorTable.create(spark, root, 4, crypto_hash=True).insert_batch(ramp(3), [0, 1, 2])
    assert t.get_commit_hash() is None
    t = t.sync().delete(1).sync()
    assert t == VectorTable.load(spark, root) and t.get_commit_hash() == t.get_commit_id()
    assert M.verify_from_cold(t)["valid"] and M.verify_chain(t) == {"status": "ok", "commits": 2} and M.recompute_merkle_root(t)["status"] == "ok"
    assert M.verify_from_cold(t, "none")["error"] == "branch-not-found" and M.verify_from_cold(t.make_branch("b"), "b")["valid"]
    commit = t.store.commit(t.get_commit_id())
    t.store.write(commit | {"slots": 99}, "commits", f"{commit['id']}.json")
    assert M.verify_from_cold(t)["error"] == "commit-hash-mismatch" and M.verify_chain(t)["status"] == "mismatch"
    t.store.write(commit, "commits", f"{commit['id']}.json")
    path = next(p for p, _, _ in t.store.files("data") if "/vectors-" in p and p.endswith(".parquet"))
    folder, name = f"{t.store.base}/{path}".rsplit("/", 1)
    with open(f"{folder}/{name}", "ab") as f:
        f.write(b"x")
    assert M.verify_from_cold(t)["error"] == "files-unreadable"  # a sidecar's checksum says so
    os.remove(f"{folder}/.{name}.crc")
    assert M.verify_from_cold(t)["error"] == "vectors-invalid"
    plain = VectorTable.create(spark, root + "n", 4).insert(ramp(1)[0], 1).sync()
    assert M.verify_from_cold(plain)["valid"] and M.verify_chain(plain)["status"] == "advisory" and plain != VectorTable.load(spark, root + "n")


def test_readers(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    with open(tmp_path / "b.fvecs", "wb") as f:
        for row in x:
            f.write(np.int32(3).tobytes() + row.tobytes())
    with open(tmp_path / "c.bvecs", "wb") as f:
        f.write(np.int32(3).tobytes() + bytes([1, 2, 3]))
    got = read_vectors(spark, [str(tmp_path / n) for n in ("a.npy", "b.fvecs", "c.bvecs")]).collect()
    by = {n: [r["embedding"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["path"].endswith(n)] for n in ("a.npy", "b.fvecs", "c.bvecs")}
    assert by["a.npy"] == by["b.fvecs"] == x.tolist() and by["c.bvecs"] == [[1, 2, 3]]
    with pytest.raises(ValueError):
        read_vectors(spark, ["x.csv"])


def test_streaming_is_idempotent(spark, root, tmp_path):
    VectorTable.create(spark, root, 4).insert([0, 0, 0, 0], 0).sync()
    rows = spark.range(0, 6).select("id", F.array_repeat(F.col("id").cast("float"), 4).alias("embedding"))
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest(stream, root, str(tmp_path / f"ck{n}")).awaitTermination()
        t = VectorTable.load(spark, root)
        assert ids(t) == list(range(6)) and t.get_vector(0) == [0, 0, 0, 0]


@pytest.mark.parametrize("kind", ["hnsw", "ivf"])
def test_indexed_tables(spark, root, kind):
    """Segments by commit; deleted vectors, replaced ones and filters; the same rows as an exact search where all is visited."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16)).round(3)
    df = spark.createDataFrame([(i, v.tolist(), '{"g":%d}' % (i % 3)) for i, v in enumerate(x)], "id long, embedding array<double>, metadata string")
    t = VectorTable.create(spark, root, 16, index_type=kind, m=8).insert_batch(df.where("id < 2000")).sync("one").insert_batch(df.where("id >= 2000")).sync("two")
    assert len(t.base["index"]) == 2
    t = t.delete_batch(df.where("id % 5 = 0").select("id")).sync("three").upsert([x[7].tolist()], [10]).sync("four")
    asked = spark.createDataFrame([(i, (v + 0.01).tolist()) for i, v in enumerate(x[:60])], "query_id int, query array<double>")
    wide = {"ef": 400} if kind == "hnsw" else {"probes": 10**6}
    for where in (None, "g == 1", [3, 6, 9, 10, 11]):
        exact = {(r["query_id"], r["id"]) for r in t.search_batch(asked, 10, where, exact=True).collect()}
        found = {(r["query_id"], r["id"]) for r in t.search_batch(asked, 10, where, **wide).collect()}
        assert len(found & exact) >= 0.97 * len(exact) and len(found) == len(exact)
    assert [r["id"] for r in t.search(x[7].tolist(), 2, **wide)] in ([7, 10], [10, 7])
    best = t.search(x[11].tolist(), 1, "g == 2", with_metadata=True, **wide)
    assert best == [{"id": 11, "distance": best[0]["distance"], "metadata": {"g": 2, "external-id": 11}}]
    assert t.insert([0.0] * 16, 10**6).search([0.0] * 16, 1)[0]["id"] == 10**6  # not synced: exact
    assert len(VectorTable.load(spark, root).search(x[0].tolist(), 5, budget=500, patience=True, timeout_ms=60_000)) == 5
    M.gc(t, guard_seconds=-1)
    assert len(VectorTable.load(spark, root).search(x[0].tolist(), 5)) == 5


def test_graph_after_deletes(spark):
    from vecspark.ann import graph
    from vecspark.operators import metrics

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2500, 8)))], "vec_id long, embedding array<double>")
    edges = graph.build(df, 8, 60, 1).persist()
    live, gone = df.where("vec_id % 4 <> 1"), df.where("vec_id % 4 = 1").select("vec_id")
    asked = df.limit(100).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r["query_id"], r["id"]) for r in __import__("vecspark.operators.search", fromlist=["x"]).search_batch(live, asked, 10).collect()}
    fixed = graph.repaired(df, edges, gone, 8, 1).persist()
    assert metrics.dangling(fixed, live).count() == 0 and metrics.self_loops(fixed).count() == 0 and metrics.degree_violations(fixed, 16, 8).count() == 0
    for found in (graph.probe(df, edges, asked, 10, 120, 1, where=live.select("vec_id")), graph.probe(live, fixed, asked, 10, 120, 1)):
        assert len({(r["query_id"], r["id"]) for r in found.collect()} & exact) >= 0.97 * len(exact)
    bare = graph.probe(live, edges, asked, 10, 120, 1)  # links to what is gone are left out, never bent
    assert {r["id"] % 4 for r in bare.select("id").collect()} <= {0, 2, 3}
    assert len({(r["query_id"], r["id"]) for r in bare.collect()} & exact) >= 0.85 * len(exact)
