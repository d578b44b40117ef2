"""Queries of the table's operations: reading, changing, searching, versions, maintenance, facades; with their SQL."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import maintenance
from vecspark.ann import ivf
from vecspark.facades import DocumentStore, Repository
from vecspark.functions import params
from vecspark.operators import benchmarks, search
from vecspark.plans import catalog as C
from vecspark.plans.catalog import query
from vecspark.sources.readers import read_vectors
from vecspark.sources.store import Conflict, scratch
from vecspark.table import VectorTable


def facts(*names: str) -> str:
    """SQL of what a query of facts gives: all of them hold."""
    return "SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS fact, true AS holds"


def shown(spark: SparkSession, **holds: bool) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in holds.items()], "fact string, holds boolean")


def raises(kind: type[BaseException], f) -> bool:
    try:
        f()
    except kind:
        return True
    return False


def first(spark: SparkSession, d: str) -> list[float]:
    return C._first(C.embeddings(spark, d))


def one_sql(where: str = "TRUE", k: int = 10, more: str = "") -> str:
    return f"""WITH b AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1), pairs AS (SELECT a.vec_id AS id, {C._l2("a.embedding", "b.embedding")} AS distance, a.label FROM embeddings a, b WHERE {where})
SELECT id, {C.R6} AS distance{more} FROM pairs ORDER BY pairs.distance, id LIMIT {k}"""


def found(spark: SparkSession, rows: list[dict], label: bool = False) -> DataFrame:
    own = [(r["id"], abs(round(r["distance"], 6)), *([r["metadata"]["label"]] if label else [])) for r in rows]
    return spark.createDataFrame(own, "id long, distance double" + ", label int" * label)


# 2.1


@query("SELECT p_partkey, CAST((2147483647 - 64) // (p_size * 4) AS BIGINT) AS most FROM part")
def max_capacity(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", params.max_capacity_column(F.col("p_size")).alias("most"))


@query("""WITH m AS (SELECT c_custkey, md5(c_name) AS h, c_name FROM customer), t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE h END AS h FROM m)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM t""")
def uuid_coercion(spark, d):
    h = F.md5("c_name")
    hyphens = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(F.col("c_custkey") % 3 == 0, F.upper(h)).when(F.col("c_custkey") % 3 == 1, hyphens).otherwise(F.col("c_name"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", params.uuid_column(text).alias("id"))


# 2.2 reading


@query(C._shown_sql("label < 5"))
def table_load(spark, d):
    table = C._table(spark, d, "label < 5")
    return C._shown(VectorTable.load(spark, table.store.root))


@query(C._shown_sql("label < 5"))
def table_restore(spark, d):
    table = C._table(spark, d, "label < 5")
    store, config = VectorTable._open(table.store.root)
    return C._shown(VectorTable(spark, store, config, store.commit(store.head("main")), "main"))


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS position, vec_id FROM embeddings WHERE label = 3")
def table_iterate(spark, d):
    return spark.createDataFrame([(n, key) for n, (key, _) in enumerate(C._table(spark, d, "label = 3"))], "position long, vec_id long")


@query("""SELECT k.id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, label, vec_id IS NOT NULL AS present
FROM (SELECT unnest([CAST(0 AS BIGINT), 3, 17, 99999999]) AS id) k LEFT JOIN (SELECT * FROM embeddings WHERE label <> 7) e ON k.id = e.vec_id""")
def table_get(spark, d):
    t = C._table(spark, d, "TRUE").delete_batch(C._dropped(C.embeddings(spark, d), "label = 7"))
    rows = []
    for key in (0, 3, 17, 99999999):
        v, m = t.get_vector(key), t.get_metadata(key)
        rows.append((key, None if v is None else round(float(np.sum(np.array(v, np.float64))), 6), None if m is None else m["label"], key in t))
    return spark.createDataFrame(rows, "id long, total double, label int, present boolean")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS least, count(*) - 1 AS greatest, count(*) AS different FROM embeddings")
def table_internal_ids(spark, d):
    t = C._table(spark, d, "label < 4").insert_batch(C._new(spark, d, "label >= 4")).sync("two")
    own = t.vectors(node_ids=True)
    return own.agg(F.count("*").alias("n"), F.min("node_id").alias("least"), F.max("node_id").alias("greatest"), F.countDistinct("node_id").alias("different"))


@query(facts("lookup_found", "lookup_absent", "contains", "contains_not", "entry"))
def table_lookups(spark, d):
    t = C._table(spark, d, "label < 5")
    key = t.seq().first()["id"]
    n = t.lookup_internal_id(int(key))
    return shown(spark, lookup_found=n is not None and 0 <= n < t.count(), lookup_absent=t.lookup_internal_id("absent") is None, contains=t.contains(int(key)), contains_not=not t.contains(-1), entry=len(t.get_vector(int(key))) == 64)


@query(facts("flushed_rows", "no_commit_yet", "fork_is_apart", "closed", "synced"))
def table_flush_fork_close(spark, d):
    t = C._table(spark, d, "label < 5")
    n = t.count()
    more = t.insert_batch(C._new(spark, d, "label = 5"))
    flushed = more.flush()
    fork = t.fork().delete(t.seq().select("id").first()[0])
    return shown(spark, flushed_rows=flushed.count() == more.count() > n, no_commit_yet=flushed.get_commit_id() is None and flushed.is_dirty(), fork_is_apart=t.count() == n and fork is not t, closed=t.close() is None, synced=flushed.sync("x").count() == more.count())


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE label = 3")
def read_fvecs(spark, d):
    rows = C.embeddings(spark, d).where("label = 3").orderBy("vec_id").select("embedding").collect()
    folder = scratch(spark, "fvecs").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/x.fvecs", "wb") as f:
        for r in rows:
            f.write(np.int32(len(r[0])).tobytes() + np.array(r[0], "<f4").tobytes())
    return read_vectors(spark, [f"{folder}/x.fvecs"], "row").select("row", C.r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


# 2.3 filters


@query(one_sql("a.label % 2 = 1 AND a.vec_id % 3 = 0"))
def filter_predicate(spark, d):
    return found(spark, C._table(spark, d, "TRUE").search(first(spark, d), 10, where=lambda key, meta: meta["label"] % 2 == 1 and key % 3 == 0))


@query("SELECT 1 AS search, x.* FROM (" + one_sql("a.vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id < 40)", 5) + ") x UNION ALL SELECT 2, y.* FROM (" + one_sql("a.vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id < 40)", 5) + ") y")
def filter_id_set_reused(spark, d):
    t = C._table(spark, d, "TRUE")
    ids = t.make_id_filter([*range(40), "unknown"])
    rows = [(n, r["id"], abs(round(r["distance"], 6))) for n in (1, 2) for r in t.search_filtered(first(spark, d), 5, ids)]
    ids.unpersist()
    return spark.createDataFrame(rows, "search int, id long, distance double")


@query(facts("number", "unknown_option", "bad_text", "unknown_metric", "unknown_strategy", "zero_k"))
def filter_refusals(spark, d):
    t, q = C._table(spark, d, "label = 1"), first(spark, d)
    own = C.embeddings(spark, d)
    return shown(
        spark, number=raises(TypeError, lambda: t.search(q, 1, where=7)), unknown_option=raises(TypeError, lambda: t.search(q, 1, width=3)), bad_text=raises(ValueError, lambda: t.search(q, 1, where="label ==")),
        unknown_metric=raises(ValueError, lambda: search.search_batch(own, C.as_queries(own), 3, "manhattan")), unknown_strategy=raises(ValueError, lambda: search.search_batch(own, C.as_queries(own), 3, strategy="x")), zero_k=raises(ValueError, lambda: search.search(own, q, 0)),
    )


@query(one_sql("a.label >= 5 AND a.label <> 7", more=", label"))
def filter_text_in_search(spark, d):
    return found(spark, C._table(spark, d, "TRUE").search(first(spark, d), 10, where="label >= 5 && label NIN [7, 70]", with_metadata=True), True)


# 2.4 searches of tables


@query(one_sql())
def table_search(spark, d):
    return found(spark, C._table(spark, d, "TRUE").search(first(spark, d), 10))


@query(one_sql(more=", label"))
def table_search_with_metadata(spark, d):
    return found(spark, C._table(spark, d, "TRUE").search_with_metadata(first(spark, d), 10), True)


@query(one_sql("a.label = 2"))
def table_search_filtered(spark, d):
    return found(spark, C._table(spark, d, "TRUE").search_filtered(first(spark, d), 10, F.get_json_object("metadata", "$.label") == "2"))


@query(facts("nearest", "nearest_filtered"))
def table_nearest(spark, d):
    t, q = C._table(spark, d, "TRUE"), first(spark, d)
    return shown(spark, nearest=t.nearest(q, 7) == t.search(q, 7), nearest_filtered=t.nearest_filtered(q, 7, "label == 2") == t.search_filtered(q, 7, "label == 2"))


@query(C._plain_sql("a.label <> 7", name="'long:' || a.vec_id"))
def table_search_batch(spark, d):
    own = C.embeddings(spark, d)
    t = C._table(spark, d, "TRUE").delete_batch(C._dropped(own, "label = 7"))
    return C.rounded(t.search_batch(C.as_queries(own), 10), "distance")


def _indexed(spark, d, kind: str, **options) -> DataFrame:
    own = C.embeddings(spark, d)
    t = C._table(spark, d, "label < 6", index_type=kind, m=8).insert_batch(C._new(spark, d, "label >= 6")).sync("second").delete_batch(C._dropped(own, "label = 7")).sync("third")
    return C.rounded(t.search_batch(C.as_queries(own), 10, "label != 2", **options), "distance")


@query(C._plain_sql("a.label NOT IN (2, 7)", name="'long:' || a.vec_id"))
def table_hnsw(spark, d):
    return _indexed(spark, d, "hnsw", ef=C._wide(spark, d))


@query(C._plain_sql("a.label NOT IN (2, 7)", name="'long:' || a.vec_id"))
def table_ivf(spark, d):
    return _indexed(spark, d, "ivf", probes=10**6)


@query(one_sql("a.label = 3", 5))
def search_overfetched(spark, d):
    own, q = C.embeddings(spark, d), first(spark, d)
    run = lambda k: search.search(own, q, k, metadata=["label"])
    return C.rounded(ivf.overfetched(run, F.col("label") == 3, 5, (3, 10, 30, 10**6)).select("id", "distance"), "distance")


@query("SELECT unnest([8, 64, 100000]) AS ef, unnest([false, false, true]) AS complete, (SELECT count(*) FROM embeddings) AS queries")
def ef_sweep(spark, d):
    own = C.embeddings(spark, d)
    edges, asked = C._graph(spark, d), C.as_queries(own)
    exact = search.search_batch(own, asked, 10)
    n = own.count()
    from vecspark.ann import graph

    rows = benchmarks.sweep(lambda ef: graph.probe(own, edges, asked, 10, min(ef, n)), exact, (8, 64, 100_000))
    assert rows[0]["mean_recall"] <= rows[1]["mean_recall"] + 0.01 and rows[1]["mean_recall"] > 0.9
    return spark.createDataFrame([(r["ef"], r["ef"] > 64 and r["mean_recall"] == 1.0, n) for r in rows], "ef int, complete boolean, queries long")


@query("""SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1""")
def benchmark_summary(spark, d):
    return C.rounded(benchmarks.summary(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value"), "mean", "stdev", "least", "greatest", "p50", "p95", "p99", "p999")


# 2.5 changes


@query(C._shown_sql("label < 3") + " UNION ALL SELECT unnest([-1, -2, -3]), unnest(['{}', '{\"a\":1}', '{}']), unnest([64.0, 128.0, 192.0])")
def table_assoc_conj_into(spark, d):
    t = C._table(spark, d, "label < 3").assoc(-1, [1.0] * 64).conj((-2, {"vector": [2.0] * 64, "metadata": {"a": 1}})).into([(-3, [3.0] * 64)])
    return C._shown(t)


@query(facts("absent_is_added", "present_raises", "insert_raises_too"))
def table_assoc_ex(spark, d):
    t = C._table(spark, d, "label < 3")
    key = int(t.seq().first()["id"])
    return shown(spark, absent_is_added=t.assoc_ex(-1, [1.0] * 64).contains(-1), present_raises=raises(ValueError, lambda: t.assoc_ex(key, [1.0] * 64)), insert_raises_too=raises(ValueError, lambda: t.insert([1.0] * 64, key)))


@query(C._shown_sql("label < 3 AND vec_id <> (SELECT min(vec_id) FROM embeddings WHERE label < 3)") + " UNION ALL SELECT min(vec_id), '{\"n\":1}', 64.0 FROM embeddings WHERE label < 3")
def table_transient(spark, d):
    t = C._table(spark, d, "label < 3")
    key = int(t.seq().first()["id"])
    return C._shown(t.transient().insert([1.0] * 64, key, {"n": 1}).delete(key).persistent())


@query(C._shown_sql("label < 3 AND vec_id <> (SELECT min(vec_id) FROM embeddings WHERE label < 3)"))
def table_dissoc(spark, d):
    t = C._table(spark, d, "label < 3")
    return C._shown(t.dissoc(int(t.seq().first()["id"])).dissoc(-5))


@query(C._shown_sql("label NOT IN (3, 8, 9)"))
def table_delete_where(spark, d):
    return C._shown(C._table(spark, d, "TRUE").delete_where("label == 3 || label > 7"))


@query("SELECT CAST(0 AS BIGINT) AS live, count(*) AS total FROM embeddings")
def table_delete_all(spark, d):
    t = C._table(spark, d, "TRUE").delete_where(F.lit(True))
    return spark.createDataFrame([(t.count(), t.count_total())], "live long, total long")


# 2.6 introspection


@query("""SELECT count(*) - count_if(label = 7) AS count, count(*) AS total, count_if(label = 7) AS deleted, CAST(10000000 AS BIGINT) - count(*) AS remaining, round(count_if(label = 7) / count(*), 6) AS ratio,
count_if(label = 7) / count(*) > 0.1 AS compact FROM embeddings""")
def table_counts(spark, d):
    t = C._table(spark, d, "TRUE").delete_batch(C._dropped(C.embeddings(spark, d), "label = 7")).sync("x")
    return spark.createDataFrame([(len(t), t.count_total(), t.count_deleted(), t.remaining_capacity(), round(t.metrics()["deletion_ratio"], 6), t.needs_compaction())], "count long, total long, deleted long, remaining long, ratio double, compact boolean")


@query("SELECT unnest(['dim', 'distance', 'index_type', 'm', 'ef_construction', 'ef_search', 'crypto_hash', 'seed']) AS key, unnest(['64', 'cosine', 'hnsw', '8', '200', '50', 'True', '7']) AS value")
def table_config(spark, d):
    t = VectorTable.create(spark, scratch(spark, "table"), 64, distance="cosine", index_type="hnsw", m=8, crypto_hash=True, seed=7, ef_construction=200, ef_search=50)
    own = VectorTable._open(t.store.root)[1]
    config = VectorTable(spark, t.store, own, None, "main").index_config()
    assert t.index_type() == "hnsw"
    return spark.createDataFrame([(k, str(config[k])) for k in ("dim", "distance", "index_type", "m", "ef_construction", "ef_search", "crypto_hash", "seed")], "key string, value string")


@query(facts("has_files", "all_listed", "bytes_at_least_vectors"))
def table_storage(spark, d):
    t = C._table(spark, d, "TRUE")
    s = maintenance.storage_stats(t)
    return shown(spark, has_files=s["files"] > 0, all_listed=s["files"] == s["snapshot_files"], bytes_at_least_vectors=s["snapshot_bytes"] >= t.count() * 64)


# 2.7 versions


@query(facts("two_branches", "names_its_branch", "commit_id_when_clean", "none_when_dirty", "deleted", "main_stays"))
def table_branches(spark, d):
    t = C._table(spark, d, "label < 2")
    b = t.make_branch("feature")
    dirty = b.delete(-1)
    two, named = t.branches() == ["feature", "main"], (t.get_branch(), b.get_branch()) == ("main", "feature")
    t.delete_branch("feature")
    return shown(spark, two_branches=two, names_its_branch=named, commit_id_when_clean=bool(t.get_commit_id()), none_when_dirty=dirty.get_commit_id() is None, deleted=t.branches() == ["main"], main_stays=raises(ValueError, lambda: t.delete_branch("main")))


def _dag(spark, d) -> dict[str, VectorTable]:
    one = C._table(spark, d, "label < 2")
    two = one.insert_batch(C._new(spark, d, "label = 2")).sync("two")
    side = one.make_branch("side").insert_batch(C._new(spark, d, "label = 3")).sync("side")
    return {"one": one, "two": two, "side": side, "both": two.merge(side, "all")}


@query("SELECT unnest(['one', 'two', 'side', 'both']) AS name, unnest([0, 1, 1, 2]) AS parents, unnest([1, 2, 3, 5]) AS ancestors, unnest([true, true, true, true]) AS from_one, unnest([true, false, true, true]) AS into_both")
def table_ancestors(spark, d):
    t = _dag(spark, d)
    commit = {k: x.get_commit_id() for k, x in t.items()}
    rows = [(k, len(x.parents()), len(x.ancestors()), x.is_ancestor(commit["one"], commit[k]), x.is_ancestor(commit[k], commit["both"]) and k != "two") for k, x in t.items()]
    return spark.createDataFrame(rows, "name string, parents int, ancestors int, from_one boolean, into_both boolean")


@query(facts("base_of_both", "base_of_itself", "nodes", "heads", "one_root", "merge_has_two_parents"))
def table_commit_graph(spark, d):
    t = _dag(spark, d)
    a, b = t["two"].get_commit_id(), t["side"].get_commit_id()
    g = t["both"].commit_graph()
    return shown(
        spark, base_of_both=t["both"].common_ancestor(a, b) == t["one"].get_commit_id(), base_of_itself=t["both"].common_ancestor(a, a) == a, nodes=len(g["nodes"]) == 5,
        heads=g["branches"] == {"main": t["both"].get_commit_id(), "side": b}, one_root=g["roots"] == [t["one"].get_commit_id()], merge_has_two_parents=len(g["nodes"][t["both"].get_commit_id()]["parents"]) == 2,
    )


@query(C._shown_sql("label < 5"))
def table_reset(spark, d):
    t = C._table(spark, d, "label < 5")
    later = t.insert_batch(C._new(spark, d, "label >= 5")).sync("later")
    later.reset(uuid.UUID(t.get_commit_id()))
    return C._shown(VectorTable.load(spark, t.store.root))


@query(facts("old_write_refused", "head_stays", "unknown_commit", "missing_branch", "dirty_branch_refused"))
def table_guards(spark, d):
    t = C._table(spark, d, "label < 2")
    later = t.insert_batch(C._new(spark, d, "label = 2")).sync("later")
    stale = VectorTable.load_commit(spark, t.store.root, t.get_commit_id())
    return shown(
        spark, old_write_refused=raises(Conflict, lambda: stale.delete(-1).sync()), head_stays=VectorTable.load(spark, t.store.root).get_commit_id() == later.get_commit_id(),
        unknown_commit=raises(KeyError, lambda: later.reset(uuid.uuid4())), missing_branch=raises(KeyError, lambda: VectorTable.load(spark, t.store.root, "none")), dirty_branch_refused=raises(ValueError, lambda: later.delete(-1).make_branch("x")),
    )


@query(facts("copied", "delta", "aborted", "target_gone", "too_many"))
def table_online_compaction_control(spark, d):
    t = C._table(spark, d, "label < 3")
    target = scratch(spark, "compacted")
    run = maintenance.OnlineCompaction(t, target).run()
    now = t.insert([1.0] * 64, -1)
    copied, delta = not run.progress()["copying"], run.progress(now)["delta_count"] == 1
    small = maintenance.OnlineCompaction(t, scratch(spark, "compacted"), 0).run()
    overflow = raises(OverflowError, lambda: small.finish(now))
    return shown(spark, copied=copied, delta=delta, aborted=run.abort() is t, target_gone=raises(FileNotFoundError, lambda: VectorTable.load(spark, target)), too_many=overflow)


@query(facts("root_holds", "equal_by_content", "unlike_after_change", "plain_has_none", "hash_is_commit"))
def table_merkle_and_equality(spark, d):
    t = C._table(spark, d, "label < 2", crypto_hash=True)
    again = VectorTable.load(spark, t.store.root)
    plain = VectorTable.create(spark, scratch(spark, "table"), 64)
    return shown(
        spark, root_holds=maintenance.recompute_merkle_root(t) == {"status": "ok", "root": t.merkle_root()}, equal_by_content=t == again, unlike_after_change=t.delete(int(t.seq().first()["id"])).sync("x") != again,
        plain_has_none=plain.get_commit_hash() is None and not plain.crypto_hash(), hash_is_commit=t.get_commit_hash() == t.get_commit_id(),
    )


@query(facts("snapshot", "branch_and_merge", "history", "ancestors", "no_conflicts", "diff", "system"))
def repository_facade(spark, d):
    t = C._table(spark, d, "label < 2")
    r = Repository(t)
    side = r.branch("side")
    changed = Repository(side.table.insert_batch(C._new(spark, d, "label = 2")).sync("more"))
    merged = r.merge("side")
    n = C.embeddings(spark, d).where("label = 2").count()
    return shown(
        spark, snapshot=r.as_of(r.snapshot_id()).count() == t.count() and r.snapshot_meta()["message"] == "first", branch_and_merge=merged.table.count() == t.count() + n, history=[c["message"] for c in changed.history()][0] == "more",
        ancestors=len(changed.ancestors()) == 2, no_conflicts=r.conflicts("side") == [], diff=r.diff(t.get_commit_id(), changed.snapshot_id()).where("change = 'added'").count() == n, system=bool(r.system_id()),
    )


# 2.9 document store


def _embed(texts):
    return [[float(len(t)), float(t.count("a")), float(t.count("e")), 1.0] for t in texts]


@query(facts("added", "replaced", "similar", "threshold", "filtered", "deleted", "none_deleted", "cleared", "saved"))
def document_store(spark, d):
    root = scratch(spark, "documents")
    s = DocumentStore.open(spark, root, _embed, 4).add(["an apple", "a pear tree", "everyone else"], [1, 2, 3], [{"g": "x"}, {"g": "y"}, {"g": "x"}])
    changed = s.add(["another apple"], [1])
    best = s.similar("an apple", 1)[0]
    fewer, was = s.delete([2, 77])
    saved = s.save("first")
    return shown(
        spark, added=s.table.count() == 3, replaced=changed.table.count() == 3 and changed.similar("another apple", 1)[0]["text"] == "another apple", similar=(best["id"], best["text"], best["score"]) == (1, "an apple", 1.0), threshold=len(s.similar("an apple", 3, 0.99)) == 1,
        filtered=[r["id"] for r in s.similar("an apple", 3, where="g == 'y'")] == [2], deleted=fewer.table.count() == 2 and was, none_deleted=not s.delete([99])[1], cleared=s.clear().table.count() == 0, saved=DocumentStore.open(spark, root, _embed, 4).table.get_commit_id() == saved.table.get_commit_id(),
    )


