"""Searches whose memory and shuffle must not grow with the pairs."""

from __future__ import annotations

import numpy as np
import pytest

from vecspark.functions import distance as D
from vecspark.operators import search


def made(spark, n: int = 300, dim: int = 6, seed: int = 1, whole: bool = True):
    """Vectors of whole numbers, so many distances tie."""
    x = np.random.default_rng(seed).integers(-2, 3, (n, dim)).astype(float) if whole else np.random.default_rng(seed).standard_normal((n, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return x, df, df.selectExpr("vec_id AS query_id", "embedding AS query")


def brute(x: np.ndarray, k: int, metric: str = "euclidean", skip: bool = False) -> set:
    y = D.unit_rows(x) if metric == "cosine" else x
    out = set()
    for q in range(len(x)):
        d = D.pairs(metric, np.repeat(y[q : q + 1], len(y), axis=0), y)
        near = [i for i in np.lexsort((np.arange(len(y)), d)) if not (skip and i == q)][:k]
        out |= {(q, int(i), r + 1) for r, i in enumerate(near)}
    return out


def rows(df) -> set:
    return {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "inner_product"])
def test_blocks_with_ties_by_small_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "PAIRED", 64)
    x, own, asked = made(spark)
    for skip in (False, True):
        assert rows(search.search_batch(own, asked, 5, metric, strategy="blocks", exclude_self=skip)) == brute(x, 5, metric, skip)
    best = search._Best(x, 5, metric)
    for lo in range(0, 300, 7):
        best.add(x[lo : lo + 7], search.pa.array(np.arange(lo, min(300, lo + 7))))
    assert {(int(q), i, n % 5 + 1) for row, ids, _, _ in best.parts() for n, (q, i) in enumerate(zip(row, ids.to_pylist(), strict=True))} == brute(x, 5, metric)


def test_blocks_shuffle_queries_only(spark):
    _, own, asked = made(spark)
    for df in (search.search_batch(own, asked, 5, strategy="blocks"), search.range_search(own, asked, 3.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cogroup" not in plan and "CoGroup" not in plan and "Generate" not in plan and plan.count("Exchange") <= 1


def test_many_equal_vectors_within_range(spark, monkeypatch):
    """Hits are compared by bounded batches, however many there are."""
    own = spark.range(400).selectExpr("id AS vec_id", "array(1.0D, 2.0D) AS embedding")
    asked = own.selectExpr("vec_id AS query_id", "embedding AS query")
    monkeypatch.setattr(search, "PAIRED", 100)
    most, plain = [], D.pairs
    monkeypatch.setattr(D, "pairs", lambda m, a, b: most.append(len(a)) or plain(m, a, b))
    x = np.ones((400, 2))
    assert sum(len(r) for r, _, _ in search._within("euclidean", x, x, 0.0)) == 160_000 and max(most) <= 50
    assert sum(len(r) for r, _, _ in search._nearest("euclidean", x, x, np.arange(400), 3)) == 1200 and max(most) <= 50
    assert search.range_search(own, asked, 0.0).count() == 160_000


def test_full_width_is_exact_even_without_links(spark):
    """A beam as wide as the shard compares all of it, so nothing hangs on what the links reach."""
    from vecspark.ann import graph

    x, own, asked = made(spark, whole=False)
    none = graph.build(own, 4, 20, 2).where("false")
    where = own.where("vec_id % 3 <> 0").select("vec_id")
    limits = {"budget": 10**9, "patience": 10**9, "timeout_ms": 10**9}
    assert rows(graph.probe(own, none, asked, 5, 300, 2, **limits)) == brute(x, 5)
    kept = np.flatnonzero(np.arange(300) % 3)
    assert rows(graph.probe(own, none, asked, 5, 300, 2, where=where)) == rows(search.search_batch(own, asked, 5, where=where)) and len(kept) == 200
    shard = graph.Shard(x, graph.shard_links(x, np.arange(300), 4, 20, 42, "euclidean"), "euclidean")
    shard._beam = None  # never walked
    row, node, _ = shard.search(x, 5, 10**6)
    assert {(int(r), int(n), i % 5 + 1) for i, (r, n) in enumerate(zip(row, node, strict=True))} == brute(x, 5)
    assert len(graph.Shard(x, graph.shard_links(x, np.arange(300), 4, 20, 42, "euclidean"), "euclidean").search(x, 5, 10**6, budget=20)[0]) <= 1500


def test_limits_that_never_end_a_walk():
    from vecspark.ann import graph

    assert graph.exhaustive(100, 10, 100) and graph.exhaustive(100, 10, 200, 100, 100, 10**9) and graph.exhaustive(0, 10, 1)
    assert not graph.exhaustive(100, 10, 99) and not graph.exhaustive(100, 10, 100, 99) and not graph.exhaustive(100, 10, 100, 0, 7) and not graph.exhaustive(100, 10, 100, 0, 0, 50)


@pytest.mark.parametrize("kind, wide, part", [("hnsw", {"ef": 300}, {"ef": 100}), ("ivf", {"probes": 10**6}, {"probes": 2})])
def test_tables_searched_in_full_are_searched_exactly(spark, tmp_path, kind, wide, part):
    from vecspark.table import VectorTable

    x, own, asked = made(spark, whole=False)
    t = VectorTable.create(spark, str(tmp_path / "t"), 6, index_type=kind, m=4).insert_batch(own.selectExpr("vec_id AS id", "embedding")).sync("one")
    assert t._approximate(asked, 5, None, wide) is None and t._approximate(asked, 5, None, part) is not None
    assert {(q, int(i.split(":")[1]), r) for q, i, r in rows(t.search_batch(asked, 5, **wide))} == {(q, i, r) for q, i, r in brute(x.astype(np.float32).astype(float), 5)}


def test_edges_are_searched_once(spark, tmp_path):
    from vecspark.operators import metrics

    x, own, asked = made(spark, whole=False)
    edges = search.search_batch(own, asked, 5, exclude_self=True).selectExpr("0 AS layer", "query_id AS src", "id AS dst").coalesce(1)
    at = str(tmp_path)

    def counted(batches):
        import uuid

        open(f"{at}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    found = {r["check"]: r["violations"] for r in metrics.invariants(edges.mapInArrow(counted, edges.schema), own, 5, 5, 0, vector_col="embedding", gone=own.where("vec_id = 3").select("vec_id")).collect()}
    assert len(list(tmp_path.iterdir())) == 1
    assert found["self_loops"] == found["neighbour_counts"] == found["neighbour_bounds"] == found["navigability"] == 0
    assert found["deleted_neighbours"] == sum(i == 3 for _, i, _ in brute(x, 5, skip=True))


def test_walks_end_where_no_neighbour_is_nearer(spark):
    from vecspark.operators import metrics

    own = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    line = spark.createDataFrame([(0, i, j) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30 and i != 20], "layer int, src long, dst long")
    asked = own.where("vec_id in (0, 1, 4, 18, 25)").selectExpr("vec_id AS target", "embedding AS v")
    ends = {(r["target"], r["node"], r["hops"], r["finished"]) for r in metrics.navigability(own, line, asked, 0, 30).collect()}
    assert ends == {(0, 0, 0, True), (1, 1, 1, True), (4, 4, 4, True), (18, 18, 18, True), (25, 20, 20, True)}
    assert {(r["target"], r["node"], r["finished"]) for r in metrics.navigability(own, line, asked, 0, 3).collect()} == {(0, 0, True), (1, 1, True), (4, 3, False), (18, 3, False), (25, 3, False)}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_expressions_over_many_pairs(spark, monkeypatch, metric):
    """Beyond the bound, pairs are narrowed down first; expressions still give the distances, and the ties."""
    x, own, asked = made(spark, whole=metric == "euclidean")
    plain = search.search_batch(own, asked, 5, metric, strategy="expr", exclude_self=True).collect()
    monkeypatch.setattr(search, "EXPR_PAIRS", 0)
    df = search.search_batch(own, asked, 5, metric, strategy="expr", exclude_self=True)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect()) == sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in plain)
