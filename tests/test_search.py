from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions import params
from vecspark.operators import search

ROWS = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0]), (4, [-1.0, 0.0]), (5, None), (6, [1.0, 2.0, 3.0])]
QUERIES = [(10, [0.0, 1.0]), (11, [3.0, 4.0]), (12, None), (13, [0.0, 0.0])]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(ROWS, "vec_id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query array<float>").cache()


def brute(metric: str, k: int) -> list:
    out = []
    for qid, q in QUERIES:
        if q is None:
            continue
        found = []
        for vid, v in ROWS:
            if v is None or len(v) != len(q):
                continue
            a, b = np.array(v), np.array(q)
            if metric == "cosine":
                a, b = (x / np.linalg.norm(x) if np.linalg.norm(x) ** 2 > 1e-12 else x for x in (a, b))
            found.append((round(float(((a - b) ** 2).sum() if metric == "euclidean" else 1 - a @ b), 9), vid))
        out += [(qid, vid, d, r + 1) for r, (d, vid) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["kernel", "expr", "blocks", "auto"])
@pytest.mark.parametrize("metric", ["euclidean", "cosine", "inner_product"])
def test_all_strategies_agree_with_brute_force(tiny, asked, metric, strategy):
    found = search.search_batch(tiny, asked, 3, metric, strategy=strategy).collect()
    assert sorted((r["query_id"], r["id"], round(r["distance"], 9) + 0.0, r["rank"]) for r in found) == brute(metric, 3)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "inner_product"])
def test_single_search(tiny, metric):
    found = search.search(tiny, [3.0, 4.0], 4, metric).orderBy("rank").collect()
    assert [(r["id"], round(r["distance"], 6) + 0.0) for r in found] == [(v, round(d, 6)) for q, v, d, _ in sorted(brute(metric, 4), key=lambda x: x[3]) if q == 11]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "inner_product"])
def test_range_search(tiny, asked, metric):
    for radius in (0.0, 0.5, 10.0, 25.0):
        found = search.range_search(tiny, asked, radius, metric).collect()
        assert sorted((r["query_id"], r["id"]) for r in found) == sorted((q, v) for q, v, d, _ in brute(metric, 10) if d <= radius + (1e-12 if metric == "cosine" else 0))


def test_slices_of_queries_give_the_same(tiny, asked, monkeypatch):
    whole = sorted(search.search_batch(tiny, asked, 2, strategy="kernel").collect())
    monkeypatch.setattr(search, "SHIPPED", 1)
    assert sorted(search.search_batch(tiny, asked, 2, strategy="kernel").collect()) == whole


def test_filters(spark, tiny):
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    q = [3.0, 4.0]
    assert ids(search.search(tiny, q, 5, where=[1, 3, 99])) == [3, 1]
    assert ids(search.search(tiny, q, 5, where=[])) == []
    assert ids(search.search(tiny, q, 5, where=F.col("vec_id") > 3)) == [4]
    assert ids(search.search(tiny, q, 5, where=spark.createDataFrame([(2,), (2,)], "x long"))) == [2]
    assert ids(search.search(tiny, q, 1000)) == [2, 3, 1, 4]
    assert ids(search.search(tiny, q, 5, min_similarity=0.5)) == [2, 3]
    with pytest.raises(TypeError):
        search.search(tiny, q, 5, where=7)
    with pytest.raises(ValueError):
        search.search(tiny, q, 0)
    with pytest.raises(ValueError):
        search.search(tiny, q, 1, "manhattan")


def test_empty_table_and_text_ids(spark, tiny, asked):
    for strategy in ("kernel", "blocks", "expr"):
        assert search.search_batch(tiny.limit(0), asked, 3, strategy=strategy).count() == 0
        assert search.search_batch(tiny, asked.limit(0), 3, strategy=strategy).count() == 0
    named = tiny.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    found = search.search_batch(named, asked, 2).where("query_id = 11").orderBy("rank").collect()
    assert [r["id"] for r in found] == ["v2", "v3"]


def test_single_search_is_one_top_k(spark, tiny):
    plan = search.search(tiny, [0.0, 1.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_parameters():
    assert [params.recommended_ef_construction(n) for n in (10, 1000, 10_000, 100_000)] == [100, 150, 200, 400]
    assert [params.recommended_ef_search(10, n) for n in (10, 1000, 10_000, 100_000)] == [50, 100, 150, 200]
    assert params.recommended_ef_construction(10, 100) == 200 and params.recommended_ef_search(300, 10) == 300
    assert params.max_capacity(128) == (2**31 - 65) // 512
    level = params.levels(np.arange(200_000), 42, 1 / math.log(16), 16)
    assert abs((level >= 1).mean() - 1 / 16) < 0.003 and (level == params.levels(np.arange(200_000), 42, 1 / math.log(16), 16)).all()
    with pytest.raises(ValueError):
        params.as_uuid("x")


def test_scalar_functions(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0], None)], "a array<float>, b array<float>, c array<float>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = row.select(D.squared_l2(a, b), D.cosine(a, b), D.inner_product(b, b), D.normalize(b), D.normalize(a), D.squared_l2(a, c), D.similarity(D.squared_l2(a, b)), D.similarity(F.lit(-1.0))).first()
    assert list(got)[:3] == [25.0, 1.0, -24.0] and np.allclose(got[3], [0.6, 0.8]) and got[4] == [0.0, 0.0] and got[5] is None and got[6] == 1 / 26 and got[7] is None


@pytest.mark.parametrize("rows", [1, 40, 2000, 5000])
def test_bounded_samples(spark, rows):
    from vecspark.operators.sampling import smallest_hashes

    df = spark.range(3000).withColumn("h", F.xxhash64("id"))
    want = {r["id"] for r in df.orderBy("h").limit(rows).collect()}
    for total in (None, 3000, 10**9):
        assert {r["id"] for r in smallest_hashes(df, F.col("h"), rows, total).collect()} == want
    assert smallest_hashes(df.limit(0), F.col("h"), rows).count() == 0
