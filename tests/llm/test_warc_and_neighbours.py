"""Operators 3 and 4 against SQL and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import CLASHING
from compare import differences
from vecspark.llm import neighbours, queries, warc

KEYS = {
    "http://www.Example.com:80/A/b/?b=2&a=1&utm_source=x#frag": "com,example)/a/b?a=1&b=2",
    "https://user:pw@blog.example.org:8443": "org,example,blog:8443)/",
    "//h/p//": "h)/p", "/only/path?sid=9": ")/only/path", "": ")/", "http://h?": "h)/", "http://h/?PHPSESSID=1&q=%20": "h)/?q=%20",
}


def test_url_keys(spark):
    got = spark.createDataFrame([(u,) for u in KEYS], "u string").select("u", warc.url_key(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in got} == KEYS


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) == []


def test_every_capture_is_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    monkeypatch.setattr(warc, "PART_LINES", 20)
    rows = [(i, f"http://h{i % 5}.example/p{i % 30}?x={i % 2}", f"<p>{i}" * (i % 7)) for i in range(100)]
    rows += [(200 + i, "http://hot.example/\t\n", "same") for i in range(50)] + [(None, "http://h/", None), (300, None, "x"), (301, "http://h/", "é" * 400_000), (301, "http://h/", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHING}).repartition(4)
    index = warc.build(pages)
    assert len(index.files) > 3
    asked = spark.createDataFrame([(k,) for k in ["h)/", "example,hot)/\t\n", "zz)/none", None, "a"]], "key string")
    got = warc.looked_up(asked, index)
    assert got.groupBy("key").count().orderBy("key").collect() == [("example,hot)/\t\n", 50), ("h)/", 3)]
    every = warc.looked_up(pages.select(warc.url_key(F.col("url")).alias("key")), index)
    want = pages.where("url IS NOT NULL").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    assert sorted(map(repr, every.select("page_id", "url", "digest").collect())) == sorted(map(repr, want.collect()))


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.build(pages)
    assert index.files == [] and warc.looked_up(spark.createDataFrame([("a",)], "key string"), index).count() == 0


def _exact(x: dict[int, list[float]], k: int) -> set:
    out = set()
    for a, v in x.items():
        near = sorted((round(float(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum()), 6), b) for b, w in x.items() if b != a and len(w) == len(v))
        out |= {(a, r + 1, b, d) for r, (d, b) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("block", [10_000, 40])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    x = {i: (rng.normal(size=16) * 10.0 ** rng.integers(-3, 3)).tolist() for i in range(150)}
    x |= {200 + i: x[i % 3] for i in range(20)} | {300: [0.0] * 16, 301: [0.0] * 16} | {400 + i: [float(i), 1.0] for i in range(3)}
    rows = list(x.items()) + [(5, x[5]), (None, x[1]), (500, None), (501, []), (502, [float("nan")] * 16), (503, [None] * 16), (504, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("c") for c in CLASHING})
    got = {tuple(r) for r in neighbours.neighbours(df, 7, block).collect()}
    assert got == _exact(x, 7)


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.neighbours(df).count() == 0
    assert neighbours.neighbours(spark.createDataFrame([(1, [1.0])], df.schema)).count() == 0
    with pytest.raises(ValueError):
        neighbours.neighbours(df, 0)


def test_code_products_of_wide_vectors_stay_exact():
    x = np.random.default_rng(1).normal(size=(4, 3000))
    c = neighbours.Codes(x)
    assert (c.products(0, 4, c) == c.codes.astype(int) @ c.codes.astype(int).T).all()
