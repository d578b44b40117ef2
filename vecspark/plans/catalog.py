"""All queries of the engine by name, and the SQL that each is held against.

Queries run over whole tables. ``embeddings`` are unit vectors, on which all metrics rank alike, so most queries scale each
by 1 + vec_id % 5. Deletions, updates and the like go by label, so that SQL says the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark import maintenance
from vecspark.ann import graph, ivf
from vecspark.functions import distance as D
from vecspark.functions import params
from vecspark.operators import filters, metrics, mutations, search
from vecspark.sources.store import kept, scratch
from vecspark.table import VectorTable

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, label), each vector longer by 1 + vec_id % 5."""
    by = 1 + F.pmod("vec_id", F.lit(5))
    return embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * by).alias("embedding"), "label")


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# SQL pieces

R6 = "CASE WHEN abs(distance) < 5e-7 THEN 0::DOUBLE ELSE round(distance, 6) END"  # no -0.0

S = "s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v, label FROM embeddings)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def _unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x::DOUBLE * CASE WHEN {_dot(a, a)} > 1e-12 THEN 1 / sqrt({_dot(a, a)}) ELSE 1 END)"


U = f"u AS (SELECT vec_id, label, v, list_transform(list_zip(v, list_transform(v, lambda x: n)), lambda p: p[1] * p[2]) AS unit FROM (SELECT *, CASE WHEN {_dot('v', 'v')} > 1e-12 THEN 1 / sqrt({_dot('v', 'v')}) ELSE 1.0 END AS n FROM s))"
SQL_METRIC = {"euclidean": _l2("a.v", "b.v"), "inner_product": f"1 - {_dot('a.v', 'b.v')}", "cosine": f"1 - {_dot('a.unit', 'b.unit')}"}


def _knn_sql(metric: str, where: str = "TRUE", k: int = K, also: str = "") -> str:
    return f"""
WITH {S}, {U}, pairs AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {SQL_METRIC[metric]} AS distance FROM u a, u b WHERE {where}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs {also})
SELECT query_id, id, {R6} AS distance, rank FROM ranked WHERE rank <= {k}"""


def _first(df: DataFrame) -> list[float]:
    """The query of the single searches: the vector of the smallest id."""
    return df.orderBy("vec_id").select("embedding").first()[0]


def _single_sql(metric: str, where: str = "TRUE", k: int = K, also: str = "", more: str = "") -> str:
    return f"""
WITH {S}, {U}, b AS (SELECT * FROM u ORDER BY vec_id LIMIT 1), pairs AS (SELECT a.vec_id AS id, {SQL_METRIC[metric]} AS distance, a.label FROM u a, b WHERE {where})
SELECT id, {R6} AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank{more} FROM (SELECT * FROM pairs {also} ORDER BY distance, id LIMIT {k})"""


# 2.1 distances and scalar helpers


@query(f"WITH {S} SELECT vec_id, round({_dot('v', 'v')}, 6) AS norm_squared, round(sqrt({_dot('v', 'v')}), 6) AS norm FROM s")
def vec_norms(spark, d):
    n = D.norm_squared(F.col("embedding"))
    return scaled(spark, d).select("vec_id", r6(n).alias("norm_squared"), r6(F.sqrt(n)).alias("norm"))


@query(f"WITH {S}, {U} SELECT vec_id, CAST(unnest(range(1, len(unit) + 1)) AS INTEGER) AS pos, round(unnest(unit), 6) AS value FROM u")
def vec_normalize(spark, d):
    own = scaled(spark, d).select("vec_id", F.posexplode(D.normalize(F.col("embedding"))).alias("pos", "value"))
    return own.select("vec_id", (F.col("pos") + 1).alias("pos"), r6("value").alias("value"))


@query(f"""WITH {S}, {U} SELECT a.label AS label_a, b.label AS label_b, round(avg({SQL_METRIC["euclidean"]}), 6) AS l2, round(avg({SQL_METRIC["inner_product"]}), 6) AS ip,
round(avg({SQL_METRIC["cosine"]}), 6) AS cosine FROM u a, u b GROUP BY ALL""")
def pairwise_by_label(spark, d):
    """Means over all pairs from the sums of each group: no pair is ever made."""
    own = scaled(spark, d).withColumn("unit", D.normalize(F.col("embedding")))
    flat = own.select("label", F.posexplode(F.arrays_zip("embedding", "unit")).alias("pos", "e")).groupBy("label", "pos").agg(F.sum("e.embedding").alias("x"), F.sum("e.unit").alias("u"), F.sum(F.col("e.embedding") ** 2).alias("xx"))
    size = own.groupBy("label").agg(F.count("*").alias("n"))
    sums = flat.groupBy("label").agg(F.sum("xx").alias("xx"), F.sort_array(F.collect_list(F.struct("pos", "x", "u"))).alias("s")).join(size, "label")
    sums = sums.select("label", "n", "xx", F.col("s.x").alias("x"), F.col("s.u").alias("u"))  # one row a label
    a = sums.select(*[F.col(c).alias(f"{c}_a") for c in sums.columns])
    b = sums.select(*[F.col(c).alias(f"{c}_b") for c in sums.columns])
    pairs = a.crossJoin(b)
    n = F.col("n_a") * F.col("n_b")
    l2 = F.col("xx_a") / F.col("n_a") + F.col("xx_b") / F.col("n_b") - 2 * D.dot(F.col("x_a"), F.col("x_b")) / n
    return pairs.select("label_a", "label_b", r6(l2).alias("l2"), r6(1 - D.dot(F.col("x_a"), F.col("x_b")) / n).alias("ip"), r6(1 - D.dot(F.col("u_a"), F.col("u_b")) / n).alias("cosine"))


@query("""SELECT p_partkey, CAST(greatest(2 * p_size, CASE WHEN p_partkey < 1000 THEN 100 WHEN p_partkey < 10000 THEN 150 WHEN p_partkey < 100000 THEN 200 ELSE 400 END) AS BIGINT) AS ef_construction,
CAST(greatest(p_size, 50, CASE WHEN p_partkey >= 100000 THEN 200 WHEN p_partkey >= 10000 THEN 150 WHEN p_partkey >= 1000 THEN 100 ELSE 0 END) AS BIGINT) AS ef_search FROM part""")
def recommended_ef(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    n, m = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", params.ef_construction_column(n, m).cast("long").alias("ef_construction"), params.ef_search_column(m, n).cast("long").alias("ef_search"))


@query("SELECT o_orderkey, CAST(o_orderkey // 1000 AS BIGINT) AS chunk, CAST(o_orderkey % 1000 AS BIGINT) AS chunk_offset FROM orders")
def chunk_arithmetic(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k, params.chunk_of(k).alias("chunk"), params.chunk_offset(k).alias("chunk_offset"))


_M, _SEED = "18446744073709551616::UHUGEINT", int(params.splitmix(np.array([42], np.uint64))[0])


def _times(x: str, c: int) -> str:
    return f"(({x})::UHUGEINT * {c}::UHUGEINT % {_M})::UBIGINT"


@query(f"""WITH a AS (SELECT ((xor({_SEED}::UBIGINT, vec_id::UBIGINT)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {_M})::UBIGINT AS x FROM embeddings),
b AS (SELECT {_times("xor(x, x >> 30)", 0xBF58476D1CE4E5B9)} AS x FROM a), c AS (SELECT {_times("xor(x, x >> 27)", 0x94D049BB133111EB)} AS x FROM b), e AS (SELECT xor(x, x >> 31) AS x FROM c)
SELECT CAST(least(floor(-ln(greatest((x >> 11)::DOUBLE / 9007199254740992, 1.0 / 18014398509481984)) / ln(16)), 16) AS INTEGER) AS level, count(*) AS count FROM e GROUP BY 1""")
def level_draw(spark, d):
    own = embeddings(spark, d).select(params.level_draw(F.col("vec_id")).alias("level"))
    return own.groupBy("level").count()


# 2.4 search


def _add_search(metric: str, name: str) -> None:
    def single(spark, d):
        own = scaled(spark, d)
        return rounded(search.search(own, _first(own), K, metric), "distance")

    def batch(spark, d):
        own = scaled(spark, d)
        return rounded(search.search_batch(own, as_queries(own), K, metric), "distance")

    single.__name__, batch.__name__ = f"knn_{name}_single", f"knn_{name}_batch"
    query(_single_sql(metric))(single)
    query(_knn_sql(metric))(batch)


for _metric, _name in (("euclidean", "l2"), ("cosine", "cosine"), ("inner_product", "ip")):
    _add_search(_metric, _name)


@query(_knn_sql("euclidean"))
def knn_l2_expressions(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, strategy="expr"), "distance")


@query(_knn_sql("cosine"))
def knn_cosine_blocks(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, "cosine", strategy="blocks"), "distance")


@query(_knn_sql("euclidean", "a.vec_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"))
def knn_filtered_idset(spark, d):
    own = scaled(spark, d)
    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select("o_custkey")
    return rounded(search.search_batch(own, as_queries(own), K, where=ids), "distance")


@query(_knn_sql("inner_product", "a.label IN (2, 3)"))
def knn_filtered_label(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, "inner_product", where=F.col("label").isin(2, 3)), "distance")


@query(_knn_sql("euclidean", "FALSE"))
def knn_filtered_empty(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, where=[]), "distance")


@query(_single_sql("euclidean", more=", label"))
def knn_with_metadata(spark, d):
    own = scaled(spark, d)
    return rounded(search.search(own, _first(own), K, metadata=["label"]), "distance")


@query(_knn_sql("euclidean", also="WHERE distance > -1 AND 1 / (1 + distance) >= 0.2"))
def knn_min_similarity(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, min_similarity=0.2), "distance")


@query(_knn_sql("cosine", "a.vec_id <> b.vec_id"))
def knn_exclude_self(spark, d):
    own = scaled(spark, d)
    return rounded(search.search_batch(own, as_queries(own), K, "cosine", exclude_self=True), "distance")


@query(_single_sql("cosine", k=10**9))
def knn_k_gt_n(spark, d):
    own = scaled(spark, d)
    return rounded(search.search(own, _first(own), 10**9, "cosine"), "distance")


@query(f"WITH {S}, {U} SELECT b.vec_id AS query_id, a.vec_id AS id, round({_l2('a.v', 'b.v')}, 6) AS distance FROM u a, u b WHERE {_l2('a.v', 'b.v')} <= 3.0")
def range_search_l2(spark, d):
    own = scaled(spark, d)
    return rounded(search.range_search(own, as_queries(own), 3.0), "distance")


@query(f"""WITH {S}, {U}, pairs AS (SELECT b.vec_id AS query_id, a.vec_id AS id, a.label, {SQL_METRIC["cosine"]} AS distance FROM u a, u b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, id, label, {R6} AS distance, rank FROM ranked WHERE rank <= 3""")
def topk_per_label(spark, d):
    """One search a label: labels are few, vectors are never paired."""
    own = scaled(spark, d)
    found = None
    for r in own.select("label").distinct().orderBy("label").collect():
        part = search.search_batch(own, as_queries(own), 3, "cosine", where=F.col("label") == r["label"], exclude_self=True).withColumn("label", F.lit(r["label"]))
        found = part if found is None else found.unionByName(part)
    return rounded(found, "distance").select("query_id", "id", "label", "distance", "rank")


@query(f"""WITH {S}, {U}, pairs AS (SELECT b.vec_id AS query_id, a.label, {SQL_METRIC["cosine"]} AS distance, row_number() OVER (PARTITION BY b.vec_id ORDER BY {SQL_METRIC["cosine"]}, a.vec_id) AS r FROM u a, u b WHERE a.vec_id <> b.vec_id),
votes AS (SELECT query_id, label, count(*) AS votes FROM pairs WHERE r <= 10 GROUP BY ALL)
SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM votes) WHERE r = 1""")
def nearest_label_vote(spark, d):
    own = scaled(spark, d)
    near = search.search_batch(own, as_queries(own), K, "cosine", exclude_self=True)
    votes = near.join(own.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    window = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "label")
    return votes.withColumn("r", F.row_number().over(window)).where("r = 1").drop("r")


_RECALL_SQL = f"""
{S}, {U}, e AS (SELECT b.vec_id AS query_id, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_l2("a.v", "b.v")}, a.vec_id) AS r FROM u a, u b),
p AS (SELECT b.vec_id AS query_id, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_l2("a.v[1:16]", "b.v[1:16]")}, a.vec_id) AS r FROM u a, u b),
recalls AS (SELECT e.query_id, count(p.id) / count(*) AS recall FROM e LEFT JOIN p ON e.query_id = p.query_id AND e.id = p.id AND p.r <= 10 WHERE e.r <= 10 GROUP BY 1)"""


def _recalls(spark, d):
    own = scaled(spark, d)
    short = own.withColumn("embedding", F.slice("embedding", 1, 16))
    return search.recall(search.search_batch(short, as_queries(short), K), search.search_batch(own, as_queries(own), K))


@query(f"WITH {_RECALL_SQL} SELECT query_id, round(recall, 6) AS recall FROM recalls")
def recall_at_k(spark, d):
    return rounded(_recalls(spark, d), "recall")


@query(f"WITH {_RECALL_SQL} SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall, round(max(recall), 6) AS max_recall, avg(recall) >= 0.9 AS passed FROM recalls")
def search_quality(spark, d):
    return rounded(search.quality(_recalls(spark, d)), "mean_recall", "min_recall", "max_recall")


# 2.2, 2.5 lookups and mutations


@query("SELECT c_custkey, c_custkey IN (SELECT vec_id FROM embeddings WHERE label <> 7) AS present FROM customer")
def contains_ids(spark, d):
    table = _table(spark, d, "TRUE").delete_batch(_dropped(embeddings(spark, d), "label = 7"))
    return table.contains_batch(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))


@query("SELECT vec_id, label, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS node_id FROM embeddings WHERE label <> 7")
def compact_dense_ids(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    return mutations.dense(mutations.deleted(own, own.where("label = 7").select("vec_id"))).select("vec_id", "label", "node_id")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE label <> 7")
def delete_tombstones(spark, d):
    own = embeddings(spark, d)
    left = mutations.deleted(own, own.where("label = 7").select("vec_id"))
    return left.select("vec_id", "label", r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query("SELECT vec_id, label, 'old' AS origin FROM embeddings WHERE label <> 7 UNION ALL SELECT vec_id, label, 'new' FROM embeddings WHERE label = 7")
def insert_unique(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    return mutations.inserted(own.where("label <> 7").withColumn("origin", F.lit("old")), own.where("label = 7").withColumn("origin", F.lit("new")))


@query("SELECT vec_id AS id, CASE WHEN label = 7 THEN 'present' ELSE 'repeated' END AS reason FROM embeddings WHERE label IN (3, 7)")
def insert_conflicts(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    new = own.where("label in (3, 5, 7)").unionByName(own.where("label = 3"))
    return mutations.conflicts(own.where("label not in (3, 5)"), new)


@query("SELECT vec_id, CASE WHEN label < 3 THEN label + 100 ELSE label END AS label FROM embeddings")
def upsert(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    return mutations.upserted(own, own.where("label < 3").withColumn("label", F.col("label") + 100))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def latest_wins(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    return mutations.latest(orders, "o_custkey", "o_orderkey")


@query("""SELECT vec_id, CASE WHEN label < 5 THEN '{"kind":"new"}' ELSE '{"label":' || label || '}' END AS metadata FROM embeddings""")
def with_metadata_replace(spark, d):
    own = embeddings(spark, d).select("vec_id", "label", F.to_json(F.struct("label")).alias("metadata"))
    new = own.select("vec_id", F.when(F.col("label") < 5, F.lit('{"kind":"new"}')).alias("metadata"))
    return mutations.with_metadata(own.select("vec_id", "metadata"), new)


@query("SELECT vec_id, CASE WHEN label < 6 THEN 'target' ELSE 'source' END AS side FROM embeddings")
def merge_skip_existing(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    target, source = own.where("label < 6").select("vec_id", F.lit("target").alias("side")), own.where("label > 3").select("vec_id", F.lit("source").alias("side"))
    return mutations.merged(target, source)


@query("SELECT vec_id, CASE WHEN label < 6 THEN 'target' ELSE 'source' END AS side FROM embeddings WHERE label < 6 OR label = 8")
def merge_selected_ids(spark, d):
    own = embeddings(spark, d).select("vec_id", "label")
    target, source = own.where("label < 6").select("vec_id", F.lit("target").alias("side")), own.where("label > 3").select("vec_id", F.lit("source").alias("side"))
    return mutations.merged(target, source, own.where("label in (2, 8)").select("vec_id"))


@query("SELECT vec_id AS id, CASE WHEN label > 7 THEN 'added' ELSE 'removed' END AS change FROM embeddings WHERE label > 7 OR label < 2")
def snapshot_diff(spark, d):
    own = embeddings(spark, d)
    return mutations.difference(own.where("label < 8"), own.where("label >= 2"))


# 2.6 metrics


@query("""SELECT count(*) AS vector_count, count_if(label = 7) AS deleted_count, count(*) - count_if(label = 7) AS live_count, round(count_if(label = 7) / count(*), 6) AS deletion_ratio,
count_if(label = 7) / count(*) > 0.1 AS needs_compaction, CAST(100000 AS BIGINT) AS capacity, CAST(100000 - count(*) AS BIGINT) AS remaining_capacity, round(count(*) / 100000, 6) AS utilization FROM embeddings""")
def index_metrics(spark, d):
    return rounded(metrics.index_metrics(embeddings(spark, d), F.col("label") == 7, 100_000), "deletion_ratio", "utilization")


@query("""SELECT o_orderpriority, round(count_if(o_orderstatus = 'F') / count(*), 6) AS deletion_ratio, count_if(o_orderstatus = 'F') / count(*) > 0.4 AS needs_compaction,
round(count_if(o_orderstatus = 'F') / nullif(count_if(o_orderstatus IN ('F', 'O')), 0), 6) AS hit_ratio FROM orders GROUP BY 1""")
def deletion_ratio_by_group(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority")
    row = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("n"))
    ratio = metrics.ratio(F.col("f"), F.col("n"))
    return row.select("o_orderpriority", r6(ratio).alias("deletion_ratio"), (ratio > 0.4).alias("needs_compaction"), r6(metrics.hit_ratio(F.col("f"), F.col("o"))).alias("hit_ratio"))


_EDGES_SQL = f"""{S}, {U}, near AS (SELECT b.vec_id AS src, a.vec_id AS dst, row_number() OVER (PARTITION BY b.vec_id ORDER BY {SQL_METRIC["cosine"]}, a.vec_id) AS r FROM u a, u b WHERE a.vec_id <> b.vec_id),
edges AS (SELECT CAST(0 AS INTEGER) AS layer, src, dst FROM near WHERE r <= 10 UNION ALL SELECT 1, n.src, n.dst FROM near n JOIN embeddings x ON n.src = x.vec_id JOIN embeddings y ON n.dst = y.vec_id WHERE r <= 10 AND x.label = 1 AND y.label <= 2)"""


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """``edges`` over the ten nearest, searched once, with a second layer by label."""
    own = scaled(spark, d)
    near = kept(search.search_batch(own, as_queries(own), K, "cosine", exclude_self=True).select(F.col("query_id").alias("src"), F.col("id").alias("dst")), "near")
    lab = own.select("vec_id", "label")
    up = near.join(lab.where("label = 1").select(F.col("vec_id").alias("src")), "src").join(lab.where("label <= 2").select(F.col("vec_id").alias("dst")), "dst")
    return near.select(F.lit(0).alias("layer"), "src", "dst").unionByName(up.select(F.lit(1).alias("layer"), "src", "dst"))


@query(f"WITH {_EDGES_SQL} SELECT layer, count(DISTINCT src) AS n_nodes, count(*) AS n_edges FROM edges GROUP BY 1")
def level_distribution(spark, d):
    return metrics.level_distribution(knn_edges(spark, d))


@query(f"WITH {_EDGES_SQL} SELECT layer, src, count(*) AS degree FROM edges GROUP BY ALL HAVING count(*) > CASE WHEN layer = 0 THEN 9 ELSE 1 END")
def graph_degree_violations(spark, d):
    return metrics.degree_violations(knn_edges(spark, d), 9, 1)


@query(f"WITH {_EDGES_SQL} SELECT layer, src, dst FROM edges WHERE dst IN (SELECT vec_id FROM embeddings WHERE label = 7)")
def graph_dangling(spark, d):
    return metrics.dangling(knn_edges(spark, d), embeddings(spark, d).where("label <> 7"))


@query(f"WITH {_EDGES_SQL} SELECT layer, src, dst FROM edges WHERE dst IN (SELECT vec_id FROM embeddings WHERE label = 4)")
def graph_deleted_neighbours(spark, d):
    return metrics.deleted_neighbours(knn_edges(spark, d), embeddings(spark, d).where("label = 4").select("vec_id"))


@query(f"""WITH {_EDGES_SQL} SELECT count_if(layer = 0) AS layer0_edges, count(*) AS edge_count, max(layer) AS max_level, (SELECT min(src) FROM edges WHERE layer = (SELECT max(layer) FROM edges)) AS entrypoint,
(SELECT count(*) FROM embeddings) AS n_nodes, round(count_if(layer = 0) / (SELECT count(*) FROM embeddings), 6) AS avg_connectivity, CAST(16 AS INTEGER) AS expected_m,
round(count_if(layer = 0) / (SELECT count(*) FROM embeddings) / 16, 6) AS connectivity_ratio FROM edges""")
def graph_health(spark, d):
    return rounded(metrics.graph_health(knn_edges(spark, d), embeddings(spark, d), 16), "avg_connectivity", "connectivity_ratio")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, walk(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM edges e JOIN walk w ON e.src = w.node WHERE e.layer = 0) SELECT node FROM walk""")
def graph_reachable(spark, d):
    return metrics.reachable(knn_edges(spark, d), 0).select("node")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, walk(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM edges e JOIN walk w ON e.src = w.node WHERE e.layer = 0),
missed AS (SELECT count(*) - (SELECT count(*) FROM walk) AS n, count(*) AS of FROM embeddings), all_checks("check", violations) AS (
SELECT 'self_loops', 0 UNION ALL SELECT 'neighbour_counts', 0 UNION ALL SELECT 'neighbour_bounds', count(*) FROM edges WHERE dst NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'entry_point', 0 UNION ALL SELECT 'connectivity', CASE WHEN n <= 0.05 * of THEN 0 ELSE n END FROM missed UNION ALL SELECT 'navigability', 0
UNION ALL SELECT 'deleted_neighbours', count(*) FROM edges WHERE dst IN (SELECT vec_id FROM embeddings WHERE label = 4))
SELECT "check", CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM all_checks""")
def graph_invariants(spark, d):
    return metrics.invariants(knn_edges(spark, d), embeddings(spark, d), 32, 16, 0, vector_col="embedding", gone=embeddings(spark, d).where("label = 4").select("vec_id"))


# 2.3 filter expressions


def _marks(df: DataFrame, key: str, field, texts: dict[str, str], semantics: str = "sql") -> DataFrame:
    return df.select(key, *[filters.compile(t, field, semantics).alias(n) for n, t in texts.items()])


@query("""SELECT event_id, event_type = 'click' AND value >= 50 AS a, event_type = 'click' OR (value < 10 AND user_id <> 7) AS b,
NOT ((event_type IN ('click', 'view') OR value > 90)) AS c, value >= -15.6 AND value <= 20.13 AS d FROM events""")
def filter_and_or_not(spark, d):
    texts = {
        "a": "event_type == 'click' && value >= 50", "b": "event_type == 'click' OR value < 10 AND user_id != 7",
        "c": "NOT(event_type IN ['click', 'view'] || value > 90)", "d": "value >= -15.6 && value <= 20.13",
    }
    return _marks(spark.read.parquet(f"{d}/events.parquet"), "event_id", filters.columns, texts)


_K = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query(f"SELECT event_id, {_K} IN (1, 2, 3) AS a, NOT ({_K} IN (1, 2, 3)) AS b, false AS c, true AS d, {_K} > 50 AS e FROM events")
def filter_json_in_nin(spark, d):
    texts = {"a": "k IN [1, 2, 3]", "b": "k NIN [1, 2, 3]", "c": "missing IN ['x']", "d": "missing NOT IN ['x']", "e": "k > 50"}
    return _marks(spark.read.parquet(f"{d}/events.parquet"), "event_id", filters.json("props"), texts)


_LABELLED = "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet")
    return docs.join(labels, "doc_id", "left")


@query(f"""SELECT doc_id, quality IS NULL AS a, quality IS NOT NULL AS b, coalesce(quality = 1, false) AS c, coalesce(quality <> 1, true) AS d, coalesce(quality < 1, false) AS e,
coalesce(quality >= 0, false) AS f FROM {_LABELLED}""")
def filter_isnull(spark, d):
    texts = {"a": "quality ISNULL", "b": "quality IS NOT NULL", "c": "quality == 1", "d": "quality != 1", "e": "quality < 1", "f": "quality >= 0"}
    return _marks(_labelled(spark, d), "doc_id", filters.columns, texts)


@query(f"""SELECT doc_id, coalesce(quality < 1, true) AS a, coalesce(quality <= 0, true) AS b, coalesce(quality <> 1, true) AS c, coalesce(quality > 0, false) AS d, quality IS NULL AS e,
coalesce(quality < 1, true) AND NOT coalesce(toxic >= 1, false) AS f FROM {_LABELLED}""")
def filter_null_ordering(spark, d):
    texts = {"a": "quality < 1", "b": "quality <= 0", "c": "quality != 1", "d": "quality > 0", "e": "quality == null", "f": "quality < 1 && !(toxic >= 1)"}
    return _marks(_labelled(spark, d), "doc_id", filters.columns, texts, "ordered")


# IVF's coarse step


@query(f"""WITH {S}, flat AS (SELECT label, vec_id, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM s)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM flat GROUP BY ALL""")
def centroid_stats(spark, d):
    flat = scaled(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy("label", (F.col("pos") + 1).alias("pos")).agg(r6(F.avg("x")).alias("value"))


# 2.7 versions: real tables in the shared folder


def _table(spark: SparkSession, d: str, where: str, **options) -> VectorTable:
    own = embeddings(spark, d).where(where).select(F.col("vec_id").alias("id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))
    table = VectorTable.create(spark, scratch(spark, "table"), 64, capacity=10_000_000, **options)
    return table.insert_batch(own).sync("first")


def _shown(table: VectorTable) -> DataFrame:
    return table.vectors().select(F.col("id").cast("long").alias("vec_id"), "metadata", r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


def _shown_sql(where: str, meta: str = """'{"label":' || label || '}'""") -> str:
    return f"SELECT vec_id, {meta} AS metadata, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE {where}"


def _dropped(d: DataFrame, label: str) -> DataFrame:
    return d.where(label).select("vec_id")


@query(_shown_sql("label <> 7"))
def table_commit_delete(spark, d):
    return _shown(_table(spark, d, "label < 8").delete_batch(_dropped(embeddings(spark, d), "label = 7")).insert_batch(_new(spark, d, "label >= 8")).sync("second"))


def _new(spark: SparkSession, d: str, where: str) -> DataFrame:
    return embeddings(spark, d).where(where).select(F.col("vec_id").alias("id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))


@query(_shown_sql("label < 5"))
def table_time_travel(spark, d):
    first = _table(spark, d, "label < 5")
    first.insert_batch(_new(spark, d, "label >= 5")).delete_batch(_dropped(embeddings(spark, d), "label = 1")).sync("second")
    return _shown(VectorTable.load_commit(spark, first.store.root, first.get_commit_id()))


@query(_shown_sql("label <> 1"))
def table_branch_merge(spark, d):
    main = _table(spark, d, "label < 5")
    feature = main.make_branch("feature").insert_batch(_new(spark, d, "label >= 5")).sync("on the branch")
    main = main.delete_batch(_dropped(embeddings(spark, d), "label = 1")).sync("on main")
    return _shown(main.merge(feature, main.diff(feature).where("change = 'added' AND id_type = 'long'").join(embeddings(spark, d).where("label <> 1").select(F.col("vec_id").cast("string").alias("id")), "id", "left_semi").select(F.col("id").cast("long")).toPandas()["id"].tolist()))


@query(_shown_sql("label <> 7"))
def table_compaction(spark, d):
    table = _table(spark, d, "TRUE").delete_batch(_dropped(embeddings(spark, d), "label = 7")).sync("deleted")
    return _shown(maintenance.compacted(table, scratch(spark, "compacted")))


@query(_shown_sql("label NOT IN (2, 7)"))
def table_online_compaction(spark, d):
    table = _table(spark, d, "label < 8").delete_batch(_dropped(embeddings(spark, d), "label = 7")).sync("deleted")
    running = maintenance.OnlineCompaction(table, scratch(spark, "compacted"), 10**9).run()
    later = table.insert_batch(_new(spark, d, "label >= 8")).delete_batch(_dropped(embeddings(spark, d), "label = 2")).sync("meanwhile")
    return _shown(running.finish(later))


@query("SELECT 1 AS depth, 'second' AS message, count(*) AS vector_count, count(*) - count_if(label = 7) AS live_count FROM embeddings UNION ALL SELECT 2, 'first', count(*), count(*) FROM embeddings")
def table_history(spark, d):
    table = _table(spark, d, "TRUE").delete_batch(_dropped(embeddings(spark, d), "label = 7")).sync("second")
    rows = [(n + 1, c["message"], c["vector_count"], c["vector_count"] - c["deleted_count"]) for n, c in enumerate(table.history())]
    return spark.createDataFrame(rows, "depth int, message string, vector_count long, live_count long")


@query("SELECT true AS valid, 'ok' AS chain, count(*) AS vector_count, CAST(2 AS BIGINT) AS commits FROM embeddings")
def table_verify(spark, d):
    table = _table(spark, d, "TRUE", crypto_hash=True).delete_batch(_dropped(embeddings(spark, d), "label = 7")).sync("second")
    cold, chain = maintenance.verify_from_cold(table), maintenance.verify_chain(table)
    return spark.createDataFrame([(cold["valid"], chain["status"], cold["vector_count"], chain["commits"])], "valid boolean, chain string, vector_count long, commits long")


@query("SELECT CAST(1 AS BIGINT) AS commits_removed, CAST(1 AS BIGINT) AS folders_removed, count(*) AS live_count FROM embeddings WHERE label < 5")
def table_gc(spark, d):
    table = _table(spark, d, "label < 5")
    table.make_branch("gone").insert_batch(_new(spark, d, "label >= 5")).sync("to be lost")
    table.delete_branch("gone")
    table.make_branch("kept")
    gone = maintenance.gc(table, guard_seconds=-1)
    n = sum(g.startswith("commits/") for g in gone) - 1  # the branch's own first commit goes too
    return spark.createDataFrame([(n, sum(g.startswith("data/") for g in gone), VectorTable.load(spark, table.store.root).entries().count())], "commits_removed long, folders_removed long, live_count long")


# approximate search: rows here, held to recall in the tests; where all is visited, it equals exact search


def _plain_sql(where: str = "TRUE", k: int = K, name: str = "a.vec_id") -> str:
    return f"""WITH pairs AS (SELECT b.vec_id AS query_id, a.vec_id AS vec_id, {name} AS id, {_l2("a.embedding", "b.embedding")} AS distance FROM embeddings a, embeddings b WHERE {where}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs) SELECT query_id, id, {R6} AS distance, rank FROM ranked WHERE rank <= {k}"""


@query()
def ann_ivf(spark, d):
    own = embeddings(spark, d)
    centroids = ivf.fit(own, 16)
    return ivf.probe(ivf.assigned(own, centroids), as_queries(own), centroids, K, 12)


@query(_plain_sql())
def ann_ivf_all_cells(spark, d):
    own = embeddings(spark, d)
    centroids = ivf.fit(own, 16)
    return rounded(ivf.probe(ivf.assigned(own, centroids), as_queries(own), centroids, K, 16), "distance")


def _graph(spark, d, m: int = 8) -> DataFrame:
    path = scratch(spark, "graph")
    graph.build(embeddings(spark, d), m, 64).write.parquet(path)
    return spark.read.schema(graph.EDGES).parquet(path)


@query()
def ann_graph(spark, d):
    own = embeddings(spark, d)
    return graph.probe(own, _graph(spark, d), as_queries(own), K, 64)


def _wide(spark, d) -> int:
    return embeddings(spark, d).count()


@query(_plain_sql())
def ann_graph_full_width(spark, d):
    own = embeddings(spark, d)
    return rounded(graph.probe(own, _graph(spark, d), as_queries(own), K, _wide(spark, d), budget=10**9, patience=10**9, timeout_ms=10**9), "distance")


@query(_plain_sql("a.label IN (2, 3)"))
def ann_filtered(spark, d):
    own = embeddings(spark, d)
    return rounded(graph.probe(own, _graph(spark, d), as_queries(own), K, _wide(spark, d), where=own.where("label IN (2, 3)").select("vec_id")), "distance")


@query(_plain_sql("a.label <> 7"))
def ann_after_delete(spark, d):
    own = embeddings(spark, d)
    return rounded(graph.probe(own, _graph(spark, d), as_queries(own), K, _wide(spark, d), where=own.where("label <> 7").select("vec_id")), "distance")


@query("""SELECT 'to_deleted' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'self_loops', 0 UNION ALL SELECT 'neighbour_counts', 0 UNION ALL SELECT 'nodes_lost', 0""")
def ann_delete_repair(spark, d):
    own, gone = embeddings(spark, d), embeddings(spark, d).where("label = 7").select("vec_id")
    fixed = graph.repaired(own, _graph(spark, d), gone, 8)
    live = own.join(gone, "vec_id", "left_anti")
    lost = live.join(fixed.where("layer = 0").select(F.col("src").alias("vec_id")).distinct(), "vec_id", "left_anti")
    parts = {"to_deleted": metrics.dangling(fixed, live), "self_loops": metrics.self_loops(fixed), "neighbour_counts": metrics.degree_violations(fixed, 16, 8), "nodes_lost": lost}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


from vecspark.plans import operations  # noqa: E402, F401  the rest of the queries
