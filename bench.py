"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is timed on the next run, to its last row (a no-op sink). ``detail`` has recall
at 10 of approximate search and, at the baseline's sizes (seeded 10,000 and 100,000 x 128), vectors a second of ingestion
and queries a second of exact search in batches of 10,000.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "knn_l2_single", "knn_l2_batch", "knn_cosine_batch", "knn_ip_batch", "knn_cosine_blocks", "knn_filtered_label", "knn_filtered_idset", "knn_exclude_self", "search_quality", "range_search_l2",
    "index_metrics", "upsert", "merge_skip_existing", "compact_dense_ids", "filter_and_or_not", "graph_health", "table_commit_delete", "table_branch_merge", "ann_ivf", "ann_graph",
)


def sized(spark: SparkSession, n: int, scratch: str, dim: int = 128, asked: int = 10_000, runs: int = 3) -> dict:
    """Ingestion and batched exact search of n seeded vectors: mean and deviation of some runs."""
    import numpy as np

    from vecspark.operators import search
    from vecspark.table import VectorTable

    rng = np.random.default_rng(n)
    centres = rng.standard_normal((50, dim))
    make = lambda k: (centres[rng.integers(0, 50, k)] + 0.5 * rng.standard_normal((k, dim))).astype(np.float32)
    for name, rows in (("vectors", n), ("queries", asked)):
        x = make(rows)
        table = pa.table({"id": pa.array(np.arange(rows)), "embedding": pa.ListArray.from_arrays(pa.array((np.arange(rows + 1) * dim).astype(np.int32)), pa.array(x.ravel()))})
        pq.write_table(table, f"{scratch}/{name}-{n}.parquet", row_group_size=max(1000, rows // 16))
    vectors = spark.read.parquet(f"{scratch}/vectors-{n}.parquet")
    queries = spark.read.parquet(f"{scratch}/queries-{n}.parquet").selectExpr("id AS query_id", "embedding AS query")
    ingest, batch = [], []
    for k in range(runs + 1):
        began = time.perf_counter()
        VectorTable.create(spark, f"{scratch}/table-{n}-{k}", dim).insert_batch(vectors).sync("all")
        ingest.append(n / (time.perf_counter() - began))
        began = time.perf_counter()
        search.search_batch(vectors.withColumnRenamed("id", "vec_id"), queries, 10).write.format("noop").mode("overwrite").save()
        batch.append(asked / (time.perf_counter() - began))
    show = lambda v: {"mean": round(statistics.mean(v[1:])), "stdev": round(statistics.stdev(v[1:]))}  # noqa: E731  the first warms up
    return {"ingest_vectors_per_sec": show(ingest), "exact_queries_per_sec": show(batch)}


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    sys.path.insert(0, here)
    from vecspark.operators import search
    from vecspark.plans import catalog

    with tempfile.TemporaryDirectory() as scratch:
        spark = (
            SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", scratch).config("spark.sql.session.timeZone", "UTC").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {}
        for name in HEADLINE:
            for _ in range(2):
                began = time.perf_counter()
                catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.perf_counter() - began, 3)
        own = catalog.embeddings(spark, SF)
        exact = search.search_batch(own, catalog.as_queries(own), 10).persist()
        recall = {name: round(search.quality(search.recall(catalog.queries()[name](spark, SF), exact)).first()["mean_recall"], 4) for name in ("ann_ivf", "ann_graph")}
        detail = {"recall_at_10": recall, "sizes": {f"{n}x128": sized(spark, n, scratch) for n in (10_000, 100_000)}}
        print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF).removeprefix("sf"), "detail": detail}))
        spark.stop()


if __name__ == "__main__":
    main()
