"""Metrics of tables and graphs, and the invariants of neighbour graphs.

Graphs are DataFrames ``edges(layer, src, dst)``; every check is an aggregation or an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPACT_ABOVE = 0.10


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hit_ratio(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses); null where there was no access."""
    return F.when(hits + misses > 0, hits / (hits + misses))


def index_metrics(vectors: DataFrame, is_deleted: Column, capacity: int, edges: DataFrame | None = None, threshold: float = COMPACT_ABOVE) -> DataFrame:
    """One row of counts and ratios; ``is_deleted`` says which slots are soft-deleted."""
    row = vectors.agg(F.count("*").alias("vector_count"), F.count_if(is_deleted).alias("deleted_count"))
    row = row.withColumn("live_count", F.col("vector_count") - F.col("deleted_count")).withColumn("deletion_ratio", ratio(F.col("deleted_count"), F.col("vector_count")))
    row = row.withColumn("needs_compaction", F.col("deletion_ratio") > threshold).withColumn("capacity", F.lit(capacity).cast("long"))
    row = row.withColumn("remaining_capacity", F.col("capacity") - F.col("vector_count")).withColumn("utilization", ratio(F.col("vector_count"), F.col("capacity")))
    if edges is not None:
        row = row.crossJoin(edges.agg(F.count("*").alias("edge_count")))
        row = row.withColumn("avg_edges_per_node", ratio(F.col("edge_count"), F.col("live_count")))
    return row


def graph_health(edges: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    """One row: average links a node on layer 0, top layer, entry point (smallest node there), and links as a share of m."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    row = edges.agg(F.count_if(F.col("layer") == 0).alias("layer0_edges"), F.count("*").alias("edge_count"), F.max("layer").alias("max_level"), F.max_by("src", F.struct("layer", -F.col("src"))).alias("entrypoint"))
    row = row.crossJoin(n).withColumn("avg_connectivity", ratio(F.col("layer0_edges"), F.col("n_nodes")))
    return row.withColumn("expected_m", F.lit(m)).withColumn("connectivity_ratio", F.col("avg_connectivity") / m)


def level_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("layer").agg(F.countDistinct("src").alias("n_nodes"), F.count("*").alias("n_edges"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def degree_violations(edges: DataFrame, m0: int, m: int) -> DataFrame:
    """Nodes with more links than m0 on layer 0, or m above."""
    return edges.groupBy("layer", "src").agg(F.count("*").alias("degree")).where(F.col("degree") > F.when(F.col("layer") == 0, m0).otherwise(m))


def dangling(edges: DataFrame, nodes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Edges to nodes that aren't there."""
    own = nodes.select(F.col(id_col).alias("__id"))
    return edges.join(own, edges["dst"] == own["__id"], "left_anti")


def deleted_neighbours(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges to deleted nodes: allowed until compaction."""
    own = gone.select(F.col(gone.columns[0]).alias("__id"))
    return edges.join(own, edges["dst"] == own["__id"], "left_semi")


def reachable(edges: DataFrame, start: int, layer: int = 0, hops: int = 1000) -> DataFrame:
    """(node, depth): breadth-first from ``start``. Each round is written to the shared folder, so lineage stays short and executors may be lost."""
    from vecspark.sources.store import kept

    spark = edges.sparkSession
    own = kept(edges.where(F.col("layer") == layer).select("src", "dst"), "links")
    frontier = spark.createDataFrame([(start, 0)], "node long, depth int")
    seen, n = frontier, 1
    for depth in range(1, hops + 1):
        step = own.join(frontier, own["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))
        seen = kept(seen.unionByName(step.join(seen.select("node"), "node", "left_anti")), "reached")
        if (now := seen.count()) == n:
            return seen
        frontier, n = seen.where(F.col("depth") == depth), now
    return seen


def navigability(vectors: DataFrame, edges: DataFrame, targets: DataFrame, start: int, max_hops: int = 1000, metric: str = "euclidean", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(target, node, hops, finished): a greedy walk from ``start`` to each target vector (``targets``: target, v), layer by layer, over
    nearer and nearer neighbours. It has finished where no neighbour on layer 0 is nearer. One join a hop, for all walks that go on; edges
    are read once a hop."""
    from vecspark.functions import distance as D
    from vecspark.sources.store import kept

    x = vectors.select(F.col(id_col).alias("node"), F.col(vector_col).alias("x"))
    first = x.where(F.col("node") == start)
    top = edges.agg(F.coalesce(F.max("layer"), F.lit(0)).alias("layer"))
    going, over = kept(targets.crossJoin(first).crossJoin(top).select("target", "v", "node", D.distance(metric, F.col("x"), F.col("v")).alias("d"), "layer", F.lit(0).alias("hops")), "walks"), []
    for _ in range(max_hops):
        if going.limit(1).count() == 0:
            break
        step = going.join(edges.select(F.col("layer").alias("l"), "src", "dst"), (F.col("node") == F.col("src")) & (F.col("layer") == F.col("l")))
        step = step.join(x.select(F.col("node").alias("dst"), F.col("x").alias("y")), "dst").select("target", F.struct(D.distance(metric, F.col("y"), F.col("v")).alias("d"), F.col("dst").alias("n")).alias("to"))
        best = step.groupBy(F.col("target").alias("t")).agg(F.min("to").alias("to"))
        moved = going.join(best, F.col("target") == F.col("t"), "left")
        nearer = F.coalesce(F.col("to.d") < F.col("d"), F.lit(False)) & (F.col("layer") >= 0)
        walks = kept(moved.select("target", "v", F.when(nearer, F.col("to.n")).otherwise(F.col("node")).alias("node"), F.when(nearer, F.col("to.d")).otherwise(F.col("d")).alias("d"), F.when(nearer | (F.col("layer") < 0), F.col("layer")).otherwise(F.col("layer") - 1).alias("layer"), F.when(nearer, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops")), "walks")
        over.append(walks.where("layer < 0").select("target", "node", "hops", F.lit(True).alias("finished")))
        going = walks.where("layer >= 0")
        if len(over) == 16:
            over = [kept(_together(over), "over")]
    return _together([*over, going.select("target", "node", "hops", F.lit(False).alias("finished"))])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def invariants(edges: DataFrame, nodes: DataFrame, m0: int, m: int, start: int | None = None, least: float = 0.95, id_col: str = "vec_id", vector_col: str | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(check, violations, passed) of all checks; those of the entry point need ``start``, navigability ``vector_col`` too, and deleted neighbours ``gone``."""
    from vecspark.sources.store import kept

    edges = kept(edges.select("layer", "src", "dst"), "edges")  # every check and every hop reads them
    n = nodes.select(F.count("*").alias("violations"))
    checks = [
        ("self_loops", self_loops(edges).agg(F.count("*").alias("violations"))),
        ("neighbour_counts", degree_violations(edges, m0, m).agg(F.count("*").alias("violations"))),
        ("neighbour_bounds", dangling(edges, nodes, id_col).agg(F.count("*").alias("violations"))),
    ]
    if start is not None:
        there = nodes.where(F.col(id_col) == start).agg((1 - F.count("*")).alias("violations"))
        missed = nodes.join(reachable(edges, start), F.col(id_col) == F.col("node"), "left_anti").agg(F.count("*").alias("missed"))
        connected = missed.crossJoin(n).select(F.when(F.col("missed") <= (1 - least) * F.col("violations"), 0).otherwise(F.col("missed")).alias("violations"))
        checks += [("entry_point", there), ("connectivity", connected)]
    if start is not None and vector_col is not None:
        walks = navigability(nodes, edges, nodes.select(F.col(id_col).alias("target"), F.col(vector_col).alias("v")), start, id_col=id_col, vector_col=vector_col)
        checks.append(("navigability", walks.agg(F.count_if(~F.col("finished")).alias("violations"))))
    if gone is not None:
        checks.append(("deleted_neighbours", deleted_neighbours(edges, gone).agg(F.count("*").alias("violations"))))
    out = None
    for name, row in checks:
        one = row.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("violations") == 0)
