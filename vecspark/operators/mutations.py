"""Set-oriented changes of vector tables, as pure functions from DataFrames to DataFrames.

Each is one join on the id: nothing is changed in place. Null ids are refused by ``inserted`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()


def _match(df: DataFrame, ids: DataFrame, id_col: str) -> Column:
    return df[id_col] == ids["__id"]


def deleted(vectors: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``vectors`` without those whose id is in the first column of ``ids``; absent ids change nothing."""
    gone = _ids(ids, ids.columns[0])
    return vectors.join(gone, _match(vectors, gone, id_col), "left_anti")


def conflicts(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, reason) for each id of ``new`` that can't be inserted: null, repeated, or there already."""
    counted = new.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    bad = counted.where(F.col("id").isNull() | (F.col("n") > 1)).select("id", F.when(F.col("id").isNull(), "null").otherwise("repeated").alias("reason"))
    there = _ids(vectors, id_col)
    known = counted.where(F.col("id").isNotNull()).join(there, F.col("id") == there["__id"], "left_semi").select("id", F.lit("present").alias("reason"))
    return bad.unionByName(known)


def inserted(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Both; raises ``ValueError``, and changes nothing, where ids conflict."""
    if (bad := conflicts(vectors, new, id_col).limit(5).collect()):
        raise ValueError("ids that can't be inserted: " + ", ".join(f"{r['id']} ({r['reason']})" for r in bad))
    return vectors.unionByName(new)


def upserted(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``new`` in place of the vectors with its ids, added where there are none."""
    return deleted(vectors, new.select(id_col), id_col).unionByName(new)


def merged(target: DataFrame, source: DataFrame, ids: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """``target`` and the vectors of ``source`` (all, or those in ``ids``) whose ids it doesn't have."""
    if ids is not None:
        wanted = _ids(ids, ids.columns[0])
        source = source.join(wanted, _match(source, wanted, id_col), "left_semi")
    there = _ids(target, id_col)
    return target.unionByName(source.join(there, _match(source, there, id_col), "left_anti"))


def latest(changes: DataFrame, id_col: str = "vec_id", order: str = "seq") -> DataFrame:
    """Of several rows an id, the one of the greatest ``order``."""
    window = Window.partitionBy(id_col).orderBy(F.col(order).desc())
    return changes.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def with_metadata(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id", metadata_col: str = "metadata") -> DataFrame:
    """Metadata replaced, not merged, by that of ``new``; a null there changes nothing."""
    given = new.select(F.col(id_col).alias("__id"), F.col(metadata_col).alias("__new")).where(F.col("__new").isNotNull())
    joined = vectors.join(given, _match(vectors, given, id_col), "left")
    return joined.withColumn(metadata_col, F.coalesce("__new", metadata_col)).drop("__id", "__new")


def difference(old: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, change): ids that only ``new`` has (added) or only ``old`` has (removed)."""
    a, b = old.select(F.col(id_col).alias("id")).distinct(), new.select(F.col(id_col).alias("id")).distinct()
    added = b.join(a, "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))


def dense(vectors: DataFrame, order: str = "vec_id") -> DataFrame:
    """``vectors`` with dense new ids (``node_id``) from 0 on, in order of ``order``.

    Ranks are counted within range partitions and shifted by the partitions before them: no global window."""
    ordered = vectors.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    within = ordered.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    sizes = within.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = within.join(before.select("__part", "__before"), "__part")
    return joined.withColumn("node_id", (F.col("__rank") + F.col("__before")).cast("long")).drop("__part", "__rank", "__before")
