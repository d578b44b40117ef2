"""Bounded samples that depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: Column, rows: int, total: int | None = None) -> DataFrame:
    """The ``rows`` rows of the smallest 64-bit hash ``key`` (some more where hashes are equal; all, if there are no more).

    Hashes are spread evenly, so a bound that leaves some four times as many rows is known from the number of rows (``total``,
    at least that of ``df``); it is doubled until enough rows are under it. Only those few rows are ever sorted or moved,
    while a plain sort with a limit sends ``rows`` rows of every partition to one task."""
    share = 4 * rows / max(1, df.count() if total is None else total)
    while share < 1:
        part = df.where(key < F.lit(int(-(2**63) + share * 2**64)))
        found = part.select(key.alias("__h")).orderBy("__h").limit(rows).agg(F.count("*").alias("n"), F.max("__h").alias("last")).first()
        if found["n"] >= rows:
            return df.where(key <= F.lit(found["last"]))
        share *= 4
    found = df.select(key.alias("__h")).orderBy("__h").limit(rows).agg(F.max("__h").alias("last")).first()
    return df if found["last"] is None else df.where(key <= F.lit(found["last"]))
