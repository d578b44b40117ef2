"""Holds a registered query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(df, sql: str, sf_dir: str) -> list:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    ours = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = sorted(repr(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(ours) == len(theirs)
    return [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b][:3]
