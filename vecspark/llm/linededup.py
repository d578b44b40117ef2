"""Operator 2: repeated runs of lines are deleted wherever they come up again, found by winnowing over line hashes.

Lines (split at ``\\n``, compared without surrounding white space; blank lines are transparent) form a sequence of hashes.
A *repeated run* is a sequence of lines of ``WORDS`` (50) words or more in all that equals an earlier one, where earlier
means a smaller (doc_id, line). All its lines, and blank lines among them, are deleted; the first occurrence stays.

*Search, exact.* 1. Winnowing: a window is a shortest stretch of lines that reaches ``WORDS``, from any line on and up to
any line (cut by words, because lines differ in length); the smallest line hash of a window is selected, lines of under
``SHORT`` words last. Equal runs have equal windows, so they share a selected minimum: the minima are guaranteed
fingerprints. 2. Positions are joined by the minimum: those of a line selected in one place only are out. 3. Around each
position that is left, the match is extended both ways: every stretch about the minimum that makes a window is compared,
by a second hash over all its lines, with the first place in the corpus that has it; where that place is earlier, its
lines repeat. All lines of a run are in such windows, so the union of them is the whole run. 4. The runs are cut.
A line that is the minimum of thousands of windows never pairs them with each other: both joins are against one
row per hash, made by partial aggregation, so that hot lines can be split and the work is linear in the corpus' lines.

Defined cases: null and empty texts stay as they are; texts of any length are compared whole; an empty table gives an
empty one; rows without ``doc_id`` are neither compared nor changed; rows repeated under one ``doc_id`` are one document
and stay alike; of equal runs the one of the smallest (doc_id, line) stays, so there are no ties; other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm import text as X

WORDS, SHORT = 50, 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, raw line number, hash, words) of the lines that aren't blank, in order."""
    w0, w1 = X.runs(~_SPACE[buf], offs)
    if len(w0) == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, X.U), np.zeros(0, np.int64))
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(offs, w0, "right") - 1
    number = np.searchsorted(breaks, w0) - np.searchsorted(breaks, offs[row])
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])]))
    last = np.append(new[1:], len(w0)) - 1
    return row[new], number[new], X.span_hash(buf, w0[new], w1[last]), last - new + 1


def windows(row: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line, last line, line of the smallest hash, hash of all lines) of all windows; lines are indexes of those given."""
    n = len(row)
    cw = np.concatenate([[0], np.cumsum(words)])
    begin, end = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    i = np.arange(n)
    j = np.searchsorted(cw, cw[:-1] + WORDS)
    fwd = j <= end
    s = np.searchsorted(cw, cw[1:] - WORDS, "right") - 1
    back = s >= begin
    a, b = np.concatenate([i[fwd], s[back]]), np.concatenate([j[fwd] - 1, i[back]])
    key = np.unique(a * (n + 1) + b)
    a, b = key // (n + 1), key % (n + 1)
    order = (h >> X.U(1)) | ((words < SHORT).astype(X.U) << X.U(63))
    least, whole = a.copy(), X.mix((b - a + 1).astype(X.U))
    at, on = a.copy(), np.arange(len(a))
    while len(on):  # line by line; a window has at most WORDS of them
        whole[on] = X.mix(whole[on] ^ h[at[on]]) * X.U(X._BASE)
        smaller = on[order[at[on]] < order[least[on]]]
        least[smaller] = at[smaller]
        at[on] += 1
        on = on[at[on] <= b[on]]
    return a, b, least, whole


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        buf, offs = X.utf8(batch.column(1))
        for i, j in X.chunks(offs):
            row, number, h, words = lines(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            a, b, least, key = windows(row, h, words)
            cols = [h[least].view(np.int64), number[least].astype(np.int32), key.view(np.int64), ids[i + row[a]], number[a].astype(np.int32), number[b].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["mark", "at", "key", "doc_id", "first", "last"])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): disjoint runs of raw lines to delete."""
    found = X.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_scan, "mark long, at int, key long, doc_id long, first int, last int")
    found = X.stored(found, "windows")
    place = F.struct("doc_id", "at")
    marks = found.groupBy("mark").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p <> q").select("mark")
    around = found.join(marks, "mark", "left_semi").select("key", "doc_id", "first", "last")
    start = F.struct("doc_id", "first")
    origin = around.groupBy("key").agg(F.min(start).alias("p"), F.max(start).alias("q")).where("p <> q").select("key", F.col("p").alias("origin"))
    later = around.join(origin, "key").where(start > F.col("origin")).select("doc_id", "first", "last")
    so_far = Window.partitionBy("doc_id").orderBy("first", "last")
    island = later.distinct().withColumn("reach", F.max("last").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    island = island.withColumn("n", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("doc_id", "first", "last")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs cut from ``text``, and how many lines that were (``__cut_lines``)."""
    runs = repeated(docs).groupBy(F.col("doc_id").alias("__cut_id")).agg(F.collect_list(F.struct("first", "last")).alias("__cut"))
    joined = docs.join(runs, docs["doc_id"].cast("long") == runs["__cut_id"], "left").drop("__cut_id")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.exists("__cut", lambda r: i.between(r["first"], r["last"])))
    size = F.aggregate("__cut", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    joined = joined.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return joined.withColumn("__cut_lines", F.coalesce(F.when(F.col("__cut").isNotNull(), size), F.lit(0))).drop("__cut")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cleaned(docs).withColumnRenamed("__cut_lines", "lines_removed")


_SPACES = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
ORACLE = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, n, trim(line, {_SPACES}) AS s FROM raw WHERE trim(line, {_SPACES}) <> ''),
c AS (SELECT doc_id, n, s, len(regexp_split_to_array(s, '[\\t\\x0b\\x0c\\r ]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM t),
cw AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM c),
whole AS (SELECT doc_id, list(s ORDER BY i) AS own FROM c GROUP BY 1),
pairs AS (SELECT a.doc_id, a.n AS first, b.n AS last, a.i AS i, b.i AS j FROM cw a JOIN cw b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.w >= {WORDS}
  AND (b.upto - b.w - a.upto + a.w < {WORDS} OR b.upto - a.upto < {WORDS})),
keyed AS (SELECT p.doc_id, first, last, own[i:j] AS key FROM pairs p JOIN whole USING (doc_id)),
origin AS (SELECT key, min((doc_id, first)) AS o FROM keyed GROUP BY key),
later AS (SELECT doc_id, first, last FROM keyed JOIN origin USING (key) WHERE (doc_id, first) > o),
cut AS (SELECT DISTINCT r.doc_id, r.n FROM raw r JOIN later l ON r.doc_id = l.doc_id AND r.n BETWEEN l.first AND l.last),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.n) FILTER (WHERE cut.n IS NULL) AS left_over, count(cut.n) AS gone FROM raw r LEFT JOIN cut ON r.doc_id = cut.doc_id AND r.n = cut.n GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(gone, 0) = 0 THEN text ELSE coalesce(left_over, '') END AS text, CAST(coalesce(gone, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept USING (doc_id)"""
