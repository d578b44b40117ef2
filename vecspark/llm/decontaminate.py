"""Operator 1: benchmark passages in training documents, found by spaced-seed hashing.

A document holds a passage of a benchmark item where, token for token on one diagonal, a window of 13 tokens differs in
at most 2 (an item of 5 to 12 tokens: where all of it agrees; items under 5 tokens are no evidence and never match).
Overlapping windows of a diagonal make one region: one result row.

*Search, exact.* Two masks of six positions out of nine are lossless here: however two of 13 tokens are replaced, one of
the masks still fits somewhere on kept positions. Hashes of the benchmark under the masks are joined with those of each
document position, and every hit is verified on the whole diagonal. The benchmark is shipped to the executors in slices
of at most ``SLICE`` postings; a benchmark of any size takes more slices, each one scan, never a larger broadcast. The
documents are read as they lie: no shuffle.

Defined cases: rows without ``doc_id`` or ``item_id`` are left out; null and empty texts and empty tables match nothing; texts
of any length are read whole, hits of repetitive ones in blocks of bounded size, with one row for each diagonal that has a
region; several items or places that match alike each give their rows, so there are no ties to break; repeated rows give their result once; other columns are ignored; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X

WINDOW, MISMATCHES, LEAST = 13, 2, 5
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 6, 7, 8))
SHORT = (0, 1, 2, 3, 4)
SLICE, HITS = 2_000_000, 1 << 20
SCHEMA = "doc_id long, item_id long, doc_token long, item_token long, n_tokens long, n_mismatches long"
_FACTOR = [X.U(0xD6E8FEB86659FD93 * (2 * k + 3) & (2**64 - 1) | 1) for k in range(16)]


def seeds(tokens: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the mask at every position where it fits."""
    n = max(0, len(tokens) - mask[-1])
    h = np.full(n, X.U(salt + 1) * X.U(0xA24BAED4963EE407 & (2**62 - 1)), dtype=X.U)
    for k, o in enumerate(mask):
        h += tokens[o : o + n] * _FACTOR[k]
    return h


class Slice:
    """Postings of some benchmark items: sorted hashes, with a bit table before them."""

    def __init__(self, items: list[tuple[int, str]]):
        tokens = [(i, X.token_hashes(t)) for i, t in items if i is not None and t]
        tokens = [(i, t) for i, t in tokens if len(t) >= LEAST]
        self.ids = np.array([i for i, _ in tokens], dtype=np.int64)
        self.tokens = [t for _, t in tokens]
        self.masks = list(enumerate(MASKS)) + [(len(MASKS), SHORT)] * any(len(t) < WINDOW for t in self.tokens)
        found = [(seeds(t, m, s), k) for s, m in self.masks for k, t in enumerate(self.tokens) if (len(t) < WINDOW) == (m is SHORT)]
        h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, X.U)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate([np.full(len(x), k) for x, k in found])[order] if found else np.zeros(0, np.int64)
        self.pos = np.concatenate([np.arange(len(x)) for x, _ in found])[order] if found else np.zeros(0, np.int64)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(h)) * 32))))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[X.mix(self.hash) >> X.U(64 - self.bits)] = True

    def regions(self, doc: np.ndarray, item: int, diagonal: int) -> Iterator[tuple[int, int, int, int]]:
        """(doc token, item token, tokens, mismatches) of the regions on one diagonal: doc token - item token."""
        own = self.tokens[item]
        lo, hi = max(0, diagonal), min(len(doc), diagonal + len(own))
        off = doc[lo:hi] != own[lo - diagonal : hi - diagonal]
        n = WINDOW if len(own) >= WINDOW else len(own)
        allowed = MISMATCHES if len(own) >= WINDOW else 0
        if hi - lo < n:
            return
        total = np.concatenate([[0], np.cumsum(off)])
        good = np.flatnonzero(total[n:] - total[:-n] <= allowed)
        for part in np.split(good, np.flatnonzero(np.diff(good) > n) + 1) if len(good) else ():
            a, b = int(part[0]), int(part[-1]) + n
            yield lo + a, lo + a - diagonal, b - a, int(total[b] - total[a])

    def search(self, first: np.ndarray, tokens: np.ndarray) -> Iterator[tuple]:
        """(row, item id, ...) of all regions in the rows whose tokens are tokens[first[r]:first[r + 1]]."""
        span = int(len(tokens) + max((len(t) for t in self.tokens), default=0) + 1)  # of diagonals
        keys = np.zeros(0, np.int64)
        for salt, mask in self.masks:
            h = seeds(tokens, mask, salt)
            at = np.flatnonzero(self.seen[X.mix(h) >> X.U(64 - self.bits)])
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + mask[-1] < first[row + 1]
            at, lo, n, row = at[inside], lo[inside], n[inside], row[inside]
            ends = np.cumsum(n)
            i = 0
            while i < len(at):  # blocks of bounded size, each reduced to its diagonals: repetitive texts hit over and over
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
                size = n[i:j]
                k = np.repeat(lo[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                diagonal = np.repeat(at[i:j] - first[row[i:j]], size) - self.pos[k] + span
                keys = np.union1d(keys, (np.repeat(row[i:j], size) * len(self.ids) + self.item[k]) * (2 * span) + diagonal)
                i = j
        for key in keys.tolist():
            row, item, diagonal = key // (2 * span) // len(self.ids), key // (2 * span) % len(self.ids), key % (2 * span) - span
            for r in self.regions(tokens[first[row] : first[row + 1]], item, diagonal):
                yield (row, self.ids[item], *r)


def slices(benchmark: DataFrame) -> Iterator[Slice]:
    """The benchmark in slices of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + letters * len(MASKS) // 2 // SLICE
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Slice([(r.item_id, r.text) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All regions of ``docs`` that hold passages of ``benchmark``."""
    spark = docs.sparkSession
    found = None
    for one in slices(benchmark):
        shipped = spark.sparkContext.broadcast(one)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            own = shipped.value
            for b in batches:
                ids = np.asarray(b.column(0))
                buf, offs = X.utf8(b.column(1))
                rows: list[tuple] = []
                for i, j in X.chunks(offs):
                    t = X.Tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    rows += [(ids[i + r], *rest) for r, *rest in own.search(t.first, t.hash)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_mismatches"])

        part = X.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, SCHEMA)
        found = part if found is None else found.union(part)
    return found.distinct()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
