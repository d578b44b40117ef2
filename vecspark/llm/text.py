"""Vectorised text kernels shared by the corpus operators.

Arrow string columns are read as one UTF-8 byte buffer, so tokenising and hashing run as NumPy passes over bytes instead
of Python loops over words. A *token* is a maximal run of letters and digits: ASCII alphanumerics and every non-ASCII
byte except general punctuation (U+2000-U+206F) and the Latin-1 signs (U+0080-U+00BF). Tokens are compared in lower case
(ASCII and Latin-1 letters). Null texts count as empty texts. Texts of any length are processed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
LONG_SPAN = 64
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)  # the first k of eight bytes


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, in place where possible."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(buf: np.ndarray) -> np.ndarray:
    low = LOWER[buf]
    c3 = np.flatnonzero(buf[:-1] == 0xC3)
    if len(c3):
        nxt = buf[c3 + 1]
        low[c3[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1] += 0x20
    return low


def word_mask(buf: np.ndarray) -> np.ndarray:
    word = WORD[buf]
    c2 = np.flatnonzero(buf[:-1] == 0xC2)
    word[c2] = word[c2 + 1] = False
    e2 = np.flatnonzero(buf[:-2] == 0xE2)
    if len(e2):
        nxt, last = buf[e2 + 1], buf[e2 + 2]
        e2 = e2[(nxt == 0x80) | ((nxt == 0x81) & (last <= 0xAF))]
        word[e2] = word[e2 + 1] = word[e2 + 2] = False
    return word


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True; a run never crosses a row's border."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~prev | cut[:-1]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~nxt | cut[1:])) + 1
    return starts, ends


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes of all spans at a time are mixed in; spans over ``LONG_SPAN`` bytes one by one.

    Every step is a bijection of the state, so no family of strings collides by its structure."""
    size = ends - starts
    h = mix(size.astype(U) + U(_BASE))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    alive = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left, state = starts[alive], size[alive], h[alive]
    while len(alive):
        state = mix(state ^ (words[at] & _HEAD[np.minimum(left, 8)])) * U(_BASE)
        more = left > 8
        h[alive[~more]] = state[~more]
        alive, at, left, state = alive[more], at[more] + 8, left[more] - 8, state[more]
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        h[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : ends[k]])
    return h


class Tokens:
    """Tokens of one chunk: hash, row, byte start and end; ``first[r]:first[r + 1]`` are those of row r."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.low = lower(buf)
        self.start, self.end = runs(word_mask(buf), offs)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = span_hash(self.low, self.start, self.end)


def token_hashes(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return Tokens(buf, np.array([0, len(buf)])).hash


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15))


def char_index(buf: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """Character positions, from ``base`` bytes on, of byte positions."""
    lead = np.concatenate([[0], np.cumsum((buf[base:] & 0xC0) != 0x80)])
    return lead[at - base]


def batch(rows: int, schema: pa.Schema, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only in local mode, where there are no other machines, may it be unset: then it lies in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').removeprefix('file:')}/checkpoints"
    return at


def _filesystem(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_at_exit(spark: SparkSession, path: str) -> None:
    system, at = _filesystem(spark, path)
    system.deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives the loss of any executor.

    The folder goes with ``discard``, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            system, at = _filesystem(df.sparkSession, path)
            system.delete(at, True)


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the kernels need: extra columns, whatever their names, never reach them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
