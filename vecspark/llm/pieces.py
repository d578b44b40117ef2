"""Operator 8: sampled SentencePiece segmentations, reproducible by row, with lossless decoding.

Segmentations are drawn from the lattice of all pieces by forward filtering (the log-sum of all paths up to each byte) and
backward sampling (from the end, a piece with the probability that paths end in it). Random numbers are a hash of the
seed, ``doc_id``, the unit's number in its text and the step: the same whatever the partitioning, retry or machine.

No piece crosses the beginning of white space or a line break, so the lattice falls apart there into units; equal units
of a batch share one lattice and its filter, and all occurrences are sampled in lockstep by NumPy. The model holds merge
ranks instead of probabilities: a piece of rank r weighs (r + 10) ** -``ALPHA``, byte pieces less than any other.

Decoding is lossless for every string, white space and U+2581 included: a space is put before each text (the model's
dummy prefix) and taken off again; nothing is normalised; a character without a piece of its own becomes byte pieces.
Each batch is decoded again and compared with its texts; a difference raises an error.

Units count as equal only byte for byte. Defined cases: an empty table gives an empty one; a null text gives null ids and 0 pieces; the empty text has the one piece of the dummy prefix; texts of any
length are encoded whole; a null ``doc_id`` is a key of its own; repeated rows get equal ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import text as X

MODEL, ALPHA, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 1
MODEL_SETTING, CHUNK = "spark.vecspark.pieces.model", 3 << 19
SCHEMA = "doc_id long, ids array<int>, n_pieces int, lossless boolean"
WIDTHS = np.zeros(256, dtype=np.int64)  # bytes of a character by its first
WIDTHS[:128], WIDTHS[192:224], WIDTHS[224:240], WIDTHS[240:] = 1, 2, 3, 4
_SPREAD = X.U(0x9E3779B97F4A7C15)


class Pieces:
    """The model's pieces as byte strings, their weights, and tables to look them up by hash."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw: list[bytes] = []
        self.byte = np.full(256, -1, dtype=np.int32)
        self.logp = np.full(n, -alpha * np.log(n + 10.0) - 3)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw.append(bytes([int(piece[1:-1], 16)]))
                self.byte[raw[-1][0]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(piece.replace("▁", " ").encode())
                normal.append(i)
                self.logp[i] = -alpha * np.log(min(-model.get_score(i), n) + 10.0)
        self.size = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        own = np.array(normal)
        h = _span(self.bytes, self.start[own], self.start[own] + self.size[own])
        self.longest = int(self.size[own].max())
        self.seen = np.zeros(1 << 21, dtype=np.uint8)  # 1: of a piece, 2: of the beginning of a longer one
        for length in range(1, self.longest + 1):
            for flag, some in ((1, own[self.size[own] == length]), (2, own[self.size[own] > length])):
                key = _span(self.bytes, self.start[some], self.start[some] + length) + X.U(length)
                self.seen[(key * _SPREAD) >> X.U(43)] |= flag
        self.tables = {}
        for size in np.unique(self.size[own]):
            at = self.size[own] == size
            order = np.argsort(h[at])
            self.tables[int(size)] = (h[at][order], own[at][order].astype(np.int32))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, one after the other."""
        size = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            t = np.full(max(CHUNK + 1, n), base, dtype=X.U)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=X.U)
    return _tables["pow"], _tables["inv"]


def _span(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of spans of a few bytes (pieces have at most some dozens) from prefix sums of a polynomial."""
    cs, inv = _sums(buf)
    return (cs[b] - cs[a]) * inv[a]


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pw, inv = _powers(len(buf) + 1)
    cs = np.zeros(len(buf) + 1, dtype=X.U)
    np.cumsum((buf.astype(X.U) + X.U(1)) * pw[: len(buf)], out=cs[1:])
    return cs, inv


class Lattice:
    """Edges of many units, grouped by the node where they end, and the sampling distribution of each node.

    A node is the place after k bytes of a unit. Units are ranked by falling length, and nodes numbered by k, then by
    rank: so the nodes and edges of one step of the filter lie side by side, and nothing has to be sorted."""

    def __init__(self, pieces: Pieces, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        size = np.diff(offs)
        units, longest = len(size), int(size.max()) if len(size) else 0
        rank = np.empty(units, dtype=np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(units)
        alive = np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1]  # units of k bytes and more
        base = np.append(0, np.cumsum(alive))
        self.first, self.last = rank, base[size] + rank
        unit = np.repeat(np.arange(units), size)
        k = np.arange(n) - offs[unit]
        rank, rest = rank[unit], offs[unit + 1] - np.arange(n)
        cs, inv = _sums(buf)
        width = WIDTHS[buf]
        bare = width > 0
        edges = []
        at = np.arange(n)
        for length in range(1, pieces.longest + 1):
            at = at[rest[at] >= length]
            if len(at) == 0:
                break
            h = (cs[at + length] - cs[at]) * inv[at]
            flags = pieces.seen[((h + X.U(length)) * _SPREAD) >> X.U(43)]
            if length in pieces.tables:
                hashes, ids = pieces.tables[length]
                some = np.flatnonzero(flags & 1)
                j = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
                hit = hashes[j] == h[some]
                p = at[some[hit]]
                edges.append((p, length, ids[j[hit]]))
                bare[p[width[p] == length]] = False
            at = at[flags >= 2]
        lone = np.flatnonzero(bare)
        for j in range(4):
            p = lone[width[lone] > j] + j
            edges.append((p, 1, pieces.byte[buf[p]]))
        nodes = int(base[-1])
        ends = [base[k[p] + length] + rank[p] for p, length, _ in edges]
        degree = np.zeros(nodes, dtype=np.int64)
        for e in ends:
            degree[e] += 1  # one piece of each length ends in a node
        self.tail = np.cumsum(degree)
        self.head = self.tail - degree
        fill = self.head.copy()
        self.source = np.empty(int(degree.sum()), dtype=np.int64)
        self.piece = np.empty(len(self.source), dtype=np.int32)
        for e, (p, _, ids) in zip(ends, edges, strict=True):
            self.source[fill[e]] = base[k[p]] + rank[p]
            self.piece[fill[e]] = ids
            fill[e] += 1
        logp = pieces.logp[self.piece]
        self.alpha = np.full(nodes, -np.inf)  # no path ends within a character that has a piece
        self.alpha[: base[1]] = 0.0
        self.upto = np.empty(len(logp))
        for step in range(1, longest + 1):
            lo, hi = self.head[base[step]], self.tail[base[step + 1] - 1]
            own = base[step] + np.flatnonzero(degree[base[step] : base[step + 1]])
            if len(own) == 0:
                continue
            head, count = self.head[own] - lo, degree[own]
            a = self.alpha[self.source[lo:hi]] + logp[lo:hi]
            top = np.maximum.reduceat(a, head)
            w = np.exp(a - np.repeat(top, count))
            total = np.add.reduceat(w, head)
            self.alpha[own] = top + np.log(total)
            cum = np.cumsum(w)
            self.upto[lo:hi] = (cum - np.repeat(cum[head] - w[head], count)) / np.repeat(total, count)

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pieces of each occurrence) of occurrences of units; key seeds each."""
        node = self.last[unit].copy()
        alive = np.arange(len(unit))
        count = np.zeros(len(unit), dtype=np.int64)
        done = []
        step = 0
        while len(alive):
            u = (X.mix(key[alive] + X.U(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> X.U(11)).astype(np.float64) * 2.0**-53
            now = node[alive]
            e, last = self.head[now], self.tail[now] - 1
            more = np.flatnonzero((e < last) & (u >= self.upto[e]))
            while len(more):
                e[more] += 1
                more = more[(e[more] < last[more]) & (u[more] >= self.upto[e[more]])]
            done.append((alive, self.piece[e]))
            count[alive] += 1
            node[alive] = self.source[e]
            alive = alive[node[alive] != self.first[unit[alive]]]
            step += 1
        ends = np.cumsum(count)
        ids = np.empty(int(count.sum()), dtype=np.int32)
        for k, (who, piece) in enumerate(done):
            ids[ends[who] - 1 - k] = piece
        return ids, count


def spaced(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the dummy prefix."""
    rows = len(offs) - 1
    out = np.full(len(buf) + rows, 32, dtype=np.uint8)
    mask = np.ones(len(out), dtype=bool)
    mask[offs[:-1] + np.arange(rows)] = False
    out[mask] = buf
    return out, offs + np.arange(rows + 1)


def encode(pieces: Pieces, buf: np.ndarray, offs: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, pieces of each row) of one chunk of texts; keys are hashes of the rows' keys."""
    rows = len(offs) - 1
    text, at = spaced(buf, offs)
    space, line = text == 32, text == 10
    begin = line.copy()
    begin[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    begin[at[:-1]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(text))
    row = np.searchsorted(at, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
    h = X.span_hash(text, start, end)
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    if not _same(text, start[order], end[order], new):  # units of one hash that differ share nothing
        new[:] = True
    unit = np.cumsum(new) - 1
    u0, u1 = start[order[new]], end[order[new]]
    size = u1 - u0
    uoffs = np.concatenate([[0], np.cumsum(size)])
    ubuf = text[np.repeat(u0 - uoffs[:-1], size) + np.arange(uoffs[-1])]
    lattice = Lattice(pieces, ubuf, uoffs)
    key = X.mix(keys[row[order]] + X.U(seed * 0xD1B54A32D192ED03 & (2**64 - 1))) + X.mix(number[order].astype(X.U) + X.U(1))
    ids, count = lattice.sample(unit, key)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))
    first = (np.cumsum(count) - count)[where]
    count = count[where]
    ids = ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(ids))]
    if not np.array_equal(pieces.decode(ids), text):
        raise ValueError("decoding didn't give the texts back")
    return ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)


def _same(text: np.ndarray, start: np.ndarray, end: np.ndarray, new: np.ndarray) -> bool:
    """Whether each span equals, byte for byte, the last one before it that is marked as new."""
    size = end - start
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    if (size != size[first]).any():
        return False
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool(np.array_equal(text[np.repeat(start, size) + within], text[np.repeat(start[first], size) + within]))


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of one row's pieces."""
    return pieces.decode(np.array(ids, dtype=np.int64)).tobytes()[1:].decode("utf-8")


def encoded(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of every row; ``path`` of the model, else that of the setting ``MODEL_SETTING``, else ``MODEL``."""
    path = path or docs.sparkSession.conf.get(MODEL_SETTING, MODEL)
    shipped = docs.sparkSession.sparkContext.broadcast(Pieces(path, alpha))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            buf, offs = X.utf8(b.column(1))
            keys = np.asarray(b.column(0).fill_null(-(2**62)))
            null = np.asarray(b.column(1).is_null())
            for i, j in X.chunks(offs, CHUNK):
                ids, count = encode(own, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], X.key_hash(keys[i:j]), seed)
                gone = null[i:j]
                if gone.any():
                    ids, count = ids[np.repeat(~gone, count)], np.where(gone, 0, count)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids), mask=pa.array(gone))
                cols = [b.column(0).slice(i, j - i), lists, pa.array(count.astype(np.int32)), pa.array(np.ones(j - i, dtype=bool))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_pieces", "lossless"])

    return X.id_text(docs).mapInArrow(scan, SCHEMA)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
