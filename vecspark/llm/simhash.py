"""Operator 10: SimHash near-duplicates found by pigeonring filtering.

*Signature.* A document's features cover all of its text: whole tokens of up to 24 bytes, and of longer tokens and those in scripts of three bytes and more a character (Chinese,
Japanese, Thai, ...), which may be whole sentences, all character n-grams (3 where there are ideographs or kana, else 6; 12
in long tokens of other scripts). They are weighted 1 + ln(count); signed random projections give three independent rings
of 242 bits. *Near-duplicates* are documents that differ in at most 32 bits of some ring (the README has the shares of
copies found by the share of other words); groups are the connected components of that relation, and the smallest
``doc_id`` of a group is its representative.

*Search, exact.* A ring has 11 segments of 22 bits. By the pigeonring principle any pair within 32 bits has
a segment from which every chain of 1, 2, ... following segments stays within its proportional budget (2, 5, 8, 11, ...
bits). A first segment differing in at most two bits agrees on one of three parts of it (8, 7 and 7 bits), so each signature
is sent to 99 buckets (ring, segment, part, its bits): a constant number of rows a document, spread over as many tasks as
the rows need. A task reads its buckets in order and holds few of them at a time. Inside a bucket a table of
the other bits gives the partners of each of the 254 patterns of up to two bits, each pattern in the first part that it
leaves alone; they are pruned by the 64 bits that follow, which the chain of four segments contains, then by the chain
budgets, and then checked on the full signature. Pairs already known to be
connected are not checked again; nothing is capped. Equal signatures are merged beforehand and never sent twice.

Defined cases: null and empty texts belong to no group. A text without any token is one feature (the whole text). Texts of
any length count whole. An empty table has no groups. Rows
without ``doc_id`` belong to no group. Rows repeated under one ``doc_id`` are one document, also if their texts differ. Other columns are ignored.
A pair of unrelated documents meets in a bucket's table some 0.05 times, so that the pruning's work grows
with the square of the documents beside the linear rest (the README has both in figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X

RINGS, SEGMENTS, WIDTH, LIMIT, CHAIN = 3, 11, 22, 32, 4
LONG, GRAM_IDEOGRAPHS, GRAM_OTHERS, GRAM_LONG = 24, 3, 6, 12
SLICE, TASK_ROWS, HELD_ROWS = 1 << 18, 1 << 19, 1 << 18
SIDE, SQUARES, WAITING = 8, 1 << 10, 1 << 12
PARTS = ((14, 8), (7, 7), (0, 7))  # shift and width of the parts of a segment
PART_BITS, REST_BITS = max(w for _, w in PARTS), WIDTH - min(w for _, w in PARTS)
RING_BITS = SEGMENTS * WIDTH
RING_BYTES = -(-RING_BITS // 8)
BYTES = RINGS * RING_BYTES
BUDGET = [length * LIMIT // SEGMENTS for length in range(1, SEGMENTS + 1)]
_SIGN = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1
_SALT = [X.U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(-(-BYTES // 8))]


def _inside(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are in the mask."""
    upto = np.concatenate([[0], np.cumsum(mask)])
    return upto[end] - upto[start]


def features(t: X.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature: tokens, and character n-grams of long and unspaced ones."""
    size = t.end - t.start
    broad = _inside(t.low >= 0xE0, t.start, t.end) > 0
    split = broad | (size > LONG)
    some = np.flatnonzero(split)
    if len(some) == 0:
        return t.row, t.hash
    ideographs = _inside((t.low >= 0xE3) & (t.low <= 0xE9) | (t.low >= 0xF0), t.start[some], t.end[some]) > 0
    gram = np.where(ideographs, GRAM_IDEOGRAPHS, np.where(broad[some], GRAM_OTHERS, GRAM_LONG))
    lead = np.append(np.flatnonzero((t.low & 0xC0) != 0x80), len(t.low))  # first bytes of the characters
    a, b = np.searchsorted(lead, t.start[some]), np.searchsorted(lead, t.end[some])
    n = np.maximum(1, b - a - gram + 1)
    at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, end = lead[at], lead[np.minimum(at + np.repeat(gram, n), np.repeat(b, n))]
    return np.concatenate([t.row[~split], np.repeat(t.row[some], n)]), np.concatenate([t.hash[~split], X.span_hash(t.low, start, end)])


def signatures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Signatures, rows x BYTES, of one chunk of texts."""
    rows = len(offs) - 1
    t = X.Tokens(buf, offs)
    row, h = features(t)
    bare = np.flatnonzero((np.diff(t.first) == 0) & (np.diff(offs) > 0))
    if len(bare):
        row = np.concatenate([row, bare])
        h = np.concatenate([h, X.span_hash(buf, offs[bare], offs[bare + 1])])
    key = np.sort((row.astype(X.U) << X.U(48)) | (h >> X.U(16)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    row = (key >> X.U(48)).astype(np.int64)
    weight = np.rint(16 * (1 + np.log(count)))  # whole numbers: sums are exact in any order
    key = key & X.U((1 << 48) - 1)
    total = np.zeros((BYTES, rows, 8))
    for lo in range(0, len(key), SLICE):
        part = slice(lo, lo + SLICE)
        planes = np.stack([X.mix(key[part] + s) for s in _SALT], axis=1).view(np.uint8)
        base = row[part] * 256
        for b in range(BYTES):
            total[b] += np.bincount(base + planes[:, b], weights=weight[part], minlength=rows * 256).reshape(rows, 256) @ _SIGN
    sig = np.packbits(total > 0, axis=2)[:, :, 0].T.copy()
    sig[:, RING_BYTES - 1 :: RING_BYTES] &= 256 - (1 << (8 * RING_BYTES - RING_BITS))  # bits beyond a ring's last segment
    return sig


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = X.utf8(b.column(1))
        ids = np.asarray(b.column(0))
        for lo in range(0, len(ids), 2048):
            hi = min(lo + 2048, len(ids))
            for i, j in X.chunks(offs[lo : hi + 1]):
                i, j = i + lo, j + lo
                sig = signatures(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                full = np.diff(offs[i : j + 1]) > 0
                packed = pa.array([bytes(x) for x in sig[full]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][full]), packed], names=["doc_id", "sig"])


def signed(docs: DataFrame) -> DataFrame:
    return X.id_text(docs).where("doc_id IS NOT NULL AND length(text) > 0").mapInArrow(_sign, "doc_id long, sig binary")


def segments(sig: np.ndarray) -> np.ndarray:
    """RING_BYTES bytes to SEGMENTS numbers of WIDTH bits, each of which lies within four bytes."""
    out = np.empty((len(sig), SEGMENTS), dtype=np.uint32)
    for k in range(SEGMENTS):
        at = min(k * WIDTH // 8, RING_BYTES - 4)
        four = np.ascontiguousarray(sig[:, at : at + 4]).view(">u4")[:, 0].astype(np.uint32)
        out[:, k] = four >> np.uint32(32 + 8 * at - (k + 1) * WIDTH) & np.uint32((1 << WIDTH) - 1)
    return out


def rest(x: np.ndarray, part: int) -> np.ndarray:
    """The bits of segments without those of the part."""
    shift, width = PARTS[part]
    return (x >> (shift + width)) << shift | x & ((1 << shift) - 1)


def _patterns(part: int) -> list[int]:
    """The patterns of up to ``LIMIT // SEGMENTS`` bits that leave this part of a segment alone, but none before it; without the part."""
    few = [sum(1 << b for b in bits) for n in range(LIMIT // SEGMENTS + 1) for bits in combinations(range(WIDTH), n)]
    own = [[x >> shift & ((1 << width) - 1) for shift, width in PARTS] for x in few]
    return [int(rest(x, part)) for x, parts in zip(few, own, strict=True) if not parts[part] and all(parts[:part])]


def _raw(col: pa.Array, size: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``size`` bytes."""
    if len(col) == 0:
        return np.zeros((0, size), np.uint8)
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return np.frombuffer(col.buffers()[2], np.uint8)[start : start + len(col) * size].reshape(-1, size)


def _binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = _raw(b.column(1), BYTES)
        for ring in range(RINGS):
            own = np.ascontiguousarray(sig[:, ring * RING_BYTES : (ring + 1) * RING_BYTES])
            seg, own = segments(own), _binary(own)
            for s in range(SEGMENTS):
                for part, (shift, width) in enumerate(PARTS):
                    bucket = ((ring * SEGMENTS + s) * len(PARTS) + part) << PART_BITS | seg[:, s] >> shift & ((1 << width) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), b.column(0), own], names=["bucket", "id", "sig"])


_PATTERNS = [_patterns(part) for part in range(len(PARTS))]


class Components:
    """Union-find over 0..n-1 in NumPy; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[x] = r
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _within(seg: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray, known: Components) -> np.ndarray:
    """Which of the pairs a, b, unless known to be connected, stay within the budgets of the chain from segment ``at`` on, and within LIMIT in all."""
    keep = np.arange(len(a))
    total = np.zeros(len(a), dtype=np.int64)
    for length in range(SEGMENTS):
        s = (at[keep] + length) % SEGMENTS
        total = total + np.bitwise_count(seg[a[keep], s] ^ seg[b[keep], s])
        if length < CHAIN:
            ok = total <= BUDGET[length]
            if length == 1:
                ok[ok] = known.find(node[a[keep[ok]]]) != known.find(node[b[keep[ok]]])
            keep, total = keep[ok], total[ok]
    return keep[total <= LIMIT]


def link(bucket: np.ndarray, node: np.ndarray, seg: np.ndarray, known: Components, block: int = 1 << 19, together: int = 64) -> None:
    """Connects, in ``known``, the nodes of near signatures that share a bucket; ``together`` buckets share a table."""
    part = (bucket >> PART_BITS) % len(PARTS)
    s = (bucket >> PART_BITS) // len(PARTS) % SEGMENTS
    own = seg[np.arange(len(s)), s].astype(np.int64)
    for p in range(len(PARTS)):
        mine = np.flatnonzero(part == p)
        names, number, size = np.unique(bucket[mine], return_inverse=True, return_counts=True)
        mine, number = mine[size[number] > 1], number[size[number] > 1]
        key = number << REST_BITS | rest(own[mine], p)
        order = np.argsort(key, kind="stable")
        key, mine = key[order], mine[order]
        for lo in range(0, len(names), together):
            i, j = np.searchsorted(key, [lo << REST_BITS, (lo + together) << REST_BITS])
            if j - i > 1:
                _join(key[i:j] - (lo << REST_BITS), p, node[mine[i:j]], s[mine[i:j]], seg[mine[i:j]], min(together, len(names) - lo) << REST_BITS, known, block)


def _look(seg: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The 64 bits that follow each row's segment ``s``: two segments and most of a third."""
    every = np.arange(len(s))
    out = seg[every, (s + 1) % SEGMENTS].astype(X.U)
    for k, bits in ((2, WIDTH), (3, 64 - 2 * WIDTH)):
        out = out << X.U(bits) | (seg[every, (s + k) % SEGMENTS] >> (WIDTH - bits)).astype(X.U)
    return out


def _expand(who: np.ndarray, lo: np.ndarray, n: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each ``who`` with the ``n`` numbers from ``lo`` on, at most ``block`` at a time."""
    ends = np.cumsum(n, dtype=np.int64)
    i, cut = 0, 0  # of who[i] the first ``cut`` are done
    while i < len(who):
        done = int(ends[i - 1] if i else 0) + cut
        j = int(np.searchsorted(ends, done + block, "right"))
        if j == i:
            yield np.full(block, who[i]), np.arange(lo[i] + cut, lo[i] + cut + block, dtype=np.int32)
            cut += block
            continue
        size = n[i:j].copy()
        size[0] -= cut
        first = lo[i:j].astype(np.int64)
        first[0] += cut
        yield np.repeat(who[i:j], size), (np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())).astype(np.int32)
        i, cut = j, 0


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range of ``n``, one range after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _join(key: np.ndarray, part: int, node: np.ndarray, s: np.ndarray, seg: np.ndarray, keys: int, known: Components, block: int) -> None:
    """``link`` of some buckets whose rows are sorted by ``key`` (bucket, other bits), a number under ``keys``.

    Keys are looked up once each, not once a row. Rows of a key are also laid out in squares' sides of ``SIDE`` rows: of keys with
    several rows, whole sides are compared with each other, which costs a tenth of gathering the rows of each pair. Pairs that
    pass are verified ``WAITING`` at a time."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    names = key[first]
    place = np.full(keys, -1, dtype=np.int32)
    place[names] = np.arange(len(names))
    look = _look(seg, s)
    sides = np.where(n >= SIDE // 2, -(-n // SIDE), 0)
    side = np.cumsum(sides) - sides
    tall = sides > 0
    row = np.full((int(sides.sum()), SIDE), -1, dtype=np.int32)
    row.reshape(-1)[_ranges(side[tall] * SIDE, n[tall])] = _ranges(first[tall], n[tall])
    there = row >= 0
    square = np.ascontiguousarray(np.where(there, look[row], X.U(0)).T)  # sides run along the last axis, so that steps on many of them are long
    one = np.full(len(row), -1, dtype=np.int64)  # the root of sides whose rows are all connected
    hits = 0
    space = np.empty(SQUARES * SIDE**2, dtype=X.U)
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by bit: the keys without it
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def connect(a: np.ndarray, b: np.ndarray, far: np.ndarray, bits: int) -> None:
        """Takes pairs that differ by ``far`` in what was looked at and in ``bits`` before, unless the chains of two or three segments rule them out."""
        nonlocal held
        ok = np.bitwise_count(far >> X.U(64 - WIDTH)) <= BUDGET[1] - bits
        ok &= np.bitwise_count(far >> X.U(64 - 2 * WIDTH)) <= BUDGET[2] - bits
        if ok.any():
            waiting.append((a[ok], b[ok]))
            held += len(waiting[-1][0])
        if held >= WAITING:
            settle()

    def settle() -> None:
        nonlocal held
        if waiting:
            a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
            ok = _within(seg, s[a], a, b, node, known)
            known.union(node[a[ok]], node[b[ok]])
            waiting.clear()
            held = 0

    for x in _PATTERNS[part]:
        bits = x.bit_count()
        most = BUDGET[CHAIN - 1] - bits  # of the bits looked at, no more than of the chain they are part of
        if x == 0:
            u = v = np.flatnonzero(n > 1)
        else:
            top = x.bit_length() - 1
            if top not in lower:
                u = np.flatnonzero(names >> top & 1 == 0)
                lower[top] = u, names[u]
            u, own = lower[top]  # each pair once
            v = place.take(own ^ x)
            both = np.flatnonzero(v >= 0)
            u, v = u.take(both), v.take(both)
        dense = tall.take(u) & tall.take(v)
        at = np.flatnonzero(dense)
        i, j = u[at], v[at]
        dense[at] = n[i] * n[j] * 4 >= sides[i] * sides[j] * SIDE**2
        few, other = u[~dense], v[~dense]
        rows = n.take(few)
        who = _ranges(first.take(few), rows)
        if x == 0:
            lo, size = who + 1, np.repeat(first[few] + rows, rows) - who - 1
            some = size > 0
            who, lo, size = who[some], lo[some], size[some]
        else:
            lo, size = np.repeat(first.take(other), rows), np.repeat(n.take(other), rows)
        for a, b in _expand(who, lo, size, block):
            far = look.take(a) ^ look.take(b)
            ok = np.flatnonzero(np.bitwise_count(far) <= most)
            if len(ok):
                connect(a[ok], b[ok], far[ok], bits)
        u, v = u[dense], v[dense]
        who = _ranges(side[u], sides[u])
        if x == 0:
            lo, size = who, np.repeat(side[u] + sides[u], sides[u]) - who
        else:
            lo, size = np.repeat(side[v], sides[u]), np.repeat(sides[v], sides[u])
        for p, q in _expand(who, lo, size, SQUARES):
            mine = one.take(p)
            apart = np.flatnonzero((mine != one.take(q)) | (mine < 0))
            p, q = p[apart], q[apart]
            far = space[: len(p) * SIDE**2].reshape(SIDE, SIDE, len(p))
            np.bitwise_xor(square.take(p, axis=1)[:, None, :], square.take(q, axis=1)[None, :, :], out=far)
            far = far.reshape(-1)
            hit = np.flatnonzero(np.bitwise_count(far) <= most)
            if len(hit) == 0:
                continue
            of, k = hit // len(p), hit % len(p)
            a, b = row[p[k], of // SIDE], row[q[k], of % SIDE]
            real = (a >= 0) & (b >= 0) & ((a < b) | (x != 0))
            connect(a[real], b[real], far[hit[real]], bits)
            hits += len(k)
            if hits > row.size:  # as much as this costs: large groups, whose pairs needn't all be met
                hits = 0
                settle()
                root = known.find(node[row[:, 0]])
                one = np.where(((known.find(node[row.reshape(-1)]).reshape(row.shape) == root[:, None]) | ~there).all(axis=1), root, -1)
    settle()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of some whole buckets at a time, from rows sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        bucket, ids, sig = np.asarray(b.column(0)), np.asarray(b.column(1)), _raw(b.column(2), RING_BYTES)
        if rows >= HELD_ROWS and len(bucket):
            ends = int(np.searchsorted(bucket, held[-1][0][-1], "right"))
            held.append((bucket[:ends], ids[:ends], sig[:ends]))
            if ends == len(bucket):
                rows += ends
                continue
            yield from _flush(held)
            held, rows = [], 0
            bucket, ids, sig = bucket[ends:], ids[ends:], sig[ends:]
        held.append((bucket, ids, sig))
        rows += len(bucket)
    yield from _flush(held)


def _flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    bucket, ids, sig = (np.concatenate(x) for x in zip(*held, strict=True))
    every, node = np.unique(ids, return_inverse=True)
    known = Components(len(every))
    link(bucket.astype(np.int64), node, segments(sig), known)
    root = known.find(np.arange(len(every)))
    other = np.flatnonzero(root != np.arange(len(every)))
    yield pa.RecordBatch.from_arrays([pa.array(every[other]), pa.array(every[root[other]])], names=["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links to (id, root) for each id but the roots: alternating large and small stars until nothing changes.

    Every round is written to the shared folder, so no round is ever computed twice and executors may be lost; the round before it is deleted."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = X.stored(edges, name)
    state = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, edges = edges, X.stored(small.where("u <> v").distinct(), name)
        X.discard(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document that belongs to a group of two or more."""
    spark = docs.sparkSession
    sigs = X.stored(signed(docs), "simhash")
    first = X.stored(sigs.groupBy("sig").agg(F.min("doc_id").alias("id"), (F.min("doc_id") != F.max("doc_id")).alias("shared")), "simhash-first")
    rows = first.count() * RINGS * SEGMENTS * len(PARTS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    sent = first.select("id", "sig").mapInArrow(_buckets, "bucket int, id long, sig binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    edges = sent.mapInArrow(_linked, "a long, b long")
    several = sigs.groupBy("doc_id").agg(F.min("sig").alias("p"), F.max("sig").alias("q")).where("p <> q").select("doc_id")  # one id, different texts
    edges = edges.union(sigs.join(several, "doc_id", "left_semi").join(first, "sig").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = components(edges, "simhash-links")
    member = roots.union(roots.select("root", "root").distinct())
    named = first.join(member, "id", "left").where("shared OR root IS NOT NULL").select("sig", F.coalesce("root", "id").alias("group_id"))
    return sigs.join(named, "sig").select("doc_id", "group_id").distinct()


def removed(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that near-dedup drops: all of a group but its representative."""
    return groups(docs).where("doc_id <> group_id").select("doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
