"""Plain definitions of what the corpus operators find, without any index."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from vecspark.llm import simhash
from vecspark.llm import text as X

TOKEN = re.compile(r"[0-9A-Za-zÀ-῿⁰-\U0010ffff]+")
CLASHING = "id sig key first last a b bucket origin h d n m u v rank row count file other dim kind label reach lo hi at x k span start stop place".split()


def tokens(text: str | None) -> list[str]:
    return [t.lower() for t in TOKEN.findall(text or "")]


def awkward(spark, extra: list[tuple] = ()):
    """Documents with nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, long), (4, long), (None, "a text without an id"), (None, None), (6, "!!! ???"), (7, "ünïcode ▁ text with 漢字 and 😀\r\n"), (8, "x" * 300_000), *extra]
    df = spark.createDataFrame([(*r, "en" if n % 2 else None, "s", 1) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


def passages(docs: dict[int, str], items: dict[int, str], window: int = 13, off: int = 2, least: int = 5) -> set[tuple[int, int, int, int]]:
    """(doc, item, doc token, item token) of every token pair within a matching window."""
    found = set()
    for d, text in docs.items():
        a = tokens(text)
        for i, passage in items.items():
            b = tokens(passage)
            if len(b) < least:
                continue
            n, allowed = (window, off) if len(b) >= window else (len(b), 0)
            for p in range(len(a) - n + 1):
                for q in range(len(b) - n + 1):
                    if sum(x != y for x, y in zip(a[p : p + n], b[q : q + n], strict=True)) <= allowed:
                        found |= {(d, i, p + k, q + k) for k in range(n)}
    return found


def deduplicated(docs: dict[int, str | None], words: int = 50) -> dict[int, str | None]:
    """Texts without the lines of repeated runs: of any stretch of lines of so many words that came before."""
    seen: dict[tuple, tuple] = {}
    stretches = []
    for d in sorted(docs):
        lines = [(n, line.strip(" \t\n\r\x0b\x0c")) for n, line in enumerate((docs[d] or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for s in range(len(lines)):
            total = 0
            for e in range(s, len(lines)):
                total += len(re.split(r"[ \t\n\r\x0b\x0c]+", lines[e][1]))
                if total >= words:
                    key = tuple(x[1] for x in lines[s : e + 1])
                    place = (d, lines[s][0])
                    seen[key] = min(seen.get(key, place), place)
                    stretches.append((key, place, lines[e][0]))
    cut: dict[int, set[int]] = {}
    for key, place, last in stretches:
        if seen[key] < place:
            cut.setdefault(place[0], set()).update(range(place[1], last + 1))
    out = {}
    for d, text in docs.items():
        gone = cut.get(d, set())
        if gone:
            every = text.split("\n")
            text = "\n".join(line for n, line in enumerate(every) if n not in gone)
        out[d] = text
    return out


def components(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each member of a component to its smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def near(sigs: dict[int, bytes], rings: int, limit: int) -> list[tuple[int, int]]:
    """Pairs within ``limit`` bits in some ring."""
    ids = sorted(sigs)
    x = np.stack([np.frombuffer(sigs[i], np.uint8).reshape(rings, -1) for i in ids]) if ids else np.zeros((0, rings, 1), np.uint8)
    out = []
    for k in range(len(ids)):
        d = np.bitwise_count(x[k + 1 :] ^ x[k]).sum(axis=2).min(axis=1) if k + 1 < len(ids) else ()
        out += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(np.asarray(d) <= limit)]
    return out


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion or replacement of a byte."""
    x, y = a.encode(), b.encode()
    if abs(len(x) - len(y)) > 1:
        return False
    n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return x[n:] == y[n:] or x[n + 1 :] == y[n + 1 :] or x[n + 1 :] == y[n:] or x[n:] == y[n + 1 :]


def signature(text: str) -> bytes:
    """Operator 10's signature by its definition, one feature at a time, for texts of Latin letters."""
    own = tokens(text)
    count: dict[int, int] = {}
    for w in own or [text]:
        parts = [w] if len(w.encode()) <= simhash.LONG or not own else [w[k : k + simhash.GRAM_LONG] for k in range(max(1, len(w) - simhash.GRAM_LONG + 1))]
        for p in parts:
            raw = np.frombuffer(p.encode(), np.uint8)
            h = int(X.span_hash(raw, np.array([0]), np.array([len(raw)]))[0]) >> 16
            count[h] = count.get(h, 0) + 1
    total = np.zeros(simhash.BYTES * 8)
    for h, n in count.items():
        planes = b"".join(_mixed(h + 0x9E3779B97F4A7C15 * (k + 1)).to_bytes(8, "little") for k in range(-(-simhash.BYTES // 8)))[: simhash.BYTES]
        total += round(16 * (1 + math.log(n))) * (np.unpackbits(np.frombuffer(planes, np.uint8)).astype(float) * 2 - 1)
    out = bytearray(np.packbits(total > 0).tobytes())
    spare = 8 * simhash.RING_BYTES - simhash.RING_BITS
    for k in range(simhash.RING_BYTES - 1, len(out), simhash.RING_BYTES):
        out[k] = out[k] >> spare << spare
    return bytes(out)


def _mixed(x: int) -> int:
    x &= 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
    return x ^ x >> 31
