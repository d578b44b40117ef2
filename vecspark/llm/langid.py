"""Operator 5: hierarchical language identification.

The family (Germanic, Romance, ...) is predicted first, by one-versus-rest linear support vector machines over hashed
character trigrams; then one-versus-one machines separate the languages of that family, by votes and, among equals, by
summed margins. The machines are fitted on ``TRAIN_ROWS`` rows of known ``lang``, as many of each language (those of the
smallest hash of ``doc_id``); every document is then scored over its whole text, in one pass without a shuffle.

A document is rejected if it has no letters, or if it has 30 letters and more and is less than half as close to the mean of
its language as all but one in a thousand of the fitted rows are: text of a language that the model doesn't know.

Defined cases: an empty table gives an empty one; texts of any length are scored whole; null, empty and letterless texts get language and family ``und``, margin 0, and are rejected. Rows
repeated are scored alike. With no labelled row at all, every text is ``und`` but accepted if it has letters. Ties go to
the first language by name. A null ``doc_id`` is kept as null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm import text as X

TRAIN_ROWS, LANGUAGES, DIMS, LEAST_LETTERS = 2000, 100, 4096, 30
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "la"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
RESULT = "lang string, family string, margin double, accepted boolean"
_LETTER = X.WORD & ~X.DIGIT


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of trigram counts' roots, and the letters (bytes) of each row."""
    rows = len(offs) - 1
    mask = X.word_mask(buf) & _LETTER[buf]
    low = np.where(mask, X.lower(buf), np.uint8(32)).astype(np.uint32)
    letters = np.concatenate([[0], np.cumsum(mask)])
    letters = letters[offs[1:]] - letters[offs[:-1]]
    # each row gets a space before and after it, so that single letters count too
    row = np.repeat(np.arange(rows), np.diff(offs))
    at = np.arange(len(low)) + 2 * row + 1
    wide = np.full(len(low) + 2 * rows, 32, dtype=np.uint32)
    wide[at] = low
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(wide) > 2 else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(rows), np.diff(offs) + 2)[1:-1]
    real = wide[1:-1] != 32
    f = ((code[real] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    x = np.sqrt(np.bincount(owner[real] * DIMS + f, minlength=rows * DIMS).reshape(rows, DIMS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), letters


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c / len(y)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the slope
        top = x.T @ (x @ (top / max(np.linalg.norm(top), 1e-12)))
    step = 1 / (1 + 2.4 * share.max() * np.linalg.norm(top))
    share, y = share.astype(np.float32), y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - np.float32(step) * (v - 2 * x.T @ (share * slack * y))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], letters: np.ndarray):
        names = np.array(langs)
        self.langs = sorted(set(langs))
        self.family = {lang: _FAMILY.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        fam = np.array([self.family[k] for k in langs])
        self.first = [svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([k for k in self.langs if self.family[k] == f], 2):
                own = (names == a) | (names == b)
                self.pairs[a, b] = svm(x[own], np.where(names[own] == a, 1.0, -1.0))
        self.means = {k: x[names == k].mean(axis=0) for k in self.langs}
        close = np.array([x[i] @ self.means[k] for i, k in enumerate(langs) if letters[i] >= LEAST_LETTERS])
        self.least = float(np.quantile(close, 0.001)) / 2 if len(close) else 0.0

    def predict(self, x: np.ndarray, letters: np.ndarray) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        n = len(x)
        lang, family, margin = np.full(n, "und", object), np.full(n, "und", object), np.zeros(n)
        some = letters > 0
        accepted = some.copy()
        if not self.langs:
            return lang.tolist(), family.tolist(), margin, accepted
        x1 = np.hstack([x, np.ones((n, 1), np.float32)])
        score = np.stack([x1 @ w for w in self.first], axis=1) if self.first else np.zeros((n, 1))
        at = score.argmax(axis=1)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(some & (at == k))
            if len(own) == 0:
                continue
            langs = [a for a in self.langs if self.family[a] == f]
            votes, sums = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                d = x1[own] @ self.pairs[langs[i], langs[j]]
                votes[:, i] += d >= 0
                votes[:, j] += d < 0
                sums[:, i] += d
                sums[:, j] -= d
            best = (votes + 0.5 * np.tanh(sums / 10)).argmax(axis=1)
            lang[own] = np.array(langs, object)[best]
            family[own] = f
            margin[own] = sums[np.arange(len(own)), best] if len(langs) > 1 else np.abs(score[own, k])
            near = np.einsum("ij,ij->i", x[own], np.stack([self.means[a] for a in langs])[best])
            accepted[own] &= (near >= self.least) | (letters[own] < LEAST_LETTERS)
        return lang.tolist(), family.tolist(), margin, accepted


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = X.utf8(b.column(1))
        for i, j in X.chunks(offs):
            x, letters = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array(letters.astype(np.int64))], names=["lang", "x", "letters"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample: ``rows`` labelled rows in all, of each of the ``LANGUAGES`` most frequent languages an equal number,
    those of the smallest hash of doc_id (all of a language that has fewer); so a rare language is known however large the others are."""
    known = docs.where("lang IS NOT NULL AND lang <> '' AND lang <> 'und' AND text IS NOT NULL AND text <> ''").select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    each = max(1, rows // max(1, len(counts)))
    parts = None
    for r in counts:  # one condition a language, in one pass: bounds on the hash leave some more than ``each`` rows
        share = min(1.0, (2 * each + 40) / r["count"])
        own = (F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
        parts = own if parts is None else parts | own
    if parts is None:
        return Model(np.zeros((0, DIMS), np.float32), [], np.zeros(0, np.int64))
    ranked = Window.partitionBy("lang").orderBy("h", "d", "text")
    chosen = known.where(parts).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= each).select("lang", "text").mapInArrow(_sampled, "lang string, x binary, letters long").collect()
    chosen = sorted((r for r in chosen if r.letters > 0), key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float16) for r in chosen], dtype=np.float32).reshape(-1, DIMS)
    return Model(x, [r.lang for r in chosen], np.array([r.letters for r in chosen]))


def identified(docs: DataFrame, model: Model | None = None) -> Column:
    """A column of ``RESULT`` structs for ``docs.text``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf(RESULT)
    def identify(text: pa.Array) -> pa.Array:
        buf, offs = X.utf8(text)
        lang, family, margin, accepted = [], [], [np.zeros(0)], [np.zeros(0, bool)]
        for lo in range(0, len(text), 512):
            part = offs[lo : min(lo + 512, len(text)) + 1]
            for i, j in X.chunks(part):
                own = part[i : j + 1]
                a, b, c, d = shipped.value.predict(*features(buf[own[0] : own[-1]], own - own[0]))
                lang += a
                family += b
                margin.append(c)
                accepted.append(d)
        cols = [pa.array(lang, pa.string()), pa.array(family, pa.string()), pa.array(np.round(np.concatenate(margin), 6)), pa.array(np.concatenate(accepted))]
        return pa.StructArray.from_arrays(cols, names=["lang", "family", "margin", "accepted"])

    return identify(F.col("text").cast("string"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", identified(docs).alias("r")).select("doc_id", "r.*")
