"""Operator 7: personal data and secrets, by aggregated weak supervision.

Candidate spans (anything shaped like an e-mail address, telephone, card or social security number, IP address or secret,
and other long numbers) get votes from five labelers, each of which may abstain: a strict regular expression, a checksum,
a gazetteer (top-level domains, country codes, issuers, key prefixes, reserved addresses), the words before, and a shape
test. Expectation-maximisation over the votes of all candidates estimates, by kind, each labeler's reliability and
each pattern's probability; these soft labels train the final span classifier, a logistic regression over span features.
Both models work on counts of distinct patterns (at most some thousand rows, however large the corpus), so they see every
document. Spans of probability 0.5 and more are returned.

The texts are scanned once, whole, in time linear in their bytes, and candidates written to the shared folder; only the
surroundings of digits, ``@`` and key prefixes reach Python code. No candidate has an upper length but by its definition
(card, telephone, social security and account numbers); the words before are those of the ``BEFORE`` (96) characters before,
in the same line. Numbers in groups parted by spaces only count as telephone or social security numbers where a word
before says so, or the other labelers do. Spans are character positions, ``text[start:stop]``.

Defined cases: null and empty texts and rows without ``doc_id`` give nothing; an empty table gives an empty result; texts
and single words of any length are read whole; of overlapping candidates the first kind in
``KINDS``, then the leftmost, wins; repeated rows give their spans once; no candidates at all give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X

KINDS = ("email", "iban", "secret", "ip", "phone", "ssn", "card", "number")
CANDIDATES = (
    re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"),
    re.compile(r"(?<![0-9A-Za-z_-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z_-])"),
    re.compile(
        r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
        r"|(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[0-9A-Za-z]{24,})(?![0-9A-Za-z_-])"
        r"|(?<![0-9A-Za-z_+/.-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*\d)[0-9A-Za-z+/_-]{32,}={0,2}(?![0-9A-Za-z_+/=-])"
    ),
    re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"),
    re.compile(
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{2,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
        r"|(?<![\w+.-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d(?: \d{2}){4})(?![\w-]| \d|\.\d)"
    ),
    re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w.-])(?<!\d )\d{3} \d{2} \d{4}(?![\w-]| \d|\.\d)"),
    re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w.])\d{5,}(?!\w|\.\d)"),
)
STRICT = (
    re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,4})?"),
    re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|eyJ[^.]+\.[^.]+\.[^.]+|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"),
    re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    re.compile(r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{8,15}"),
    re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}"),
    re.compile(r"(?!)"),
)
TLDS = frozenset("com org net edu gov io co de fr es it uk eu us ca au ch at nl be se no dk pl info biz dev app ai".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 351 353 358 380 420".split())
CUES = {
    "email": "email e-mail mail contact write", "secret": "token secret key apikey api_key password passwd credential bearer aws",
    "ip": "ip address host server from login", "phone": "phone tel telephone call fax mobile cell telefon tél teléfono",
    "ssn": "ssn social security", "iban": "iban account konto cuenta compte bank", "card": "card visa mastercard credit amex karte carte tarjeta", "number": "account passport iban konto cuenta",
}
AGAINST = frozenset("version release isbn order page section chapter figure build commit revision rev sha md5 checksum v".split())
N_LABELERS, N_FEATURES, BEFORE = 5, 21, 96
SCHEMA = "doc_id long, start long, stop long, kind string, span string, votes int, features int"
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
PREFIX = re.compile(rb"AKIA|gh[pousr]_|sk-|eyJ")
_WORD = re.compile(r"[^\W\d_]+|[^\W_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(span: str) -> bool:
    """The checksum of account numbers."""
    own = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def judge(kind: int, span: str, before: str) -> tuple[list[int], list[bool]]:
    """Votes (1 personal, 0 not, 2 abstains) of the labelers, and the features of the final classifier."""
    name, digits = KINDS[kind], re.sub(r"\D", "", span)
    strict = bool(STRICT[kind].fullmatch(span))
    cues = {w.lower() for w in _WORD.findall(before)[-4:]}
    cue, against = bool(cues & _CUES[name]), bool(cues & AGAINST)
    check = known = 2
    if name in ("phone", "ssn") and re.fullmatch(r"[\d ]+", span):
        strict = cue  # numbers in a row are no evidence by their form alone
    if name == "card":
        check = int(luhn(digits))
        known = int(digits[0] in "3456") if digits else 0
    elif name == "ip":
        octets = [int(x) for x in span.split(".")]
        check = int(all(x < 256 for x in octets))
        known = 0 if octets[0] in (0, 127) or octets[0] > 223 else 2
    elif name == "email":
        known = int(span.rpartition(".")[2].lower() in TLDS)
    elif name == "phone":
        code = re.match(r"\+(\d{1,3})[ .(-]", span)
        known = int(code[1] in CODES) if code else 2
        check = int(7 <= len(digits) <= 15)
    elif name == "secret":
        known = 1 if re.match(r"AKIA|gh[pousr]_|sk-|eyJ", span) else 2
        check = int(len(set(span.lower())) >= 8)
    elif name == "iban":
        check = 1
    elif name == "number":
        check = 0 if len(digits) < 9 else 2
    shape = int("@" in span[1:-1]) if name == "email" else int(len(set(span if name == "secret" else digits)) > 2)
    votes = [int(strict), check, known, 1 if cue and not against else 0 if against else 2, 2 if shape else 0]
    features = [kind == k for k in range(len(KINDS))]
    features += [strict, check == 1, check == 0, known == 1, known == 0, cue, against, bool(shape), len(span) >= 16, span[:1] == "+", span.upper() == span, len(digits) * 2 >= len(span), True]
    return votes, features


def spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, stop) of the candidates in ``text``; none overlap. What is shaped like an account number but fails its checksum is left to the other kinds."""
    taken = bytearray(len(text))
    for kind, form in enumerate(CANDIDATES):
        for m in form.finditer(text):
            a, b = m.span()
            while kind == 0 and text[b - 1] in ".-":
                b -= 1
            if taken.find(1, a, b) < 0 and (KINDS[kind] != "iban" or mod97(text[a:b])):
                taken[a:b] = bytes([1]) * (b - a)
                yield kind, a, b


def regions(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop) in bytes of the parts of a chunk that can hold candidates, with whole words and some more around them."""
    mask = X.DIGIT[buf] | (buf == 64)
    mask[[m.start() for m in PREFIX.finditer(buf.tobytes())]] = True
    hot = np.flatnonzero(mask)
    if len(hot) == 0:
        return
    row = np.searchsorted(offs, hot, "right") - 1
    blank = np.flatnonzero((buf == 32) | (buf == 10) | (buf == 9))
    edge = np.concatenate([[-1], blank, [len(buf)]])
    word = edge[np.searchsorted(blank, hot)]  # the white space before
    after = edge[np.searchsorted(blank, hot) + 1]
    start = np.maximum(offs[row], word - 4 * BEFORE)
    stop = np.minimum(offs[row + 1], after + 48)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > np.maximum.accumulate(stop)[:-1])]))
    last = np.append(new[1:], len(hot)) - 1
    for r, w0, w1 in zip(row[new].tolist(), start[new].tolist(), np.maximum.accumulate(stop)[last].tolist(), strict=True):
        while w0 > offs[r] and buf[w0] & 0xC0 == 0x80:
            w0 -= 1
        while w1 < offs[r + 1] and buf[w1] & 0xC0 == 0x80:
            w1 += 1
        yield r, w0, w1


def found(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, str, list[int], list[bool]]]:
    """(row, start, stop, kind, span, votes, features) of all candidates of a chunk, in time linear in its bytes."""
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    for r, w0, w1 in regions(buf, offs):
        part = buf[w0:w1].tobytes().decode("utf-8", "replace")
        base = int(chars[w0] - chars[offs[r]])
        for kind, s, e in spans(part):
            line = part[max(0, s - BEFORE) : s].rpartition("\n")[2]
            yield r, base + s, base + e, kind, part[s:e], *judge(kind, part[s:e], line)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        buf, offs = X.utf8(batch.column(1))
        rows = []
        for i, j in X.chunks(offs):
            for r, s, e, kind, span, votes, features in found(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                rows.append((int(ids[i + r]), s, e, KINDS[kind], span, sum(v * 3**k for k, v in enumerate(votes)), sum(bool(f) << k for k, f in enumerate(features))))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "stop", "kind", "span", "votes", "features"])


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM over patterns (n x labelers of 0, 1, 2) and their counts: the probability of each pattern to be personal.

    Labelers start, with the weight of ten cases each, as right four times in five where they vote; prior one half."""
    yes = (votes == 1).sum(axis=1) + 0.5
    p = yes / (yes + (votes == 0).sum(axis=1) + 0.5)
    seen = np.stack([(votes == v).T for v in range(3)], axis=2).astype(float)  # labeler, pattern, vote
    prior = 10 * np.array([[0.56, 0.14, 0.3], [0.14, 0.56, 0.3]])
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        table = np.einsum("kp,lpv->lkv", weight, seen) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 5) / (count.sum() + 10)
        log = np.log(share)[None, :] + np.einsum("lpv,lkv->pk", seen, np.log(table))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p


def logistic(x: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights by Newton's method with a small ridge; p are soft labels."""
    w = np.zeros(x.shape[1])
    share = count / max(1, count.sum())
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (q - p)) + 1e-4 * w
        curve = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1, 4 / max(1e-9, np.abs(step).max()))
    return w


def classify(patterns: list[tuple[str, int, int, int]]) -> dict[int, float]:
    """From (kind, votes, features, count): the final probability by features."""
    if not patterns:
        return {}
    kind = np.array([r[0] for r in patterns])
    votes = np.array([[r[1] // 3**k % 3 for k in range(N_LABELERS)] for r in patterns])
    x = np.array([[r[2] >> k & 1 for k in range(N_FEATURES)] for r in patterns], dtype=float)
    count = np.array([r[3] for r in patterns], dtype=float)
    p = np.zeros(len(patterns))
    for k in np.unique(kind):
        p[kind == k] = reliabilities(votes[kind == k], count[kind == k])
    q = 1 / (1 + np.exp(-np.clip(x @ logistic(x, p, count), -30, 30)))
    return {r[2]: round(float(v), 6) for r, v in zip(patterns, q, strict=True)}


def personal(docs: DataFrame, least: float = 0.5) -> DataFrame:
    spark = docs.sparkSession
    every = X.stored(X.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_scan, SCHEMA).distinct(), "pii")
    patterns = every.groupBy("kind", "votes", "features").count().collect()
    final = classify(sorted((r["kind"], r["votes"], r["features"], r["count"]) for r in patterns))
    table = spark.createDataFrame(list(final.items()), "features int, probability double")
    return every.join(table, "features").where(F.col("probability") >= least).select("doc_id", "start", "stop", "kind", "span", "probability")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
