"""Operator 9: toxic documents, by Levenshtein automata intersected with a lexicon trie.

The lexicon has common terms of abuse and words and stems learned from the table of labels; all of five bytes and more,
but weak stems and stems one edit from the beginning of a word of a clean row, also match at one edit. Tries of both are intersected with the Levenshtein automaton once, on the driver, giving one
deterministic automaton over bytes; all tokens of a batch step through it together, most leave it within a few bytes.

*Score.* A hit counts 1, misspelled 0.75; where its context is quotation (it stands inside quotation marks, or a word
such as "said" or "called" is among the four tokens before it) a quarter of that; addressed to somebody ("you" among the
four tokens before it) a quarter more. Documents of ``THRESHOLD`` (1.5) and more are toxic: one row each.

*Learned stems.* Of ``TRAIN_ROWS`` labelled rows (those of the smallest hash of ``doc_id``), the words and word beginnings
that at least nine in ten times mean a toxic document are taken greedily until each toxic document has three, or none
adds five documents. Beginnings that mean so only where three words of a document have them are *weak* stems; a hit of
one counts half, so that three reach the threshold. Spellings that the misspelling rule finds in clean rows of the sample are exempted.

Defined cases: null and empty texts and rows without ``doc_id`` give no row; texts and lines of any length are read whole, in
linear time; an empty table of documents gives no row; an empty table of labels leaves the built-in
terms; contradicting labels of one document count as toxic; repeated rows give their row once; extra columns are ignored.
Edits are counted in bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X
from vecspark.operators.sampling import smallest_hashes

TRAIN_ROWS, THRESHOLD, FUZZY_FROM, COVER, GAIN, PRECISION, REPEATS, WEAK = 4000, 1.5, 5, 3, 5, 0.9, 3, 0.5
TERMS = """idiot moron stupid pathetic worthless disgusting trash scum clown loser imbecile cretin dumbass bastard asshole
scumbag lowlife dimwit halfwit vermin arschloch dummkopf missgeburt abschaum connard salaud ordure pendejo gilipollas
imbécil estúpido""".split()
BENIGN = frozenset("closer loses lower poser crash brash thrash stash trash clowns blown crown grown flown closers ".split())
CUES = frozenset("said says wrote writes called calling quote quoted quotes word words term terms dit écrit sagte sagt schrieb dijo dice escribió".split())
ADDRESS = frozenset("you your youre u du dich euch tu vous te usted".split())
SCHEMA = "doc_id long, score double, hits int, misspelled int, quoted int, terms array<string>"
QUOTES = "\"“”„«»‘"


class Automaton:
    """All strings within one edit of a fuzzy term, equal to an exact term, beginning with a stem or weak stem, or within one edit of such a beginning with a fuzzy stem."""

    def __init__(self, fuzzy: Iterable[str], exact: Iterable[str], stems: Iterable[str], weak: Iterable[str] = (), fuzzy_stems: Iterable[str] = ()):
        children: list[dict[int, int]] = [{}, {}, {}, {}, {}]
        ends: dict[int, str] = {}
        for root, words in enumerate((fuzzy, exact, stems, weak, fuzzy_stems)):
            for w in sorted(set(words)):
                node = root
                for c in w.encode():
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                    node = children[node][c]
                ends[node] = w
        kind = [0, 1, 2, 3, 4] + [0] * (len(children) - 5)
        for node, own in enumerate(children):
            for child in own.values():
                kind[child] = kind[node]
        used = sorted({c for own in children for c in own})
        self.cls = np.full(256, len(used), dtype=np.int64)
        self.cls[used] = np.arange(len(used))

        def closed(states: set[tuple[int, int]]) -> frozenset:
            todo = list(states)
            while todo:  # deletions
                node, e = todo.pop()
                if kind[node] in (0, 4) and e == 0:
                    for child in children[node].values():
                        if (child, 1) not in states:
                            states.add((child, 1))
                            todo.append((child, 1))
            return frozenset(states)

        start = closed({(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)})
        index, todo, rows = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            row = []
            for c in [*used, -1]:
                to: set[tuple[int, int]] = set()
                for node, e in now:
                    if kind[node] >= 2 and node in ends:
                        to.add((node, e))  # whatever follows a stem
                    if c in children[node]:
                        to.add((children[node][c], e))
                    if kind[node] in (0, 4) and e == 0:
                        to.add((node, 1))
                        to |= {(child, 1) for own, child in children[node].items() if own != c}
                key = closed(to)
                if key not in index:
                    index[key] = len(index)
                    todo.append(key)
                row.append(index[key])
            rows.append(row)
        self.next = np.array(rows, dtype=np.int32)
        self.dead = index.get(frozenset(), -1)
        best = [min(((e, kind[node] == 3, ends[node]) for node, e in s if node in ends), default=None) for s in index]
        self.term = [b[2] if b else None for b in best]
        self.weak = [bool(b and b[1]) for b in best]
        self.edits = np.array([b[0] if b else -1 for b in best])

    def run(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state that each token ends in."""
        state = np.zeros(len(start), dtype=np.int32)
        at, alive = start.copy(), np.flatnonzero(end > start)
        while len(alive):
            s = self.next[state[alive], self.cls[low[at[alive]]]]
            state[alive] = s
            at[alive] += 1
            alive = alive[(s != self.dead) & (at[alive] < end[alive])]
        return state


class Lexicon:
    def __init__(self, stems: Iterable[str] = (), words: Iterable[str] = (), benign: Iterable[str] = (), weak: Iterable[str] = (), firm: Iterable[str] = ()):
        self.stems, self.words, self.weak, self.firm, self.benign = sorted(stems), sorted(words), sorted(weak), set(firm), BENIGN | set(benign)
        long = lambda w: len(w.encode()) >= FUZZY_FROM
        terms = set(TERMS) | set(self.words)
        fuzzy = {w for w in self.stems if long(w)} - set(firm)
        self.automaton = Automaton(filter(long, terms), [w for w in terms if not long(w)], set(self.stems) - fuzzy, self.weak, fuzzy)

    def hits(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, str, bool, bool, float]]:
        """(row, term, misspelled, quoted, weight) of every hit, in time linear in the bytes."""
        t = X.Tokens(buf, offs)
        state = self.automaton.run(t.low, t.start, t.end)
        some = np.flatnonzero(self.automaton.edits[state] >= 0)
        if len(some) == 0:
            return
        low = t.low.tobytes()
        marks = np.concatenate([[0], np.cumsum(_quotes(buf))])
        a, b, own = t.start[some], t.end[some], t.row[some]
        breaks = np.concatenate([[-1], np.flatnonzero(buf == 10), [len(buf)]])
        at = np.searchsorted(breaks, a)  # the line's end
        first, last = np.maximum(breaks[at - 1] + 1, offs[own]), np.minimum(breaks[at], offs[own + 1])
        inside = ((marks[a] - marks[first]) % 2 == 1) & (marks[last] > marks[b])
        word = lambda i: low[t.start[i] : t.end[i]].decode("utf-8", "replace")
        for k, row, within in zip(some.tolist(), own.tolist(), inside.tolist(), strict=True):
            wrong = bool(self.automaton.edits[state[k]])
            if wrong and word(k) in self.benign:
                continue
            before = {word(i) for i in range(max(int(t.first[row]), k - 4), k)}
            quoted = within or bool(before & CUES)
            weight = (0.75 if wrong else WEAK if self.automaton.weak[state[k]] else 1.0) * (0.25 if quoted else 1.25 if before & ADDRESS else 1.0)
            yield row, self.automaton.term[state[k]], wrong, quoted, weight


def _quotes(buf: np.ndarray) -> np.ndarray:
    """Where quotation marks (``QUOTES``) begin."""
    out = buf == 34
    two, three = np.flatnonzero(buf[:-1] == 0xC2), np.flatnonzero(buf[:-2] == 0xE2)
    out[two[(buf[two + 1] == 0xAB) | (buf[two + 1] == 0xBB)]] = True
    out[three[(buf[three + 1] == 0x80) & np.isin(buf[three + 2], (0x98, 0x9C, 0x9D, 0x9E))]] = True
    return out


def learn(rows: Iterable[tuple[list[str], bool]]) -> Lexicon:
    """The lexicon learned from (tokens, each as often as it comes but ``REPEATS`` times at most; toxic) of labelled documents.

    Forms are words, beginnings (``*``) and beginnings that ``REPEATS`` words of a document have (``#``)."""
    toxic: dict[str, set[int]] = defaultdict(set)
    clean: Counter = Counter()
    bad: dict[int, int] = {}
    clean_tokens: set[str] = set()
    for n, (tokens, is_toxic) in enumerate(rows):
        begun = Counter(w[:k] for w in tokens for k in range(4, min(9, len(w)) + 1))
        forms = {f + "*" for f in begun} | {f + "#" for f, c in begun.items() if c >= REPEATS} | {w for w in tokens if len(w) > 2}
        if is_toxic:
            bad[n] = 0
            for f in forms:
                toxic[f].add(n)
        else:
            clean.update(forms)
            clean_tokens.update(tokens)
    good = {f: d for f, d in toxic.items() if len(d) >= GAIN and len(d) >= PRECISION * (len(d) + clean[f])}
    taken: list[str] = []
    while good:
        gain = {f: sum(bad[n] < COVER for n in d) for f, d in good.items()}
        f = max(gain, key=lambda x: (gain[x], x[-1] != "#", len(x), x))
        if gain[f] < GAIN:
            break
        taken.append(f)
        for n in good.pop(f):
            bad[n] += 1
        stem, weak = f.rstrip("*#"), f[-1] == "#"
        related = lambda x, stem=stem: x.startswith(stem) or stem.startswith(x.rstrip("*#"))
        good = {x: d for x, d in good.items() if gain[x] >= GAIN and not (related(x) and (x[-1] == "#" or not weak))}
    words = sorted(w for w in clean_tokens if w)
    text = " ".join(words).encode()
    size = [len(w.encode()) for w in words]
    end = np.cumsum(np.array(size, dtype=np.int64) + 1) - 1 if words else np.zeros(0, np.int64)
    firm: set[str] = set()
    while True:
        lexicon = Lexicon([f[:-1] for f in taken if f[-1] == "*"], [f for f in taken if f[-1] not in "*#"], (), [f[:-1] for f in taken if f[-1] == "#"], firm)
        state = lexicon.automaton.run(np.frombuffer(text, np.uint8), end - np.array(size, dtype=np.int64), end)
        met = {lexicon.automaton.term[k] for k in state[lexicon.automaton.edits[state] == 1]} & set(lexicon.stems) - firm
        if not met:
            break
        firm |= met
    lexicon.benign = lexicon.benign | {words[k] for k in np.flatnonzero(lexicon.automaton.edits[state] == 1)}
    return lexicon


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = X.utf8(b.column(1))
        out = []
        for i, j in X.chunks(offs):
            t = X.Tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            raw = t.low.tobytes()
            for r in range(j - i):
                lo, hi = t.first[r], t.first[r + 1]
                _, at, often = np.unique(t.hash[lo:hi], return_index=True, return_counts=True)
                at = np.repeat(at + lo, np.minimum(often, REPEATS))
                out.append(sorted(raw[t.start[k] : t.end[k]].decode("utf-8", "replace") for k in at))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["toxic", "tokens"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns from a bounded sample: the ``rows`` labelled documents of the smallest hash of doc_id."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest_hashes(own, F.xxhash64("id"), rows)
    texts = X.id_text(docs).where("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("toxic", "text")
    found = texts.mapInArrow(_vocabulary, "toxic int, tokens array<string>").toArrow()
    return learn((tokens.as_py(), is_toxic.as_py() > 0) for b in found.to_batches() for is_toxic, tokens in zip(*b.columns, strict=True))


def toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            buf, offs = X.utf8(b.column(1))
            out: dict[int, list] = defaultdict(list)
            for i, j in X.chunks(offs):
                for row, *hit in shipped.value.hits(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    out[i + row].append(hit)
            rows = [(int(ids[r]), round(sum(h[3] for h in own), 6), len(own), sum(h[1] for h in own), sum(h[2] for h in own), sorted({h[0] for h in own})) for r, own in sorted(out.items())]
            rows = [r for r in rows if r[1] >= threshold]
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "score", "hits", "misspelled", "quoted", "terms"])

    return X.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, SCHEMA).distinct()


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
