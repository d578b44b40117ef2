"""Operator 10 against brute force, and the pipeline against its parts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from brute import awkward, components, deduplicated, near, passages, signature, tokens
from vecspark.llm import decontaminate, langid, pieces, simhash


def _groups(docs) -> dict[int, int]:
    return {r["doc_id"]: r["group_id"] for r in simhash.groups(docs).collect()}


def _brute(docs) -> dict[int, int]:
    sigs = {r["doc_id"]: bytes(r["sig"]) for r in simhash.signed(docs).collect()}
    return components(near(sigs, simhash.RINGS, simhash.LIMIT))


def _changed(rng, words: list[str], share: float) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.random()) if rng.random() < share else w for w in words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "ba be bi do du fa ge ho ki lo mu".split() for b in "n r s t ns rt lm".split()]
    rows, n = [], 0
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([5, 30, 200, 600]))
        for share in rng.choices([0.0, 0.02, 0.08, 0.15, 0.3, 0.6], k=rng.choice([1, 2, 6])):
            rows.append((n, _changed(rng, words, share)))
            n += 1
    rows += [(1000 + i, " ".join(rows[0][1].split()[: 5 + i])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _groups(docs) == _brute(docs)


def test_recall_of_near_copies_in_the_documents(spark):
    """Pairs of documents that share four fifths of their words and more, by brute force, are in one group; no group has strangers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r["doc_id"]: set(tokens(r["text"])) for r in docs.collect()}
    got = _groups(docs)
    ids = sorted(d for d, w in words.items() if len(w) >= 30)
    alike = lambda a, b: len(words[a] & words[b]) / max(1, len(words[a] | words[b]))
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if alike(a, b) >= 0.8]
    assert len(pairs) > 20 and sum(a in got and got.get(a) == got.get(b) for a, b in pairs) >= 0.95 * len(pairs)
    assert all(alike(d, g) > 0.3 for d, g in got.items() if len(words[d]) >= 30)


def test_large_groups_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('one text that is copied again and again ', CASE WHEN id % 3 = 0 THEN 'and once more' ELSE '' END) AS text")
    assert _groups(docs) == _brute(docs) and len(_groups(docs)) == 3000


def test_groups_of_awkward_tables(spark):
    docs = awkward(spark, [(20, "same text here"), (21, "same text here"), (22, "!!! ???"), (21, "same text here")])
    got = _groups(docs)
    assert got[20] == got[21] == 20 and got[6] == got[22] == 6 and not {1, 2, None} & set(got)
    assert simhash.groups(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in simhash.removed(docs).collect()} >= {21, 22}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 400), (7, 7)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == {i: 0 for i in range(1, 201)} | {500: 300, 400: 300}


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Stages 2 to 5 by their plain definitions, on what the language model kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in docs.where(langid.identified(docs)["accepted"]).collect()}
    assert len(kept) > 0.97 * docs.count()
    strip = lambda t: [x.strip() for x in t.split("\n") if x.strip()]
    cut = deduplicated(kept)
    stage = {r["doc_id"]: r["text"] for r in P.lines(spark, docs.where(docs["doc_id"].isin(list(kept))), sf_dir).collect()}
    assert {d: strip(t) for d, t in stage.items()} == {d: strip(t) for d, t in cut.items() if t.strip() or t == kept[d]}
    left = spark.createDataFrame(list(stage.items()), "doc_id long, text string")
    group = _brute(left)
    single = {d: t for d, t in stage.items() if group.get(d, d) == d}
    bad = {d for d, *_ in passages(single, items)}
    want = {d: t for d, t in single.items() if d not in bad}
    got = {r["doc_id"]: r for r in P.run(spark, sf_dir).collect()}
    own = pieces.Pieces()
    assert {d: pieces.decode(own, r["ids"]) for d, r in got.items()} == want


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    odd = awkward(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        assert out.count() <= odd.count()
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    clean = {r["doc_id"] for r in P.benchmark(spark, docs, sf_dir).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - dirty


def test_signatures_do_not_depend_on_batches():
    texts = [f"text number {i} with some words {i * i}".encode() for i in range(50)]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    every = simhash.signatures(whole, offs)
    one = np.concatenate([simhash.signatures(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    assert (every == one).all()


def test_all_of_unspaced_and_long_runs_counts(spark):
    """Different texts that begin alike, in scripts without spaces and as one long token, are no copies; near copies of them are."""
    rng = random.Random(3)
    alphabets = {"ideographs": [chr(c) for c in range(0x4E00, 0x5A00)], "kana": [chr(c) for c in range(0x3041, 0x3097)], "thai": [chr(c) for c in range(0x0E01, 0x0E2F)], "hex": list("0123456789abcdef"), "letters": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
    rows, copies = [], {}
    for name, letters in alphabets.items():
        head = "".join(rng.choices(letters, k=6))
        for _ in range(6):
            text = head + "".join(rng.choices(letters, k=400))
            rows += [(len(rows), text), (len(rows) + 1, text[:200] + letters[0] + text[201:])]
            copies |= {len(rows) - 2: len(rows) - 2, len(rows) - 1: len(rows) - 2}
    rows += [(900 + i, f"1234567{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _groups(docs) == copies == _brute(docs)


def test_signatures_of_long_texts_do_not_depend_on_slices(monkeypatch):
    text = "".join(random.Random(1).choices("0123456789abcdef", k=5000)).encode()
    whole = simhash.signatures(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(simhash, "SLICE", 999)
    assert (simhash.signatures(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == whole).all()


def test_recall_of_replaced_words_and_no_strangers(spark):
    """Copies with words of other documents in place of 8, 12 and 16 % of their own; documents that share less stay apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    texts = sorted(r["text"] for r in docs.where("text IS NOT NULL").collect() if len(r["text"].split()) >= 30)
    pool = [w for t in rng.sample(texts, 300) for w in t.split()]
    base = rng.sample(texts, 200)
    rows = [(n, t) for n, t in enumerate(base)]
    for k, share in enumerate((0.08, 0.12, 0.16), 1):
        rows += [(1000 * k + n, " ".join(rng.choice(pool) if rng.random() < share else w for w in t.split())) for n, t in enumerate(base)]
    sigs = {r["doc_id"]: np.frombuffer(bytes(r["sig"]), np.uint8).reshape(simhash.RINGS, -1) for r in simhash.signed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = [np.mean([np.bitwise_count(sigs[n] ^ sigs[1000 * k + n]).sum(axis=1).min() <= simhash.LIMIT for n in range(len(base))]) for k in (1, 2, 3)]
    assert got[0] > 0.93 and got[1] > 0.75 and got[2] > 0.4
    words = {r["doc_id"]: set(tokens(r["text"])) for r in docs.collect()}
    assert all(len(words[d] & words[g]) > 0.5 * len(words[d] | words[g]) for d, g in _groups(docs).items() if len(words[d]) >= 30)


def test_every_pair_within_the_limit_is_linked():
    """Signatures of exactly LIMIT and LIMIT + 1 different bits, in any spread over the ring."""
    rng = np.random.default_rng(8)
    for far in (simhash.LIMIT, simhash.LIMIT + 1):
        one = rng.integers(0, 2, (400, simhash.RING_BITS), dtype=np.uint8)
        two = one.copy()
        for r in two:
            r[rng.choice(len(r), far, replace=False)] ^= 1
        seg = simhash.segments(np.packbits(np.concatenate([one, two]), axis=1)).astype(np.uint32)
        known = simhash.Components(len(seg))
        cols = [(((s * 3 + part) << simhash.PART_BITS) | seg[:, s] >> shift & ((1 << width) - 1)) for s in range(simhash.SEGMENTS) for part, (shift, width) in enumerate(simhash.PARTS)]
        simhash.link(np.concatenate(cols).astype(np.int64), np.tile(np.arange(len(seg)), len(cols)), np.tile(seg, (len(cols), 1)), known)
        root = known.find(np.arange(len(seg)))
        assert ((root[:400] == root[400:]) == (far == simhash.LIMIT)).all()


def test_whole_query_equals_brute_force(spark, sf_dir):
    """Signatures, pairs and groups of a whole table, each by its definition."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = components(near({d: signature(t) for d, t in docs.items() if t}, simhash.RINGS, simhash.LIMIT))
    assert {r["doc_id"]: r["group_id"] for r in simhash.op10_simhash(spark, sf_dir).collect()} == want and want


def test_one_id_of_several_texts_joins_their_groups(spark):
    rows = [(1, "the first text that is here twice"), (5, "the first text that is here twice"), (5, "quite another matter altogether, as one may see"), (7, "quite another matter altogether, as one may see"), (9, "alone")]
    assert _groups(spark.createDataFrame(rows, "doc_id long, text string")) == {1: 1, 5: 1, 7: 1}


def test_different_texts_of_other_scripts_stay(spark):
    """Texts that only begin alike, word by word or phrase by phrase, are no copies."""
    rng = random.Random(4)
    letters = "абвгдежзиклмнопрст"
    heads = ["".join(rng.choices(letters, k=3)) for _ in range(60)]
    rows = [(n, " ".join(h + "".join(rng.choices(letters, k=5)) for h in heads)) for n in range(3)]
    rows += [(10 + n, " ".join(h[:3] + "".join(rng.choices("abcdefghij", k=6)) for h in ["str", "con", "pre", "inter"] * 15)) for n in range(3)]
    assert _groups(spark.createDataFrame(rows, "doc_id long, text string")) == {}


def test_large_buckets_are_linked_whole_and_in_few_steps(monkeypatch):
    """Signatures of uneven segments, as those of one language, fall on few keys: all near pairs are linked, without a step for each row."""
    rng = np.random.default_rng(11)
    share = np.repeat(np.where(np.arange(simhash.SEGMENTS) % 2, 0.5, 0.06), simhash.WIDTH)
    bits = (rng.random((6000, simhash.RING_BITS)) < share).astype(np.uint8)
    for k in range(300):  # near copies among them
        bits[5000 + k] = bits[k]
        bits[5000 + k, rng.choice(simhash.RING_BITS, simhash.LIMIT + k % 2, replace=False)] ^= 1
    for k in range(5400, 6000):  # and a large group of them
        bits[k] = bits[4999]
        bits[k, rng.choice(simhash.RING_BITS, 12, replace=False)] ^= 1
    packed = np.packbits(bits, axis=1)
    pairs = near({n: r.tobytes() for n, r in enumerate(packed)}, 1, simhash.LIMIT)
    seg = simhash.segments(packed)
    cols = [(((s * 3 + part) << simhash.PART_BITS) | seg[:, s] >> shift & ((1 << width) - 1)) for s in range(simhash.SEGMENTS) for part, (shift, width) in enumerate(simhash.PARTS)]
    steps, find = [], simhash.Components.find
    monkeypatch.setattr(simhash.Components, "find", lambda self, x: steps.append(1) or find(self, x))
    known = simhash.Components(len(seg))
    simhash.link(np.concatenate(cols).astype(np.int64), np.tile(np.arange(len(seg)), len(cols)), np.tile(seg, (len(cols), 1)), known)
    assert len(steps) < 100_000
    want = components(pairs)
    assert {n: int(r) for n, r in enumerate(known.find(np.arange(len(seg)))) if n in want} == want and len(want) > 900
    assert len(np.unique(known.find(np.arange(len(seg))))) == len(seg) - len(want) + len(set(want.values()))


def test_stage_of_near_copies_on_documents_much_alike(spark, sf_dir, monkeypatch):
    """Documents that share most of their words crowd the buckets: the stage drops what brute force does, and linking takes no step for each row."""
    rng = random.Random(12)
    head = [f"common{k}" for k in range(90)]
    rows = [(n, " ".join(head + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for n in range(4000)]
    rows += [(4000 + n, rows[n][1] + " more") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {r["doc_id"]: bytes(r["sig"]) for r in simhash.signed(docs).collect()}
    group = components(near(sigs, simhash.RINGS, simhash.LIMIT))
    assert {r["doc_id"] for r in P.near_copies(spark, docs, sf_dir).collect()} == {d for d, _ in rows if group.get(d, d) == d}
    steps, find = [], simhash.Components.find
    monkeypatch.setattr(simhash.Components, "find", lambda self, x: steps.append(1) or find(self, x))
    signed = pa.RecordBatch.from_arrays([pa.array(list(sigs)), pa.array(list(sigs.values()), pa.binary())], names=["id", "sig"])
    for b in simhash._buckets(iter([signed])):
        list(simhash._linked(iter([b.take(pa.array(np.argsort(np.asarray(b.column(0)), kind="stable")))])))
    assert len(steps) < 64_000


def test_stage_of_near_copies_verifies_many_pairs_at_once(spark, sf_dir, monkeypatch):
    """A large group of edited copies among documents much alike: the stage drops what brute force does, and pairs are verified many at a time, not block by block."""
    rng = random.Random(13)
    head = [f"common{k}" for k in range(90)]
    rows = [(n, " ".join(head + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for n in range(3000)]
    base = rows[7][1].split()
    rows += [(3000 + n, " ".join(f"new{rng.randrange(10**9)}" if rng.random() < 0.04 else w for w in base)) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {r["doc_id"]: bytes(r["sig"]) for r in simhash.signed(docs).collect()}
    group = components(near(sigs, simhash.RINGS, simhash.LIMIT))
    assert {r["doc_id"] for r in P.near_copies(spark, docs, sf_dir).collect()} == {d for d, _ in rows if group.get(d, d) == d}
    assert sum(g == 7 for g in group.values()) > 300
    calls, within = [], simhash._within
    monkeypatch.setattr(simhash, "_within", lambda seg, at, a, *rest: calls.append(len(a)) or within(seg, at, a, *rest))
    signed = pa.RecordBatch.from_arrays([pa.array(list(sigs)), pa.array(list(sigs.values()), pa.binary())], names=["id", "sig"])
    for b in simhash._buckets(iter([signed])):
        list(simhash._linked(iter([b.take(pa.array(np.argsort(np.asarray(b.column(0)), kind="stable")))])))
    assert len(calls) < 3_000
