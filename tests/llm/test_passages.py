"""Operators 1 and 2 against brute force."""

from __future__ import annotations

import random

from brute import awkward, deduplicated, passages
from vecspark.llm import decontaminate, linededup

WORDS = [f"word{i}" for i in range(40)]


def _benchmark(rng):
    return {i: " ".join(rng.choices(WORDS, k=n)) for i, n in enumerate([4, 5, 8, 12, 13, 14, 20, 60])}


def _covered(rows) -> set:
    return {(r["doc_id"], r["item_id"], r["doc_token"] + k, r["item_token"] + k) for r in rows for k in range(r["n_tokens"])}


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(7)
    items = _benchmark(rng)
    docs = {}
    for d in range(60):
        text = rng.choices(WORDS, k=rng.choice([0, 3, 12, 13, 40]))
        own = items[rng.randrange(len(items))].split()
        lo = rng.randrange(max(1, len(own) - 13))
        part = own[lo : lo + rng.choice([5, 12, 13, 16, 60])]
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            part[rng.randrange(len(part))] = "other"
        docs[d] = ", ".join(text[: len(text) // 2] + part + text[len(text) // 2 :]).upper() + "."
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    expected = passages(docs, items)
    # a region spans the gap between windows that lie at most one window apart
    assert {x[:2] for x in expected} == {(r["doc_id"], r["item_id"]) for r in found}
    assert expected <= _covered(found)
    assert all(r["n_mismatches"] <= r["n_tokens"] // 2 for r in found)


def test_more_slices_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = _benchmark(rng)
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in items.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()) + [(9, None), (None, "a b c d e f"), (10, "")], "item_id long, text string")
    whole = sorted(decontaminate.contaminated(df, bench).collect())
    monkeypatch.setattr(decontaminate, "SLICE", 200)
    assert sorted(decontaminate.contaminated(df, bench).collect()) == whole and len(whole) >= 7


def test_decontamination_of_awkward_tables(spark):
    words = " ".join(f"w{i * 7919 % 10007}" for i in range(500, 520))
    bench = spark.createDataFrame([(1, words), (1, words), (2, "漢字 and 😀")], "item_id long, text string")
    found = decontaminate.contaminated(awkward(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4, 1)} and found[0]["n_tokens"] >= 20
    assert decontaminate.contaminated(awkward(spark).limit(0), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0


def _cleaned(spark, docs) -> dict:
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in linededup.cleaned(df).collect()}


def test_line_dedup_equals_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        lines = [" ".join(rng.choices(WORDS, k=rng.choice([1, 5, 9, 30, 70]))) for _ in range(14)]
        docs = {d: "\n".join(rng.choice([*lines, "", "  ", f"unique {d} {rng.random()}"]) for _ in range(rng.randrange(1, 14))) for d in range(40)}
        for d in (3, 21, 30):
            docs[d] = "\n".join(lines[2:9])
        strip = lambda t: [x.strip() for x in t.split("\n") if x.strip()]
        got, want = _cleaned(spark, docs), deduplicated(docs)
        assert {d: strip(t) for d, t in got.items()} == {d: strip(t) for d, t in want.items()}


def test_line_dedup_of_awkward_tables(spark):
    para = "\n".join(f"line {i} has some words of its own here" for i in range(6))
    df = awkward(spark, [(10, para), (11, "head\n" + para + "\n\ntail"), (11, "head\n" + para + "\n\ntail"), (None, para)])
    out = linededup.cleaned(df)
    assert out.columns == [*df.columns, "__cut_lines"] and out.count() == df.count()
    rows = [(r["doc_id"], r["text"], r["__cut_lines"]) for r in out.where("doc_id IS NULL OR doc_id IN (1, 2, 10, 11)").collect()]
    assert sorted(rows, key=repr) == sorted([(1, None, 0), (2, "", 0), (None, "a text without an id", 0), (None, None, 0), (None, para, 0), (10, para, 0)] + 2 * [(11, "head\n\ntail", 6)], key=repr)
    assert linededup.cleaned(df.limit(0)).count() == 0
