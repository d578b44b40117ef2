"""Operator 6: license scans by template-markup matching.

Templates are license texts and notices with two kinds of markup: ``[[...]]`` is an optional region (they nest), ``{{n}}``
a replaceable region of at most n tokens. Each is compiled into an automaton over tokens; a document holds a license where
an automaton accepts a stretch of its tokens, so that the mandatory wording must be there exactly, in order and without
gaps. Case, white space and punctuation don't count, and "licence" is read as "license".

Each template gives its leftmost, longest matches that don't overlap each other; matches of different templates may
overlap. The texts are read once, whole, without a shuffle: the hashes of the token pairs that a match can begin with
select the places where automata are started at all.

Defined cases: null and empty texts match nothing; a null ``doc_id`` is kept as null; repeated rows are scanned alike,
each for itself; other columns are ignored; a template must begin and end with mandatory tokens or optional regions of
them, never with a replaceable region (``ValueError``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import text as X

SCHEMA = "doc_id long, license string, first_token int, n_tokens int"
ALIKE = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense"}
_AS_IS = "provided [[by {{12}}]] as is"
TEMPLATES = {
    "Apache-2.0-notice": "[[This {{4}} is]] licensed under the Apache License [[Version]] 2[[.0]]",
    "MIT-notice": "[[This {{4}} is]] [[licensed]] [[released]] [[distributed]] under the [[terms of the]] MIT license",
    "GPL-3.0-notice": "[[This {{4}} is]] licensed under the GNU General Public License [[,]] [[either]] version 3",
    "GPL-or-later-notice": """This program is free software [[:]] you can redistribute it and or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation [[either]] version {{1}} of the License [[or (at your option) any later version]]""",
    "CC-BY-NC-4.0-notice": "[[This {{4}} is]] licensed under [[a]] [[the]] CC BY-NC 4.0 [[International]] [[License]]",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 [[International]] [[Public]] License",
    "CC-BY-4.0-notice": "[[This {{4}} is]] licensed under [[a]] [[the]] CC BY 4.0 [[International]] [[License]]",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 [[International]] [[Public]] License",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0 [[-only]] [[-or-later]]",
    "MIT": f"""[[MIT License]] [[Copyright {{{{30}}}}]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the {{{{3}}}}), to deal in the {{{{3}}}} without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. [[The software is
        {_AS_IS} without warranty of any kind express or implied]]""",
    "ISC": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies""",
    "BSD-3-Clause": f"""[[Copyright {{{{30}}}}]] Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        [[3.]] Neither the name of {{{{20}}}} nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. [[This software is {_AS_IS}]]""",
    "BSD-2-Clause": """[[Copyright {{30}}]] Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is
        provided by {{12}} as is""",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
_PARTS = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[0-9A-Za-z]+")


def parse(template: str) -> list:
    """A tree: words, numbers (replaceable regions) and lists (optional regions)."""
    stack: list[list] = [[]]
    for m in _PARTS.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            done = stack.pop()
            if not stack:
                raise ValueError("an optional region ends that doesn't begin")
            if done:
                stack[-1].append(done)
        else:
            word = m[0].lower()
            stack[-1].append(int(m[1]) if m[1] else ALIKE.get(word, word))
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    return stack[0]


class Automaton:
    """States are numbers; ``by_token[s]`` leads on by a token's hash, ``by_any[s]`` by any; the last state accepts."""

    def __init__(self, template: str):
        self.by_token: list[dict[int, int]] = [{}]
        self.by_any: list[int] = [-1]
        self.free: list[list[int]] = [[]]
        self.end = self._add(parse(template), 0)
        self.closed = [self._closure({s}) for s in range(len(self.free))]
        for s in self.closed[0]:
            if self.by_any[s] >= 0:
                raise ValueError("a template can't begin with a replaceable region")
        if self.end in self.closed[0]:
            raise ValueError("a template needs mandatory wording")
        if any(self.by_any[s] >= 0 and self.end in self.closed[self.by_any[s]] for s in range(len(self.free))):
            raise ValueError("a template can't end with a replaceable region")

    def _state(self) -> int:
        self.by_token.append({})
        self.by_any.append(-1)
        self.free.append([])
        return len(self.free) - 1

    def _add(self, tree: list, at: int) -> int:
        for part in tree:
            if isinstance(part, list):
                inner = self._state()
                self.free[at].append(inner)
                out = self._add(part, inner)
                skip = self._state()
                self.free[at].append(skip)
                self.free[out].append(skip)
                at = skip
            elif isinstance(part, int):
                last = [at]
                for _ in range(part):
                    self.by_any[at] = self._state()
                    at = self.by_any[at]
                    last.append(at)
                out = self._state()
                for s in last:
                    self.free[s].append(out)
                at = out
            else:
                to = self._state()
                self.by_token[at][int(X.token_hashes(part)[0])] = to
                at = to
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def step(self, now: set[int], token: int) -> set[int]:
        to: set[int] = set()
        for s in now:
            if (nxt := self.by_token[s].get(token)) is not None:
                to |= self.closed[nxt]
            if self.by_any[s] >= 0:
                to |= self.closed[self.by_any[s]]
        return to

    def beginnings(self) -> set[tuple[int, int | None]]:
        """All pairs of tokens that a match can begin with; None: any token, or none."""
        found: set[tuple[int, int | None]] = set()
        for s in self.closed[0]:
            for token in self.by_token[s]:
                now = self.step(set(self.closed[0]), token)
                if self.end in now or any(self.by_any[x] >= 0 for x in now):
                    found.add((token, None))
                else:
                    found |= {(token, second) for x in now for second in self.by_token[x]}
        return found

    def longest(self, tokens: list[int], at: int, end: int) -> int:
        """Where the longest match from ``at`` on ends; ``at`` if there is none."""
        now, best = set(self.closed[0]), at
        for k in range(at, end):
            now = self.step(now, tokens[k])
            if not now:
                break
            if self.end in now:
                best = k + 1
        return best


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.automata = [Automaton(templates[n]) for n in self.names]
        self.first: dict[int, dict[int | None, list[int]]] = {}
        for k, a in enumerate(self.automata):
            for token, second in a.beginnings():
                self.first.setdefault(token, {}).setdefault(second, []).append(k)
        self.alike = [(X.U(int(X.token_hashes(a)[0])), X.U(int(X.token_hashes(b)[0]))) for a, b in ALIKE.items()]
        self.starts = np.array(sorted(self.first), dtype=X.U)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[self.starts >> X.U(48)] = True

    def search(self, first: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(row, license, first token, tokens), in order, in the rows whose tokens are tokens[first[r]:first[r + 1]]."""
        for a, b in self.alike:
            tokens[tokens == a] = b
        at = np.flatnonzero(self.seen[tokens >> X.U(48)])
        at = at[np.isin(tokens[at], self.starts)]
        rows = np.searchsorted(first, at, "right") - 1
        free: dict[tuple[int, int], int] = {}
        for row, p in zip(rows.tolist(), at.tolist(), strict=True):
            lo, end = int(first[row]), int(first[row + 1])
            seconds = self.first[int(tokens[p])]
            which = [*seconds.get(None, ()), *(seconds.get(int(tokens[p + 1]), ()) if p + 1 < end else ())]
            if not which:
                continue
            for k in sorted(set(which)):
                if p < free.get((row, k), 0):
                    continue
                stop = self.automata[k].longest(tokens, p, end)
                if stop > p:
                    free[row, k] = stop
                    yield row, self.names[k], p - lo, stop - p


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_token, n_tokens) of every match in ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = X.utf8(b.column(1))
            out: list[tuple] = []
            for i, j in X.chunks(offs):
                t = X.Tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out += [(i + r, *rest) for r, *rest in shipped.value.search(t.first, t.hash)]
            row, name, first, n = list(zip(*out, strict=True)) or [()] * 4
            ids = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "license", "first_token", "n_tokens"])

    return X.id_text(docs).where("text IS NOT NULL").mapInArrow(scan, SCHEMA)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pattern(tree: list) -> str:
    """The regular expression of a template over tokens written ``<token>``."""
    out = []
    for part in tree:
        if isinstance(part, list):
            out.append(f"(?:{pattern(part)})?")
        elif isinstance(part, int):
            out.append(f"(?:<[^<>]*>){{0,{part}}}")
        else:
            out.append(f"<{part}>")
    return "".join(out)


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same matches by regular expressions over each text's tokens, in DuckDB's SQL."""
    own = TEMPLATES if templates is None else templates
    forms = ", ".join(f"('{n}', '{pattern(parse(t))}')" for n, t in sorted(own.items()))
    norm = r"regexp_replace(lower(text), '[^0-9a-z\x{00C0}-\x{1FFF}\x{2070}-\x{10FFFF}]+', ' ', 'g')"
    norm = f"'<' || replace(trim({norm}), ' ', '><') || '>'"
    for a, b in ALIKE.items():
        norm = f"replace({norm}, '<{a}>', '<{b}>')"
    branches = []
    for name, template in sorted(own.items()):
        form = pattern(parse(template))
        branches.append(
            f"SELECT doc_id, '{name}' AS license, unnest(list_zip(regexp_extract_all(norm, '(?s)(.*?)({form})', 1), regexp_extract_all(norm, '(?s)(.*?)({form})', 2))) AS m, "
            f"generate_subscripts(regexp_extract_all(norm, '(?s)(.*?)({form})', 2), 1) AS i, r FROM docs WHERE regexp_matches(norm, '{form}')"
        )
    tokens = lambda x: f"(length({x}) - length(replace({x}, '<', '')))"
    return f"""
WITH docs AS (SELECT doc_id, {norm} AS norm, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
found AS ({" UNION ALL ".join(branches)}),
sized AS (SELECT doc_id, license, r, i, {tokens("m[1]")} AS gap, {tokens("m[2]")} AS n FROM found)
SELECT doc_id, license,
  CAST(sum(gap + n) OVER (PARTITION BY r, license ORDER BY i) - n AS INTEGER) AS first_token, CAST(n AS INTEGER) AS n_tokens
FROM sized"""
