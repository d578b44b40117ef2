"""Metadata filter expressions: a small language, compiled to one Catalyst predicate.

``country == 'BG' && (year >= 2020 || city NOT IN ['Sofia']) && NOT(missing IS NULL)``. AND binds tighter than OR. Leaves are
two-valued: an expression never gives null.

Null semantics. ``sql`` (the default): a missing key satisfies only !=, NIN and IS NULL. ``ordered``: a missing key is less
than any value, so it satisfies <, <= and != as well, and == against null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("==", "!=", "<", "<=", ">", ">=", "in", "nin", "isnull", "isnotnull")
_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<op>==|!=|<>|<=|>=|&&|\|\||[<>=()\[\],!])"""
    r"""|(?P<name>[A-Za-z_][\w.-]*))"""
)


@dataclass(frozen=True)
class Leaf:
    key: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def _tokens(text: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the filter at {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Takes the next token if it is one of these words, in any case."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.peek().lower() in words:
            self.at += 1
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.word(*words):
            raise ValueError(f"the filter has {self.peek()!r} where {words[0]!r} should be")

    def either(self):
        parts = [self.both()]
        while self.word("||", "or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.one()]
        while self.word("&&", "and"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def one(self):
        if self.word("not", "!"):
            return Not(self.one())
        if self.word("("):
            inner = self.either()
            self.expect(")")
            return inner
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in ("name", "string"):
            raise ValueError(f"the filter has {self.peek()!r} where a key should be")
        kind, key = self.tokens[self.at]
        key = key if kind == "name" else _unquoted(key)
        self.at += 1
        if self.word("is"):
            negated = self.word("not")
            self.expect("null")
            return Leaf(key, "isnotnull" if negated else "isnull")
        if self.word("isnull"):
            return Leaf(key, "isnull")
        if self.word("isnotnull"):
            return Leaf(key, "isnotnull")
        if self.word("not"):
            self.expect("in")
            return Leaf(key, "nin", self.values())
        if self.word("in"):
            return Leaf(key, "in", self.values())
        if self.word("nin"):
            return Leaf(key, "nin", self.values())
        for op, same in (("==", ("==", "=")), ("!=", ("!=", "<>")), ("<=", ("<=",)), (">=", (">=",)), ("<", ("<",)), (">", (">",))):
            if self.word(*same):
                return Leaf(key, op, self.value())
        raise ValueError(f"the filter has {self.peek()!r} where a comparison should be")

    def values(self) -> tuple:
        if not self.word("[", "("):
            return (self.value(),)
        out = []
        while not self.word("]", ")"):
            out.append(self.value())
            self.word(",")
        return tuple(out)

    def value(self) -> Any:
        if self.at >= len(self.tokens):
            raise ValueError("the filter ends where a value should be")
        kind, raw = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return _unquoted(raw)
        if kind == "number":
            return float(raw) if re.search("[.eE]", raw) else int(raw)
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        if raw.lower() == "null":
            return None
        raise ValueError(f"the filter has {raw!r} where a value should be")


def _unquoted(raw: str) -> str:
    return re.sub(r"\\(.)", r"\1", raw[1:-1].replace("''", "'") if raw[0] == "'" else raw[1:-1])


def parse(text: str):
    """The tree of a filter's text; bad text raises ``ValueError``."""
    p = _Parser(text)
    tree = p.either()
    if p.at < len(p.tokens):
        raise ValueError(f"the filter goes on with {p.peek()!r}")
    return tree


def columns(name: str) -> Column:
    """Keys that are columns."""
    return F.col(name)


def json(column: str = "metadata") -> Callable[[str], Column]:
    """Keys that are fields of a JSON text column; a field that is absent, or JSON null, is missing."""
    return lambda key: F.get_json_object(column, "$['" + key.replace("'", "") + "']")


def compile(tree: Any, field: Callable[[str], Column] = columns, null_semantics: str = "sql") -> Column:
    """The predicate of a tree, or of a text."""
    if null_semantics not in ("sql", "ordered"):
        raise ValueError(f"unknown null semantics {null_semantics!r}")
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, And | Or):
        parts = [compile(p, field, null_semantics) for p in tree.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(tree, And) else out | p
        return out
    if isinstance(tree, Not):
        return ~compile(tree.of, field, null_semantics)
    if tree.op not in OPS:
        raise ValueError(f"unknown comparison {tree.op!r}")
    return _leaf(field(tree.key), tree.op, tree.value, null_semantics == "ordered")


def _compare(x: Column, op: str, value: Any) -> Column:
    """Numbers as numbers where the field is one, else as text."""
    if isinstance(value, bool):
        x, v = F.lower(x.cast("string")), F.lit(str(value).lower())
    elif isinstance(value, int | float):
        number = x.cast("string").try_cast("double")
        return F.when(number.isNotNull(), _apply(number, op, F.lit(float(value)))).otherwise(_apply(x.cast("string"), op, F.lit(str(value))))
    else:
        x, v = x.cast("string"), F.lit(str(value))
    return _apply(x, op, v)


def _apply(x: Column, op: str, v: Column) -> Column:
    return {"==": x == v, "!=": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]


def _leaf(x: Column, op: str, value: Any, ordered: bool) -> Column:
    if op == "isnull":
        return x.isNull()
    if op == "isnotnull":
        return x.isNotNull()
    if op in ("in", "nin"):
        values = list(value) if isinstance(value, list | tuple | set | frozenset) else [value]
        hit = F.lit(False)
        for v in values:
            hit = hit | (x.isNull() if v is None else F.coalesce(_compare(x, "==", v), F.lit(False)))
        return hit if op == "in" else ~hit
    if value is None:
        same, more = x.isNull(), x.isNotNull()
        return {"==": same, "!=": more, "<": F.lit(False), "<=": same, ">": more, ">=": F.lit(True)}[op] if ordered else {"==": same, "!=": more}.get(op, F.lit(False))
    missing = op in ("!=", "<", "<=") if ordered else op == "!="
    return F.coalesce(_compare(x, op, value), F.lit(missing))
