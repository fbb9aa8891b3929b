"""A small rule language compiled to columns.

    choice   := both ("or" both)*            value    := term (("+" | "-") term)*
    both     := denial ("and" denial)*       term     := signed (("*" | "/") signed)*
    denial   := "not" denial | relation      signed   := ("-" | "+") signed | atom
    relation := value [operator value]       atom     := number | name | "shift" "(" name "," ["-"] number ")" | "(" choice ")"

A text is read token by token into a tree whose nodes know whether they are numbers or truths; types are checked while the
tree is built, so nothing is compiled that does not make sense. A name is a column of the frame first, then a knob.
Comparisons with a missing side are false, except ``!=``, which is true; x / 0 is an infinity of the sign of x, and 0 / 0 is
missing. A number stands for a truth where one is asked for: true if it is there and not zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.nulls import differs, holds

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])|(?P<name>[^\W\d]\w*)|(?P<sign><=|>=|==|!=|[-+*/<>(),]))")
_WORDS = {"and", "or", "not", "shift"}
_RELATIONS = {"<", "<=", ">", ">=", "==", "!="}
NUMBER, TRUTH = "number", "truth"


@dataclass(frozen=True)
class Node:
    """A typed part of a rule and how to make its column."""

    kind: str
    column: Callable[[], Column]

    def truth(self) -> Column:
        return holds(self.column() if self.kind == TRUTH else self.column() != 0)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of every token; what is none is an error, and so is any text after the last one."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in {text!r}: {text[at:end].strip()[:10]!r}")
        kind = m.lastgroup
        out.append(("word" if kind == "name" and m[kind] in _WORDS else kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


def _quotient(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def _related(sign: str, a: Column, b: Column) -> Column:
    if sign == "!=":
        return differs(a, b)
    low = a < b if sign in ("<", "<=") else a > b
    return holds(a == b if sign == "==" else (low | (a == b)) if sign.endswith("=") else low)


class _Reader:
    """One pass over the tokens of a text, one method per rule of the grammar."""

    def __init__(self, text: str, compiler: Compiler):
        self.text, self.of, self.rest = text, compiler, tokens(text)[::-1]

    def whole(self) -> Node:
        node = self.choice()
        self.take("end")
        return node

    def sees(self, *what: str) -> bool:
        return self.rest[-1][1] in what and self.rest[-1][0] in ("sign", "word")

    def take(self, kind: str, value: str | None = None) -> str:
        got = self.rest[-1]
        if got[0] != kind or value is not None and got[1] != value:
            raise ValueError(f"not allowed in {self.text!r}: {got[1] or 'its end'!r}, where {value or kind} should be")
        if kind != "end":
            self.rest.pop()
        return got[1]

    def number(self, node: Node) -> Column:
        if node.kind != NUMBER:
            raise ValueError(f"not allowed in {self.text!r}: a truth where a number should be")
        return node.column()

    def _chain(self, part: Callable[[], Node], word: str, join: Callable[[Column, Column], Column]) -> Node:
        node = part()
        while self.sees(word):
            self.rest.pop()
            a, b = node.truth(), part().truth()
            node = Node(TRUTH, lambda a=a, b=b: join(a, b))
        return node

    def choice(self) -> Node:
        return self._chain(self.both, "or", lambda a, b: a | b)

    def both(self) -> Node:
        return self._chain(self.denial, "and", lambda a, b: a & b)

    def denial(self) -> Node:
        if not self.sees("not"):
            return self.relation()
        self.rest.pop()
        inner = self.denial().truth()
        return Node(TRUTH, lambda: ~inner)

    def relation(self) -> Node:
        left = self.value()
        if not self.sees(*_RELATIONS):
            return left
        sign, a = self.rest.pop()[1], self.number(left)
        b = self.number(self.value())
        return Node(TRUTH, lambda: _related(sign, a, b))

    def value(self) -> Node:
        node = self.term()
        while self.sees("+", "-"):
            sign, a = self.rest.pop()[1], self.number(node)
            b = self.number(self.term())
            node = Node(NUMBER, lambda a=a, b=b, sign=sign: a + b if sign == "+" else a - b)
        return node

    def term(self) -> Node:
        node = self.signed()
        while self.sees("*", "/"):
            sign, a = self.rest.pop()[1], self.number(node)
            b = self.number(self.signed())
            node = Node(NUMBER, lambda a=a, b=b, sign=sign: a * b if sign == "*" else _quotient(a, b))
        return node

    def signed(self) -> Node:
        if not self.sees("+", "-"):
            return self.atom()
        sign = self.rest.pop()[1]
        inner = self.number(self.signed())
        return Node(NUMBER, lambda: -inner if sign == "-" else inner)

    def atom(self) -> Node:
        kind, value = self.rest[-1]
        if kind == "number":
            self.rest.pop()
            return Node(NUMBER, lambda: F.lit(float(value)))
        if kind == "name":
            self.rest.pop()
            return self.of.named(value, self.text)
        if self.sees("shift"):
            return self.shifted()
        self.take("sign", "(")
        node = self.choice()
        self.take("sign", ")")
        return node

    def shifted(self) -> Node:
        self.rest.pop()
        self.take("sign", "(")
        name = self.take("name")
        self.take("sign", ",")
        back = -1 if self.sees("-") else 1
        if back < 0:
            self.rest.pop()
        by = self.take("number")
        self.take("sign", ")")
        if name not in self.of.columns or not by.isdigit():
            raise ValueError(f"not allowed in {self.text!r}: shift takes a column and a whole number")
        return Node(NUMBER, lambda: F.lag(F.col(f"`{name}`").cast("double"), back * int(by)).over(self.of.series))


class Compiler:
    """Compiles expressions over the columns of one frame; ``series`` is the window rows are shifted in."""

    def __init__(self, columns: list[str], knobs: dict[str, float], series):
        self.columns, self.knobs, self.series = set(columns), knobs, series

    def named(self, name: str, text: str) -> Node:
        if name in self.columns:
            return Node(NUMBER, lambda: F.col(f"`{name}`").cast("double"))
        if name in self.knobs:
            return Node(NUMBER, lambda: F.lit(float(self.knobs[name])))
        raise ValueError(f"unknown name {name!r} in {text!r}")

    def column(self, text: str) -> Column:
        return _Reader(text, self).whole().column()

    def condition(self, text: str) -> Column:
        return _Reader(text, self).whole().truth()
