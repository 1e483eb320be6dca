"""A small language of page predicates, compiled to Columns.

    expr  := unary (("&" | "and" | "|" | "or") unary)*      all of one precedence, left to right
    unary := ("!" | "not") unary | "(" expr ")" | leaf
    leaf  := name-contains S | name-has-prefix S | name-has-suffix S | name-in-set [S, ..]
           | pageid-in-set [S, ..] | category-contains S | page-hash-mod N K [SALT]
           | train-set | test-set | fold K | is-redirect | is-disambiguation | is-category | true
           | name-set-from-file F | pageid-set-from-file F | category-contains-from-file F

Compiled to plain Columns, so Catalyst simplifies and pushes them.  ``name-contains`` folds
both sides; ``category-contains`` folds only what is searched for.  Sets from files are read
one value a line, blank lines dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_bucket

TOKEN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([()\[\],!&|])|([^\s()\[\],!&|"]+))')
WORDS = {"&": "and", "and": "and", "|": "or", "or": "or"}
FOLD_SALT = "fold"


@dataclass
class Pages:
    """The columns that predicates look at."""

    name: Column
    page_id: Column
    page_type: Column
    categories: Column


def _lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


class _Parser:
    def __init__(self, text: str, pages: Pages, read: Callable[[str], list[str]]) -> None:
        self.tokens: list[tuple[str, bool]] = []  # (text, quoted)
        at = 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read predicate at: {text[at:]!r}")
            self.tokens.append((re.sub(r"\\(.)", r"\1", m[1]), True) if m[1] is not None else (m[2] or m[3], False))
            at = m.end()
        self.at, self.pages, self.read = 0, pages, read

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) and not self.tokens[self.at][1] else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("the predicate ends too early")
        self.at += 1
        return self.tokens[self.at - 1][0]

    def expect(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"{sign!r} expected")
        self.at += 1

    def expression(self) -> Column:
        left = self.unary()
        while (op := WORDS.get(self.peek() or "")) is not None:
            self.at += 1
            right = self.unary()
            left = (left & right) if op == "and" else (left | right)
        return left

    def unary(self) -> Column:
        if self.peek() in ("!", "not"):
            self.at += 1
            return ~self.unary()
        if self.peek() == "(":
            self.at += 1
            inner = self.expression()
            self.expect(")")
            return inner
        return self.leaf(self.take())

    def values(self) -> list[str]:
        self.expect("[")
        out = []
        while self.peek() != "]":
            out.append(self.take())
            if self.peek() == ",":
                self.at += 1
        self.at += 1
        return out

    def leaf(self, word: str) -> Column:
        p = self.pages
        one_of = lambda col, values: col.isin(values) if values else F.lit(False)
        in_category = lambda s: F.exists(p.categories, lambda c: F.contains(c, F.lit(s.lower())))
        match word:
            case "true":
                return F.lit(True)
            case "name-contains":
                return F.contains(F.lower(p.name), F.lit(self.take().lower()))
            case "name-has-prefix":
                return p.name.startswith(self.take())
            case "name-has-suffix":
                return p.name.endswith(self.take())
            case "name-in-set":
                return one_of(p.name, self.values())
            case "pageid-in-set":
                return one_of(p.page_id, self.values())
            case "name-set-from-file":
                return one_of(p.name, self.read(self.take()))
            case "pageid-set-from-file":
                return one_of(p.page_id, self.read(self.take()))
            case "category-contains" | "category-contain":
                return in_category(self.take())
            case "category-contains-from-file":
                found = [in_category(s) for s in self.read(self.take())]
                out = F.lit(False)
                for c in found:
                    out = out | c
                return out
            case "page-hash-mod":
                n, k = int(self.take()), int(self.take())
                if not 0 <= k < n:
                    raise ValueError("page-hash-mod needs 0 <= K < N")
                salt = self.take() if self.at < len(self.tokens) and (self.tokens[self.at][1] or re.fullmatch(r"\w+", self.tokens[self.at][0]) and self.tokens[self.at][0] not in WORDS) else ""
                return stable_bucket(p.name, n, salt) == k
            case "train-set" | "test-set":
                return stable_bucket(p.name, 2, FOLD_SALT) == int(word == "test-set")
            case "fold":
                return F.floor(stable_bucket(p.name, 10, FOLD_SALT) / 2) == int(self.take())
            case "is-redirect" | "is-disambiguation" | "is-category":
                return p.page_type == word.removeprefix("is-")
        raise ValueError(f"unknown predicate {word!r}")


def compile_predicate(text: str, pages: Pages, read: Callable[[str], list[str]] = _lines) -> Column:
    parser = _Parser(text, pages, read)
    out = parser.expression()
    if parser.at != len(parser.tokens):
        raise ValueError(f"unread rest of the predicate: {parser.tokens[parser.at:]}")
    return out


def keep_listed(pages: DataFrame, column: str, values: DataFrame, drop: bool = False) -> DataFrame:
    """Pages whose ``column`` is among the rows of the one-column ``values``, or is not if ``drop``.

    For sets too large for literals (``name-set-from-file`` puts each line into the plan): the
    set stays a table and is joined.
    """
    listed = values.select(F.trim(F.col(values.columns[0]).cast("string")).alias("_listed")).where("_listed <> ''").distinct()
    return pages.join(listed, F.col(column) == F.col("_listed"), "left_anti" if drop else "left_semi")
