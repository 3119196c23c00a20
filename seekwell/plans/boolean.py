"""Boolean queries: a grammar, an expression tree, and its plan over lines or over files.

Precedence is NOT over OR over AND; a blank is AND, ``|`` and a line feed are OR, ``-`` negates; the words
AND, OR and NOT work where white space follows; quotes make a literal; a parenthesis groups where its closing one
stands before a blank, ``|``, ``)`` or the end, and is a part of the pattern elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SearchOptions
from ..operators.lines import lines, lines_array
from .predicates import predicate


@dataclass(frozen=True)
class Pattern:
    text: str
    literal: bool = False


@dataclass(frozen=True)
class Not:
    of: "Expr"


@dataclass(frozen=True)
class And:
    of: tuple["Expr", ...]


@dataclass(frozen=True)
class Or:
    of: tuple["Expr", ...]


Expr = Pattern | Not | And | Or


class QueryError(ValueError):
    """The query isn't well formed."""


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def blank(self, line_feeds: bool = False) -> None:
        while self.i < len(self.s) and self.s[self.i] in (" \t\r\n" if line_feeds else " \t\r"):
            self.i += 1

    def operator(self, word: str) -> bool:
        """Take a word operator that white space follows."""
        end = self.i + len(word)
        if self.s.startswith(word, self.i) and end < len(self.s) and self.s[end].isspace():
            self.i = end
            return True
        return False

    def conjunction(self) -> Expr:
        parts = [self.disjunction()]
        while True:
            self.blank()
            self.operator("AND")
            self.blank()
            if self.i >= len(self.s) or self.s[self.i] == ")":
                break
            parts.append(self.disjunction())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def disjunction(self) -> Expr:
        parts = [self.negation()]
        while True:
            at = self.i
            self.blank()
            if self.i < len(self.s) and self.s[self.i] in "|\n":
                self.i += 1
                self.blank(True)
                if self.i >= len(self.s) or self.s[self.i] == ")":
                    break
            elif not self.operator("OR"):
                self.i = at
                break
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def negation(self) -> Expr:
        self.blank(True)
        if self.operator("NOT"):
            return Not(self.negation())
        if self.s.startswith("-", self.i) and self.i + 1 < len(self.s) and not self.s[self.i + 1].isspace():
            self.i += 1
            return Not(self.atom())
        return self.atom()

    def closing(self, start: int) -> int:
        depth, j = 0, start
        while j < len(self.s):
            c = self.s[j]
            if c == "\\":
                j += 1
            elif c == "[":
                k = self.s.find("]", j + 2)
                j = k if k >= 0 else j
            elif c == '"':
                k = self.s.find('"', j + 1)
                j = k if k >= 0 else j
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    return j
            j += 1
        return -1

    def groups(self) -> bool:
        if not self.s.startswith("(", self.i) or self.s.startswith("(?", self.i):
            return False
        end = self.closing(self.i)
        return end >= 0 and (end + 1 == len(self.s) or self.s[end + 1] in " \t\r\n|)")

    def atom(self) -> Expr:
        self.blank()
        if self.groups():
            self.i += 1
            inner = self.conjunction()
            self.blank(True)
            if not self.s.startswith(")", self.i):
                raise QueryError(f"missing ) in {self.s!r}")
            self.i += 1
            return inner
        if self.s.startswith('"', self.i):
            out, j = [], self.i + 1
            while j < len(self.s) and self.s[j] != '"':
                if self.s[j] == "\\" and self.s[j + 1 : j + 2] == '"':
                    j += 1
                out.append(self.s[j])
                j += 1
            if j >= len(self.s):
                raise QueryError(f'missing " in {self.s!r}')
            self.i = j + 1
            return Pattern("".join(out), True)
        start, depth = self.i, 0
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 2
                continue
            if c == "[":
                k = self.s.find("]", self.i + 2)
                if k >= 0:
                    self.i = k + 1
                    continue
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and c in " \t\r\n|":
                break
            self.i += 1
        return Pattern(self.s[start : self.i])


def parse(query: str) -> Expr:
    p = _Parser(query)
    out = p.conjunction()
    p.blank(True)
    if p.i < len(p.s):
        raise QueryError(f"unexpected {p.s[p.i]!r} at {p.i} in {query!r}")
    return out


def from_terms(terms: list[tuple[list[str], list[str]]]) -> Expr:
    """Option lists as an expression: each term holds if one of its patterns matches or one of its negated ones doesn't."""
    made = []
    for alts, nots in terms:
        parts = [*(Pattern(a) for a in alts), *(Not(Pattern(n)) for n in nots)]
        if parts:
            made.append(parts[0] if len(parts) == 1 else Or(tuple(parts)))
    return made[0] if len(made) == 1 else And(tuple(made))


def patterns(e: Expr) -> list[Pattern]:
    """Distinct patterns in order of appearance."""
    if isinstance(e, Pattern):
        return [e]
    return list(dict.fromkeys(p for x in ([e.of] if isinstance(e, Not) else e.of) for p in patterns(x)))


def evaluate(e: Expr, of: Callable[[Pattern], bool]) -> bool:
    if isinstance(e, Pattern):
        return of(e)
    if isinstance(e, Not):
        return not evaluate(e.of, of)
    return (all if isinstance(e, And) else any)(evaluate(x, of) for x in e.of)


def combine(e: Expr, of: Callable[[Pattern], Column]) -> Column:
    """The tree as one Catalyst condition, which Catalyst simplifies."""
    if isinstance(e, Pattern):
        return of(e)
    if isinstance(e, Not):
        return ~combine(e.of, of)
    parts = [combine(x, of) for x in e.of]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(e, And) else out | p
    return out


def to_cnf(e: Expr, negated: bool = False) -> list[list[Expr]]:
    """Terms of alternatives, each a pattern or its negation, for explanation; tautologies (an empty pattern) vanish."""
    if isinstance(e, Not):
        return to_cnf(e.of, not negated)
    if isinstance(e, Pattern):
        return [] if e.text == "" and not negated else [[Not(e) if negated else e]]
    parts = [to_cnf(x, negated) for x in e.of]
    if isinstance(e, And) != negated:
        return [t for p in parts for t in p]
    return [list(dict.fromkeys(x for t in pick for x in t)) for pick in product(*parts)] if all(parts) else []


def explain(e: Expr) -> str:
    """The query in words, one term a line."""
    show = lambda x: f"NOT {x.of.text!r}" if isinstance(x, Not) else repr(x.text)
    terms = to_cnf(e)
    return "\nAND ".join(" OR ".join(map(show, t)) for t in terms) if terms else "everything"


def _options(p: Pattern, base: SearchOptions) -> SearchOptions:
    return base.with_(patterns=(p.text,), dialect="fixed" if p.literal else base.dialect, invert=False)


def _tester(p: Pattern, base: SearchOptions) -> Callable[[Column], Column]:
    return lambda x: predicate(x, _options(p, base))


def line_condition(e: Expr, column="line", base: SearchOptions = SearchOptions()) -> Column:
    """The query on one line."""
    column = F.col(column) if isinstance(column, str) else column
    out = combine(e, lambda p: predicate(column, _options(p, base)))
    return ~out if base.invert else out


def any_pattern(e: Expr, column="line", base: SearchOptions = SearchOptions()) -> Column:
    """Whether a line matches any pattern of the query, negated or not: what is shown of a selected file."""
    out = None
    for p in patterns(e):
        c = predicate(column, _options(p, base))
        out = c if out is None else out | c
    return out


def matching_files(df: DataFrame, e: Expr, *, key: str = "key", text: str = "text", base: SearchOptions = SearchOptions()) -> DataFrame:
    """Keys of the files for which the query holds, a pattern being true if some line of the file matches it.

    Lines are tested within their row; one combining aggregation unites rows of a key."""
    atoms = {p: f"a{i}" for i, p in enumerate(patterns(e))}
    tested = df.select(F.col(key), *(F.exists(lines_array(text), _tester(p, base)).alias(a) for p, a in atoms.items()))
    by = tested.groupBy(key).agg(*(F.coalesce(F.bool_or(a), F.lit(False)).alias(a) for a in atoms.values()))
    found = combine(e, lambda p: F.col(atoms[p]))
    return by.filter(~found if base.invert else found).select(key)


def file_lines(df: DataFrame, e: Expr, *, key: str = "key", text: str = "text", base: SearchOptions = SearchOptions()) -> DataFrame:
    """Lines, with any pattern of the query, of the files for which it holds."""
    files = matching_files(df, e, key=key, text=text, base=base)
    return lines(df.join(files, key, "left_semi"), key=key, text=text).filter(any_pattern(e, "line", base))
