"""Fuzzy search: matches within a number of edits, at the least cost.

An insertion is an extra character in the text, a deletion a missing one, a substitution another one; each
kind can be turned off.  The first character must match exactly, and line ends and NUL are never edited.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SearchOptions
from .find import Finder, emit
from .regex import compile_patterns


def fuzzy_pattern(p: str, most: int, *, insertions: bool = True, deletions: bool = True, substitutions: bool = True) -> str:
    """The finder's fuzzy form of a translated pattern; its first atom stays exact."""
    kinds = [k for k, on in (("i", insertions), ("d", deletions), ("s", substitutions)) if on] or ["i", "d", "s"]
    limits = ",".join(f"{k}<={most}" for k in kinds) + f",e<={most}"
    m = regex.match(r"(?:\\[\\\W]|[^\\\[\](){}.*+?^$|])(?![*+?{])", p)
    head, rest = (p[: m.end()], p[m.end() :]) if m else ("", p)
    if not rest:
        return head
    return f"{head}(?:{rest}){{{limits}:[^\\n\\x00]}}"


class FuzzyFinder(Finder):
    def __init__(self, c, o: SearchOptions, most: int, **kinds):
        super().__init__(c, o)
        flags = regex.VERSION1 | regex.MULTILINE | regex.BESTMATCH | (regex.IGNORECASE if c.ignore_case else 0)
        self.alternatives = [regex.compile(fuzzy_pattern(p, most, **kinds), flags) for p in c.finder]

    def spans(self, text: str) -> Iterator[tuple[int, int, int, object]]:
        """Line by line; within a line from left to right, each the best from its start on."""
        at = 0
        for line in text.split("\n"):
            p = 0
            while p <= len(line):
                found = [(m.start(), sum(m.fuzzy_counts), i, m) for i, a in enumerate(self.alternatives, 1) if (m := a.search(line, p))]
                if not found:
                    break
                _, _, i, m = min(found, key=lambda x: x[:3])
                if m.end() > m.start():
                    yield at + m.start(), at + m.end(), i, m
                p = m.end() if m.end() > m.start() else m.end() + 1
            at += len(line) + 1

    def records(self, text: str) -> Iterator[dict]:
        cost = {s: sum(m.fuzzy_counts) for s, _, _, m in self.spans(text)}
        starts, p = [0], text.find("\n")
        while p >= 0:
            starts.append(p + 1)
            p = text.find("\n", p + 1)
        offsets = {}
        for s in cost:
            line = bisect_right(starts, s) - 1
            offsets[len(text[:s].encode()) if not text.isascii() else s] = (line, cost[s])
        for r in super().records(text):
            yield r | {"cost": offsets[r["byte_off"]][1]}


def fuzzy_matches(df: DataFrame, options: SearchOptions, most: int = 1, *, text: str = "text", keep: list[str] = ("key",), insertions: bool = True, deletions: bool = True, substitutions: bool = True) -> DataFrame:
    """As ``find_matches`` with ``cost``, the edits of each match."""
    if not 0 <= most <= 255:
        raise ValueError("edits must be 0 to 255")
    compiled = compile_patterns(options)
    return emit(df, text, list(keep), lambda: FuzzyFinder(compiled, options, most, insertions=insertions, deletions=deletions, substitutions=substitutions).records)


def best_only(matches: DataFrame, key: str = "key") -> DataFrame:
    """Matches at their file's least cost."""
    return matches.withColumn("best", F.min("cost").over(W.partitionBy(key))).filter("cost = best").drop("best")


def sorted_by_cost(matches: DataFrame, key: str = "key") -> DataFrame:
    """Files by least cost, then name, matches in their order."""
    return matches.withColumn("best", F.min("cost").over(W.partitionBy(key))).orderBy("best", key, "line_no", "match_no")


def fuzzy_words(df: DataFrame, word: str, most: int, *, text: str = "text", key: str = "key", ignore_case: bool = False) -> DataFrame:
    """Fast path for one whole word: (key, word, cost) of the words within ``most`` edits and the same first letter, in the JVM."""
    fold = F.lower if ignore_case else (lambda c: c)
    words = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), F.lit(0))).alias("word"))
    cost = F.levenshtein(fold(F.col("word")), F.lit(word.lower() if ignore_case else word), most)
    words = words.filter(F.left(fold(F.col("word")), F.lit(1)) == (word[:1].lower() if ignore_case else word[:1]))
    return words.withColumn("cost", cost).filter("cost >= 0")
