"""Options of a search and the fixed schemas of its tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

KEY, LINE_NO, BYTE_OFF, LINE = "key", "line_no", "byte_off", "line"

LINES = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(LINE_NO, T.LongType()), T.StructField(BYTE_OFF, T.LongType()), T.StructField(LINE, T.StringType())])
#: One match as the position finder reports it; offsets and columns are within the text it was given.
MATCH = T.StructType([
    T.StructField("line_no", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("col", T.LongType()), T.StructField("byte_off", T.LongType()), T.StructField("byte_end", T.LongType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("width", T.LongType()), T.StructField("match_no", T.LongType()), T.StructField("accept", T.IntegerType()), T.StructField("match", T.StringType()),
    T.StructField("groups", T.MapType(T.StringType(), T.StringType())), T.StructField("cost", T.IntegerType()),
])
COUNTS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("n", T.LongType())])


@dataclass(frozen=True)
class SearchOptions:
    """What to look for.  ``patterns`` are alternatives, each of which may hold several, one a line."""

    patterns: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    dialect: str = "ere"  # ere, bre, fixed, perl
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    whole_line: bool = False
    free_space: bool = False
    dot_all: bool = False
    ascii: bool = False
    empty: bool = False
    invert: bool = False
    null_data: bool = False
    tabs: int = 8
    min_line: int = 1
    max_line: int | None = None
    binary: str = "text"  # binary, without-match, text, hex, with-hex

    def with_(self, **changes) -> "SearchOptions":
        return replace(self, **changes)

    @classmethod
    def grep(cls, *patterns: str, **more) -> "SearchOptions":
        return cls(patterns=patterns, dialect="bre", empty=True, **more)

    @classmethod
    def egrep(cls, *patterns: str, **more) -> "SearchOptions":
        return cls(patterns=patterns, dialect="ere", empty=True, **more)

    @classmethod
    def fgrep(cls, *patterns: str, **more) -> "SearchOptions":
        return cls(patterns=patterns, dialect="fixed", empty=True, **more)

    @classmethod
    def pgrep(cls, *patterns: str, **more) -> "SearchOptions":
        return cls(patterns=patterns, dialect="perl", **more)


def load_config(text: str) -> dict[str, str | bool]:
    """``NAME=VALUE`` lines (or a bare name, which is true); ``#`` begins a comment line."""
    found: dict[str, str | bool] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, eq, value = line.partition("=")
            found[name.strip().lstrip("-")] = value.strip() if eq else True
    return found


def save_config(options: dict[str, str | bool]) -> str:
    return "".join(f"{k}\n" if v is True else f"{k}={v}\n" for k, v in sorted(options.items()) if v is not False)


