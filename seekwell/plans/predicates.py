"""Patterns as Catalyst predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import compile_patterns
from ..model import SearchOptions


def predicate(column, options: SearchOptions) -> Column:
    """Whether a line (or text) holds a match, by built-in expressions alone; ``invert`` negates it.

    With negative patterns a line counts if some match of a positive pattern remains after matches of the
    negative ones, which are taken first from the same place, are discarded."""
    column = F.col(column) if isinstance(column, str) else column
    c = compile_patterns(options)
    if c.matches_all:
        found = F.lit(True)
    elif c.negatives:
        flags, _, rest = c.jvm.partition(")")
        both = f"{flags})(?:{'|'.join(f'(?:{n})' for n in c.negatives)})|({rest})"
        found = F.exists(F.regexp_extract_all(column, F.lit(both), F.lit(1)), lambda x: x != "")
    elif options.dialect == "fixed" and c.literal and not (options.word or options.whole_line):
        found = F.contains(column, F.lit(c.literal))
    elif options.dialect == "fixed" and c.literal and options.whole_line:
        found = column == c.literal
    else:
        found = column.rlike(c.jvm)
    return ~found if options.invert else found


def prefilter(text, options: SearchOptions) -> Column | None:
    """A cheap condition on the whole text that holds wherever a line matches; None if no literal is sure.

    Only for searches that drop texts without a match."""
    if options.invert or options.negatives:
        return None
    literal = compile_patterns(options).literal
    return F.contains(F.col(text) if isinstance(text, str) else text, F.lit(literal)) if len(literal) > 1 else None
