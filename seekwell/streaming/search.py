"""Searching unbounded input: the same predicates on streams, and numbering and context by source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SearchOptions
from ..operators.lines import lines_array
from ..plans.predicates import predicate

STATE = "n long, hits long, left long, held array<string>"
OUT = "source string, line_no long, line string, hit boolean"


def stream_lines(stream: DataFrame, options: SearchOptions, column: str = "value") -> DataFrame:
    """Matching rows of a stream of lines: stateless, any source and sink."""
    return stream.filter(predicate(column, options))


def stream_documents(stream: DataFrame, options: SearchOptions, *, key: str = "key", text: str = "text") -> DataFrame:
    """Matching lines of a stream of documents: stateless, as each document is whole."""
    return stream.select(key, F.posexplode(lines_array(text)).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line").filter(predicate("line", options))


def numbered(stream: DataFrame, options: SearchOptions, *, source: str = "source", line: str = "line", order: str = "seq", before: int = 0, after: int = 0, most: int = 0) -> DataFrame:
    """Lines with numbers, context and a limit by source: (source, line_no, line, hit).

    State a source: a counter, hits so far, lines of context still due and at most ``before`` held lines. Rows of
    a source must arrive in the order of ``order`` over micro-batches; within one they are sorted."""
    rows = stream.select(F.col(source).alias("source"), F.col(line).alias("line"), F.col(order).alias("seq"), predicate(line, options).alias("hit"))

    def step(key, frames, state):
        n, hits, left, held = state.get if state.exists else (0, 0, 0, [])
        held, out = list(held), []
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for text, hit in zip(pdf["line"], pdf["hit"]):
            n += 1
            hit = bool(hit) and not (most and hits >= most)
            if hit:
                hits += 1
                out += [(key[0], n - len(held) + i, t, False) for i, t in enumerate(held)]
                out.append((key[0], n, text, True))
                held, left = [], after
            elif left > 0:
                left -= 1
                out.append((key[0], n, text, False))
            elif before:
                held = [*held, text][-before:]
        state.update((n, hits, left, held))
        yield pd.DataFrame(out, columns=["source", "line_no", "line", "hit"])

    return rows.groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def windowed_counts(stream: DataFrame, options: SearchOptions, *, at: str, column: str, window: str = "5 minutes", late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Matching rows a time window (and ``by``), late rows up to the watermark."""
    return stream.withWatermark(at, late).filter(predicate(column, options)).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n"))
