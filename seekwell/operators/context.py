"""Context of matching lines: lines around, columns around, and the lines a match spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SearchOptions
from ..plans.predicates import predicate
from .lines import lines_array


def with_context(df: DataFrame, options: SearchOptions, *, before: int = 0, after: int = 0, key="key", text: str = "text") -> DataFrame:
    """(key, line_no, line, hit, starts_group): matching lines and those around them, overlapping groups merged.

    ``starts_group`` marks the first line of each contiguous block; computed within the file's row, linear in its
    lines times the width, without a shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, lines_array(text).alias("l"))
    lo, hi = options.min_line, options.max_line or (1 << 30)
    rows = rows.withColumn("h", F.transform("l", lambda x, i: (i + 1 >= lo) & (i + 1 <= hi) & F.coalesce(predicate(x, options), F.lit(False))))
    near = lambda i: F.exists(F.slice("h", F.greatest(i - after, F.lit(0)) + 1, F.least(i, F.lit(after)) + before + 1), lambda x: x)
    rows = rows.withColumn("s", F.transform("l", lambda x, i: near(i) & (i + 1 >= lo) & (i + 1 <= hi)))
    made = F.transform("l", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.get("h", i).alias("hit"), (~F.coalesce(F.get("s", i - 1), F.lit(False))).alias("starts_group"), F.get("s", i).alias("s")))
    return rows.select(*keys, F.inline(F.filter(made, lambda r: r["s"]))).drop("s")


def column_context(matches: DataFrame, n: int) -> DataFrame:
    """Each match with the ``n`` characters of its line on both sides; a longer side is cut to ``n - 2`` before or ``n - 3``
    after and marked by ``...``.  Needs columns without tabs."""
    start = F.col("col") - 1
    rest = F.char_length("line") - start - F.char_length("match")
    left = F.when(start > n, F.concat(F.lit("..."), F.substring(F.col("line"), (start - (n - 3)).cast("int"), F.lit(n - 2)))).otherwise(F.substring(F.col("line"), F.lit(1), start.cast("int")))
    right = F.substring(F.col("line"), (start + F.char_length("match") + 1).cast("int"), F.when(rest > n, n - 3).otherwise(n))
    return matches.withColumn("context", F.concat(left, "match", right, F.when(rest > n, "...").otherwise("")))


def match_lines(matches: DataFrame, *, key: str = "key") -> DataFrame:
    """A row for each line that a match spans: (key, match_no, line_no, piece, first), continuation lines with their own numbers."""
    pieces = F.split("match", "\n", -1)
    return matches.select(key, "match_no", F.col("line_no").alias("__at"), F.posexplode(pieces).alias("i", "piece")).select(
        key, "match_no", (F.col("__at") + F.col("i")).cast("long").alias("line_no"), "piece", (F.col("i") == 0).alias("first"))


def cut_width(rows: DataFrame, width: int, column: str = "line") -> DataFrame:
    return rows.withColumn(column, F.left(column, F.lit(width)))
