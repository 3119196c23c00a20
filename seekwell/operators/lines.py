"""The line model: where a text's lines are.

A text without characters has no line; an unterminated last piece is a line; a line end at the very end
begins no further one.  Numbers start at 1 in each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_array(text, sep: str = "\n") -> Column:
    """Lines of a text as an array, within its row: no shuffle, no explode."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, sep if sep != "\0" else "\\x00", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit(sep)), F.slice(parts, F.lit(1), F.array_size(parts) - 1)).otherwise(parts)


def lines(df: DataFrame, *, key: str | list[str] = "key", text: str = "text", offsets: bool = False, sep: str = "\n", keep: list[str] = ()) -> DataFrame:
    """key, line_no, line (and byte_off, which costs a shuffle by key) of every line."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.select(*keys, *keep, F.posexplode(lines_array(text, sep)).alias("pos", "line")).select(*keys, *keep, (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    if offsets:
        before = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn("byte_off", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))
    return out


def in_range(rows: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Lines ``first`` to ``last``, before anything is matched."""
    rows = rows if first <= 1 else rows.filter(F.col("line_no") >= first)
    return rows if last is None else rows.filter(F.col("line_no") <= last)


def is_binary(content, ascii_only: bool = False) -> Column:
    """Whether bytes hold NUL or (unless ``ascii_only``) aren't UTF-8."""
    content = F.col(content) if isinstance(content, str) else content
    nul = F.contains(content.cast("binary"), F.lit(b"\0"))
    return nul if ascii_only else nul | ~F.is_valid_utf8(content.cast("string"))
