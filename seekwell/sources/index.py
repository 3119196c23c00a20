"""A data-skipping index: per file a table of hashed n-grams, tested before the file is read.

A table has ``2**log2`` rows of eight bits; bit k of a row is cleared where a (k+1)-gram of the file hashes to
it.  It is what a table of 65536 rows comes to that is folded in half while the share of set bits it would keep stays within
the accuracy's limit.  A pattern's sure literals of up to eight bytes are looked up: a file is skipped only
if some gram of a literal is absent, so no match is lost.  A file changed after it was indexed is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import bre_to_ere, required_literal, split_alternatives
from ..model import SearchOptions
from ..shipping import ship

GRAMS, FULL, LEAST = 8, 16, 7
#: Bytes of tables that a task makes before it passes them on.
SLICE = 4 << 20
INDEX = T.StructType([T.StructField("log2", T.IntegerType()), T.StructField("noise", T.DoubleType()), T.StructField("table", T.BinaryType())])


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """16-bit hash of every (k+1)-gram."""
    return _next_hashes(data, k, _hashes(data, k - 1)) if k else data.astype(np.uint16)


def _next_hashes(data: np.ndarray, k: int, shorter: np.ndarray) -> np.ndarray:
    """Hashes of (k+1)-grams from those of k-grams; 16 bits overflow as they should."""
    return np.uint16(61) * shorter[: len(data) - k] + data[k:]


def _sizes(longest: int, most: float) -> int:
    """The log2 of a table so large that a file of ``longest`` bytes can't make it noisier than ``most``: it would be folded to this size."""
    size = LEAST
    while size < FULL and longest > most / 2 * (1 << size):
        size += 1
    return size


def build_table(content: bytes, accuracy: int = 4) -> tuple[int, float, bytes]:
    """(log2 of the rows, share of absent bits cleared by chance, table)."""
    data = np.frombuffer(content, np.uint8)
    most = 0.1 + 0.7 * (9 - accuracy) / 9
    size = _sizes(len(data), most)
    table, mask, h = np.full(1 << size, 0xFF, np.uint8), np.uint16((1 << size) - 1), data.astype(np.uint16)
    for k in range(min(GRAMS, len(data))):
        h = _next_hashes(data, k, h) if k else h
        at = h & mask
        table[at] &= np.uint8(0xFF ^ (1 << k))  # a row that comes twice gets the same value twice
    noise = lambda t: 1 - np.bitwise_count(t.view(np.uint64)).sum(dtype=np.int64) / (8 * len(t))
    while size > LEAST:
        half = table[: len(table) // 2] & table[len(table) // 2 :]
        if noise(half) > most:
            break
        table, size = half, size - 1
    return size, float(noise(table)), table.tobytes()


def tables(batches: Iterator[pa.RecordBatch], accuracy: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the index in slices of a few MB: tables may be larger than their files."""
    for batch in batches:
        made, held, first = [], 0, 0
        for i, c in enumerate(batch.column(2), 1):
            made.append(build_table(c.as_py() or b"", accuracy))
            held += len(made[-1][2])
            if held >= SLICE or i == batch.num_rows:
                keys = [batch.column(j).slice(first, i - first) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([m[j] for m in made], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.binary())))], names=names)
                made, held, first = [], 0, i


def admits(table: bytes, log2: int, literal: bytes) -> bool:
    """Whether a file with this table could hold the literal."""
    data = np.frombuffer(literal[:256], np.uint8)
    t = np.frombuffer(table, np.uint8)
    mask = (1 << log2) - 1
    return all(not (t[_hashes(data, k) & mask] >> np.uint8(k) & 1).any() for k in range(min(GRAMS, len(data))))


def build(files: DataFrame, *, key: str = "path", content: str = "content", mtime: str = "modificationTime", accuracy: int = 4, ignore_binary: bool = False) -> DataFrame:
    """(key, mtime, log2, noise, table) of every file, to be written as Parquet beside the data."""
    if not 0 <= accuracy <= 9:
        raise ValueError("accuracy is 0 to 9")
    src = files.select(F.col(key).alias("key"), F.col(mtime).alias("mtime"), F.col(content).cast("binary").alias("c"))
    if ignore_binary:
        src = src.filter(~F.contains(F.col("c"), F.lit(b"\0")))
    schema = T.StructType([src.schema["key"], src.schema["mtime"], *INDEX.fields])

    ship(files.sparkSession)
    return src.mapInArrow(lambda batches: tables(batches, accuracy, schema.names), schema)


def stale(index: DataFrame, files: DataFrame, *, key: str = "path", mtime: str = "modificationTime") -> DataFrame:
    """Counts of files by state: indexed, changed, added, deleted."""
    f = files.select(F.col(key).alias("key"), F.col(mtime).alias("now"))
    both = index.select("key", F.col("mtime").alias("then")).join(f, "key", "full")
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("then"), "changed").otherwise("indexed")
    return both.groupBy(state.alias("state")).count()


def update(index: DataFrame, files: DataFrame, *, key: str = "path", content: str = "content", mtime: str = "modificationTime", accuracy: int = 4) -> DataFrame:
    """The index brought up to date: only new and changed files are read, deleted ones go."""
    f = files.select(F.col(key).alias("key"), F.col(mtime).alias("now"))
    kept = index.join(f, "key").filter(F.col("now") <= F.col("mtime")).drop("now")
    todo = files.join(kept.select(F.col("key").alias(key)), key, "left_anti")
    return kept.unionByName(build(todo, key=key, content=content, mtime=mtime, accuracy=accuracy))


def literals(options: SearchOptions) -> list[bytes] | None:
    """Literals one of which every matching file holds; None if some alternative has no sure one."""
    if options.invert or options.ignore_case or options.smart_case or options.free_space or options.dialect == "perl":
        return None
    found = []
    for x in [x for p in options.patterns for x in p.split("\n")]:
        if options.dialect == "fixed":
            ways = [x]
        elif x.startswith("(?^") or "(?" in x:
            ways = [""]
        else:
            ways = [required_literal(w) for w in split_alternatives(bre_to_ere(x) if options.dialect == "bre" else x)]
        if not all(ways):
            return None
        found += [w.encode() for w in ways]
    return found or None


def prune_condition(options: SearchOptions) -> Column:
    """Whether a file's table (columns log2 and table) admits a match, by built-in expressions: no table goes through Python."""
    sure = literals(options)
    if not sure:
        return F.lit(True)

    def holds(literal: bytes) -> Column:
        data = np.frombuffer(literal[:256], np.uint8)
        grams = sorted({(int(h), k) for k in range(min(GRAMS, len(data))) for h in _hashes(data, k)})
        wanted = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(1 << k).alias("bit")) for h, k in grams))
        row = lambda x: F.substring(F.col("table"), x["h"].bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("log2")) - 1) + 1, F.lit(1))
        return F.forall(wanted, lambda x: F.ascii(F.decode(row(x), "ISO-8859-1")).bitwiseAND(x["bit"]) == 0)

    return F.coalesce(reduce(or_, map(holds, sure)), F.lit(True))


def pruned(files: DataFrame, index: DataFrame, options: SearchOptions, *, key: str = "path", mtime: str = "modificationTime") -> DataFrame:
    """Files that may match: those whose table admits it, those not indexed and those changed since.

    Tables are tested by themselves; only keys of files that can't match are joined with the files."""
    if not literals(options):
        return files
    no = index.filter(~prune_condition(options)).select(F.col("key").alias("__k"), F.col("mtime").alias("__m"))
    return files.join(no, (F.col(key) == F.col("__k")) & (F.col(mtime) <= F.col("__m")), "left_anti")
