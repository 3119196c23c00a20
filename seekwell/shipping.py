"""Giving this package to Python workers, and rows back to the JVM."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to workers that can't import it from their own path; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_seekwell_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package was itself shipped as an archive
        folder = Path(tempfile.mkdtemp(prefix="seekwell-py-"))
        with zipfile.ZipFile(folder / "seekwell_py.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        sc.addPyFile(str(folder / "seekwell_py.zip"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._seekwell_shipped = True


def slices(rows: Iterable[tuple], kinds: list[tuple[str, pa.DataType]], most: int = 4 << 20, most_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``most`` bytes of strings, or one larger row: more of them are never held."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    for r in rows:
        n = sum(len(x) for x in r if isinstance(x, str | bytes))
        if held and (size + n > most or len(held) >= most_rows):
            yield batch()
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield batch()
