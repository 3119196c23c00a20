"""Files as rows: which files, their bytes, external filters, and text lines."""

from __future__ import annotations

import os
import shlex
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.globs import magic_condition
from .encodings import decoded


def walk(roots: list[str], *, follow: str = "arguments", recursive: bool = True) -> list[str]:
    """Local paths below ``roots``, files of a directory before its subdirectories, each real directory once.

    follow: ``all`` symlinks, ``files`` only (directories named as arguments too), ``arguments`` only those named, or ``none``.
    This runs on the driver: it is for local trees whose links matter; elsewhere ``read_files`` lists in Spark."""
    out, seen = [], set()

    def down(d: str) -> None:
        real = os.path.realpath(d)
        if real in seen:
            return
        seen.add(real)
        dirs = []
        for name in sorted(os.listdir(d)):
            p = os.path.join(d, name)
            link = os.path.islink(p)
            if os.path.isdir(p):
                if recursive and (not link or follow == "all"):
                    dirs.append(p)
            elif os.path.isfile(p) and (not link or follow in ("all", "files")):
                out.append(p)
        for p in dirs:
            down(p)

    for r in roots:
        if os.path.islink(r) and follow == "none":
            continue
        if os.path.isdir(r):
            down(r)
        elif os.path.isfile(r):
            out.append(r)
    return out


def read_files(spark: SparkSession, paths: list[str] | str, *, recursive: bool = True, quiet: bool = False, glob: str | None = None) -> DataFrame:
    """path, name, dir, ext, depth, length, modificationTime and content; sizes and times are pushed into the listing,
    and content is read only where a query uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if quiet:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths)
    path = F.regexp_replace("path", "^file:/*", "/")
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(
        path.alias("path"), name.alias("name"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("ext"), F.size(F.split(path, "/")).alias("depth"), "length", "modificationTime", "content")


def listed(files: DataFrame, paths: DataFrame, *, path: str = "path") -> DataFrame:
    """The files that a list of paths names."""
    return files.join(paths.select(F.col(paths.columns[0]).alias(path)).distinct(), path, "left_semi")


def pseudo_file(spark: SparkSession, text: str, label: str = "(standard input)") -> DataFrame:
    return spark.createDataFrame([(label, text)], "key string, text string")


def as_text(files: DataFrame, *, encoding: str = "utf-8", key: str = "path") -> DataFrame:
    """(key, text) of files."""
    return files.select(F.col(key).alias("key"), decoded("content", encoding).alias("text"))


def filtered(files: DataFrame, commands: dict[str, str], allowed: set[str], *, path: str = "path", content: str = "content", timeout: float = 60.0) -> DataFrame:
    """Content replaced by a command's output, by extension (``*`` for others, ``%`` for the path; input comes on stdin).

    Only programs in ``allowed`` are run, without a shell; a failing command gives empty content."""
    parsed = {ext: shlex.split(c) for ext, cmds in commands.items() for c in [cmds]}
    for argv in parsed.values():
        if not argv or argv[0] not in allowed:
            raise ValueError(f"command {argv[:1]} isn't allowed")

    @F.pandas_udf("binary")
    def run(paths: pd.Series, data: pd.Series) -> pd.Series:
        def one(p, b):
            ext = os.path.basename(p or "").rpartition(".")[2]
            argv = parsed.get(ext) or parsed.get("*")
            if not argv or b is None:
                return b
            try:
                return subprocess.run([p if a == "%" else a for a in argv], input=b, capture_output=True, timeout=timeout, check=True).stdout
            except (OSError, subprocess.SubprocessError):
                return b""

        return pd.Series([one(p, b) for p, b in zip(paths, data)])

    return files.withColumn(content, run(path, content))


def magic_label(content, labels: list[tuple[str, str]]):
    """The first label whose regex matches a file's first bytes, null if none."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(labels):
        out = F.when(magic_condition(content, pattern), F.lit(label)).otherwise(out)
    return out
