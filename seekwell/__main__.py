"""A thin command line over local files: ``python -m seekwell PATTERN PATH...``; status 0 for a match, 1 for none, 2 for an error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import pattern
from .functions import fuzzy
from .functions.find import find_matches
from .model import SearchOptions
from .operators import context, render, search
from .operators.lines import in_range, is_binary, lines
from .plans import boolean, globs
from .sources import archives, encodings, files
from .sources.types import type_condition


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seekwell", description="Search files with Spark.", add_help=False)
    add = p.add_argument
    add("--help", action="help")
    add("pattern", nargs="?")
    add("paths", nargs="*")
    for flags, kw in (
        ("-E -G -F -P", {}), ("-i --ignore-case", {}), ("-j --smart-case", {}), ("-w --word-regexp", {}), ("-x --line-regexp", {}), ("-v --invert-match", {}), ("-Y --empty", {}), ("-U --binary", {}), ("--dotall", {}), ("--free-space", {}), ("--match", {}),
        ("-c --count", {}), ("-l --files-with-matches", {}), ("-L --files-without-match", {}), ("-q --quiet", {}), ("-o --only-matching", {}), ("-u --ungroup", {}), ("-y --any-line", {}), ("-n --line-number", {}), ("-k --column-number", {}), ("-b --byte-offset", {}),
        ("-H --with-filename", {}), ("-h --no-filename", {}), ("-I --ignore-binary", {}), ("-. --hidden", {}), ("-r", {}), ("-R", {}), ("-S", {}), ("-p", {}), ("-z --decompress", {}), ("--bool", {}), ("--files", {}), ("--csv", {}), ("--json", {}), ("--xml", {}), ("--cpp", {}),
        ("--stats", {}), ("--tree", {}), ("-X --hex", {}), ("--only-line-number", {}),
    ):
        names = flags.split()
        if names[:2] == ["-E", "-G"]:
            for n in names:
                add(n, action="store_const", const={"-E": "ere", "-G": "bre", "-F": "fixed", "-P": "perl"}[n], dest="dialect", default="ere")
        else:
            add(*names, action="store_true", dest=names[-1].lstrip("-").replace("-", "_") if names[-1] != "-." else "hidden", **kw)
    for flags in ("-e --regexp", "-f --file", "-N --neg-regexp", "--and", "--not", "--andnot", "-g --glob", "--include", "--exclude", "--include-dir", "--exclude-dir", "-O --file-extension", "-t --file-type", "--from"):
        add(*flags.split(), action="append", default=[], dest=flags.split()[-1].lstrip("-").replace("-", "_") + "_")
    for flags, kind in (("-A --after-context", int), ("-B --before-context", int), ("-C --context", int), ("--max-files", int), ("--width", int), ("--tabs", int), ("--zmax", int)):
        add(*flags.split(), type=kind, default=None)
    for flags in ("-m --max-count", "-K --range", "--encoding", "--sort", "--replace", "--format", "--format-open", "--format-close", "--tag", "-Z --fuzzy", "--min-size", "--max-size", "--depth", "--separator"):
        add(*flags.split(), default=None)
    return p


def _bounds(text: str | None) -> tuple[int, int | None]:
    if not text:
        return 1, None
    low, comma, high = text.partition(",")
    return (int(low or 1), int(high) if high else None) if comma else (1, int(low))


def selected(spark: SparkSession, a: argparse.Namespace):
    """(key, text) of the files that the arguments choose."""
    follow = "all" if a.R else "files" if a.S else "none" if a.p else "arguments"
    paths = files.walk(a.paths or ["."], follow=follow)
    for f in a.from_:
        with open(f, encoding="utf-8") as h:
            paths += [x for x in h.read().split("\n") if x]
    df = spark.createDataFrame([(os.path.relpath(p) if not os.path.isabs(p) else p,) for p in paths], "path string") if paths else spark.createDataFrame([], "path string")
    if not a.hidden:
        df = df.filter(~globs.hidden(globs.normal_path("path")))
    for g in (a.glob_, a.include_):
        if g:
            df = df.filter(globs.globs_condition("path", g))
    if a.exclude_:
        df = df.filter(~globs.globs_condition("path", a.exclude_))
    for d in a.include_dir_:
        df = df.filter(globs.in_directory(F.col("path"), d))
    for d in a.exclude_dir_:
        df = df.filter(~globs.in_directory(F.col("path"), d))
    for e in a.file_extension_:
        df = df.filter(globs.extension_condition("path", e))
    for t in a.file_type_:
        df = df.filter(type_condition("path", t))
    if a.depth:
        df = df.filter(globs.depth_condition("path", *_bounds(a.depth)))
    chosen = [r.path for r in df.collect()]  # names of local files, which the driver has just listed
    if not chosen:
        return spark.createDataFrame([], "key string, text string")
    found = files.read_files(spark, [os.path.abspath(p) for p in chosen], recursive=False)
    found = found.filter(globs.size_condition("length", a.min_size, a.max_size))
    names = spark.createDataFrame([(os.path.abspath(p), p) for p in chosen], "path string, key string")
    found = found.join(names, "path").drop("path").withColumnRenamed("key", "path").select("path", "length", "content")
    none = [(p, 0, bytearray()) for p in chosen if os.path.getsize(p) == 0]  # the file source passes over empty files
    if none:
        found = found.union(spark.createDataFrame(none, found.schema).filter(globs.size_condition("length", a.min_size, a.max_size)))
    if a.decompress:
        found = archives.expand(found, depth=a.zmax or 1).filter("error is null").select(F.col("key").alias("path"), "content")
    if a.ignore_binary:
        found = found.filter(~is_binary("content"))
    return found.select(F.col("path").alias("key"), encodings.decoded("content", a.encoding or "utf-8").alias("text"))


def run(argv: list[str], spark: SparkSession, out=sys.stdout) -> int:
    a = parser().parse_intermixed_args(argv)
    patterns = list(a.regexp_)
    for f in a.file_:
        patterns += pattern(f) if "/" in f and not os.path.exists(f) else [x for x in open(f, encoding="utf-8").read().split("\n") if x]
    if not patterns and not a.match:
        if a.pattern is None:
            raise SystemExit(2)
        patterns = [a.pattern]
    elif a.pattern is not None:
        a.paths = [a.pattern, *a.paths]
    low, high = _bounds(a.range)
    o = SearchOptions(patterns=tuple(patterns) or ("",), negatives=tuple(a.neg_regexp_), dialect=a.dialect, ignore_case=a.ignore_case, smart_case=a.smart_case, word=a.word_regexp, whole_line=a.line_regexp, free_space=a.free_space, dot_all=a.dotall,
                      ascii=a.binary, empty=a.empty, invert=a.invert_match, tabs=a.tabs or 8, min_line=low, max_line=high)
    docs = selected(spark, a)
    many = a.with_filename or (not a.no_filename and docs.count() != 1)
    name = F.concat(F.col("key"), F.lit(":")) if many else F.lit("")
    show = lambda df, *order: _print(df.select(*order, F.col("out")), out, order)
    if a.bool or a.and_ or a.not_ or a.andnot_:
        e = boolean.parse("\n".join(patterns)) if a.bool else boolean.from_terms([(patterns, list(a.not_)), *(([x], []) for x in a.and_), *(([], [x]) for x in a.andnot_)])
        rows = boolean.file_lines(docs, e, base=o) if a.files else in_range(lines(docs), low, high).filter(boolean.line_condition(e, base=o))
        if a.count:
            return show(docs.select("key").join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").select("key", F.concat(name, F.coalesce("n", F.lit(0)).cast("string")).alias("out")), "key")
        if a.files_with_matches:
            return show(rows.select("key").distinct().withColumn("out", F.col("key")), "key")
        return show(rows.withColumn("out", F.concat(name, "line")), "key", "line_no")
    if a.quiet:
        return 0 if search.exists(docs, o) else 1
    if a.stats:
        print(search.stats(docs, o).first().asDict(), file=out)
    if a.files_with_matches or a.files_without_match:
        found = (search.files_without if a.files_without_match else search.files_with)(docs, o)
        if a.tree:
            found = search.tree(found, "key").select(F.col("dir").alias("key"), F.concat("dir", F.lit("/ "), F.col("files").cast("string")).alias("out"))
            return show(found, "key")
        return show(found.withColumn("out", F.col("key")), "key")
    if a.count:
        n = (search.count_matches if a.only_matching or a.ungroup else search.count_lines)(docs, o)
        least, most = _bounds(a.max_count) if a.max_count and "," in a.max_count else (0, None)
        return show(search.at_least(n, least).withColumn("out", F.concat(name, F.col("n").cast("string"))), "key")
    if a.replace is not None:
        return show(render.replaced(docs, o, a.replace).withColumn("out", F.concat(name, "line")), "key", "line_no")
    around = (a.before_context or a.context or 0, a.after_context or a.context or 0)
    style = next((s for s in ("csv", "json", "xml", "cpp") if getattr(a, s)), None)
    if style or a.format or a.only_matching or a.ungroup or a.column_number or a.byte_offset or a.fuzzy or a.hex:
        if a.fuzzy is not None:
            best, digits = a.fuzzy.startswith("best"), "".join(c for c in a.fuzzy if c.isdigit())
            kinds = {c for c in a.fuzzy if c in "+-~"}
            found = fuzzy.fuzzy_matches(docs, o, int(digits or 1), **({"insertions": "+" in kinds, "deletions": "-" in kinds, "substitutions": "~" in kinds} if kinds else {}))
            found = fuzzy.best_only(found) if best else found
        else:
            found = find_matches(docs, o)
        if not (a.only_matching or a.ungroup):
            found = search.first_per_line(found)
        whole = not a.only_matching
        if a.hex:
            return show(render.hexdump(found, "match").select("key", "offset", F.concat(F.lower(F.lpad(F.hex("offset"), 8, "0")), F.lit("  "), "hex", F.lit("  |"), "ascii", F.lit("|")).alias("out")), "key", "offset")
        if a.format:
            return show(render.formatted(found, a.format, open_=a.format_open or "", close=a.format_close or ""), "key")
        kw = {"line": a.line_number, "column": a.column_number, "offset": a.byte_offset, "whole_line": whole}
        if style == "csv":
            return show(render.csv_records(found, file=many, **kw), "key", "match_no")
        if style in ("json", "xml"):
            made = (render.json_files if style == "json" else render.xml_files)(found, file=many, **kw)
            text = list(render.report(made, style))
            out.write("".join(text))
            return 0 if len(text) > 1 else 1
        if style == "cpp":
            return show(render.cpp_array(found, whole_line=whole), "key")
        sep = F.lit(a.separator or ":")
        bits = [F.concat(F.col(c).cast("string"), sep) for c, on in (("line_no", a.line_number), ("col", a.column_number), ("byte_off", a.byte_offset)) if on]
        return show(found.withColumn("out", F.concat(name, *bits, "match" if a.only_matching else "line")), "key", "line_no", "match_no")
    if any(around) or a.any_line:
        rows = context.with_context(docs, o, before=around[0], after=around[1]) if not a.any_line else search.any_line(docs, o)
    elif a.max_count:
        rows = search.max_count(docs, o, _bounds(a.max_count)[1] or 1 << 30).withColumn("hit", F.lit(True))
    else:
        rows = search.matching_lines(docs, o).withColumn("hit", F.lit(True))
    if a.max_files:
        rows = search.max_files(rows, a.max_files)
    if a.tag:
        rows = render.tagged(rows, o, *a.tag.split(",", 1))
    if a.width:
        rows = context.cut_width(rows, a.width)
    mark = F.when(F.col("hit"), a.separator or ":").otherwise("-")
    body = F.col("line_no").cast("string") if a.only_line_number else F.concat(F.concat(F.col("line_no").cast("string"), mark) if a.line_number else F.lit(""), "line")
    return show(rows.withColumn("out", F.concat(F.concat("key", mark) if many else F.lit(""), body)), "key", "line_no")


def _print(df, out, order) -> int:
    any_ = False
    for row in df.orderBy(*order).toLocalIterator():
        out.write(row["out"] + "\n")
        any_ = True
    return 0 if any_ else 1


def main() -> None:
    spark = SparkSession.builder.appName("seekwell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        status = run(sys.argv[1:], spark)
    except (ValueError, OSError) as e:
        print(f"seekwell: {e}", file=sys.stderr)
        status = 2
    spark.stop()
    sys.exit(status)


if __name__ == "__main__":
    main()
