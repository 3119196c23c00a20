"""Output: templates of ``%`` fields, the presets made of them, tags, replacements and hex dumps.

A template is compiled once into one Catalyst expression over rows of ``find_matches``; records are united
per file, in order, only by the sinks that need whole files.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import escape as E
from ..functions.find import Finder
from ..functions.regex import compile_patterns
from ..model import SearchOptions
from ..shipping import ship

_FIELD = re.compile(r"%(?:\{([-+]?\d+)\})?(?:\[([^\]]*)\])?(.)", re.S)


class FormatError(ValueError):
    """Unknown field in a template."""


def _text(c, i: str) -> Column:
    return {"o": c, "q": E.quoted(c), "c": E.c_string(c), "v": E.csv_string(c), "j": E.json_string(c), "x": E.xml_text(c), "y": E.hex_text(c), "d": F.octet_length(c).cast("string")}[i]


def _group(name: str | None, digit: str | None) -> Column:
    keys = [digit] if digit else (name or "").split("|")
    return F.coalesce(*(F.col("groups").getItem(k) for k in keys), F.lit(""))


def template(fmt: str, *, key: str = "key", labels: list[str] | None = None, separator: str = ":", total: int | None = None) -> Column:
    """A record's text.  Uses columns of ``find_matches``; ``file_no`` (number of the file) if the template asks for it."""
    out, at = [], 0
    path = F.col(key).cast("string")
    s = lambda c: F.col(c).cast("string")
    sep = F.lit(separator)
    for m in _FIELD.finditer(fmt):
        if m.start() > at:
            out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        width, arg, f = m.groups()
        if f == "$":  # sets the separator from here on
            sep = F.lit(arg if arg is not None else separator)
            continue
        first = F.col("match_no") == 1
        made = {
            "%": lambda: F.lit("%"), "~": lambda: F.lit("\n"), "R": lambda: F.lit("\n"), "t": lambda: F.lit("\t"), "s": lambda: sep, "S": lambda: F.when(first, F.lit("")).otherwise(sep),
            "T": lambda: F.concat(F.lit(arg or ""), F.lit("\t")) if arg else F.lit("\t"), "f": lambda: path, "F": lambda: F.concat(F.lit(arg or ""), path, sep), "a": lambda: E.basename(path), "p": lambda: E.dirname(path),
            "z": lambda: F.coalesce(F.nullif(F.regexp_extract(path, r"\{([^}]*)\}$", 1), F.lit("")), F.lit("")), "h": lambda: E.quoted(path), "H": lambda: F.concat(F.lit(arg or ""), E.quoted(path), sep), "i": lambda: E.xml_text(path), "I": lambda: F.concat(F.lit(arg or ""), E.xml_text(path), sep),
            "n": lambda: s("line_no"), "N": lambda: F.concat(F.lit(arg or ""), s("line_no"), sep), "l": lambda: s("line_end"), "L": lambda: (F.col("line_end") - F.col("line_no") + 1).cast("string"),
            "k": lambda: s("col"), "K": lambda: F.concat(F.lit(arg or ""), s("col"), sep), "b": lambda: s("byte_off"), "B": lambda: F.concat(F.lit(arg or ""), s("byte_off"), sep), "e": lambda: s("byte_end"),
            "A": lambda: F.concat(F.lower(F.lpad(F.hex("byte_off"), 8, "0")), F.lit("-"), F.lower(F.lpad(F.hex(F.greatest(F.col("byte_end") - 1, F.col("byte_off"))), 8, "0"))),
            "d": lambda: s("n_bytes"), "w": lambda: s("width"), "m": lambda: s("match_no"), "M": lambda: F.lit("" if total is None else str(total)) if total is not None else s("file_no"),
            "o": lambda: F.col("match"), "O": lambda: F.col("line"), "q": lambda: _text(F.col("match"), "q"), "Q": lambda: _text(F.col("line"), "q"), "c": lambda: _text(F.col("match"), "c"), "C": lambda: _text(F.col("line"), "c"),
            "v": lambda: _text(F.col("match"), "v"), "V": lambda: _text(F.col("line"), "v"), "j": lambda: _text(F.col("match"), "j"), "J": lambda: _text(F.col("line"), "j"), "x": lambda: _text(F.col("match"), "x"), "X": lambda: _text(F.col("line"), "x"),
            "y": lambda: _text(F.col("match"), "y"), "Y": lambda: _text(F.col("line"), "y"), "Z": lambda: s("cost"), "#": lambda: _group(arg, None),
            "g": lambda: F.coalesce(F.get(F.array(*map(F.lit, (arg.split("|") if arg else labels or []))), F.col("accept") - 1), s("accept")) if arg or labels else s("accept"), "G": lambda: s("accept"),
            ",": lambda: F.when(first, "").otherwise(","), ":": lambda: F.when(first, "").otherwise(":"), ";": lambda: F.when(first, "").otherwise(";"), "|": lambda: F.when(first, "").otherwise("|"),
            "<": lambda: F.when(first, F.lit(arg or "")).otherwise(""), ">": lambda: F.when(first, "").otherwise(F.lit(arg or "")), "u": lambda: F.lit(""), "+": lambda: F.when(first, F.concat(path, F.lit("\n"))).otherwise(""), "=": lambda: F.lit(""),
            "U": lambda: F.lit(chr(int(arg, 16)) if arg else ""),
        }
        if f.isdigit() and f != "0":
            c = _group(None, f)
        elif f in made:
            c = made[f]()
        else:
            raise FormatError(f"unknown field %{f}")
        if width:
            n = int(width)
            if width.startswith("+") and f == "o":  # the match with n columns of its line on both sides
                c = F.substring(F.col("line"), F.greatest(F.col("col") - n, F.lit(1)).cast("int"), (F.least(F.col("col") - 1, F.lit(n)) + F.char_length("match") + n).cast("int"))
            else:
                c = E.padded(c, n)
        out.append(c)
    if at < len(fmt):
        out.append(F.lit(fmt[at:]))
    return F.concat(*(F.coalesce(c, F.lit("")) for c in out)) if out else F.lit("")


def number_files(matches: DataFrame, key: str = "key") -> DataFrame:
    """``file_no`` by name; one row a file is ranked, not one a match."""
    numbers = matches.select(key).distinct().withColumn("file_no", F.row_number().over(W.orderBy(key)))
    return matches.join(numbers, key)


def formatted(matches: DataFrame, fmt: str, *, open_: str = "", close: str = "", key: str = "key", labels: list[str] | None = None, separator: str = ":") -> DataFrame:
    """(key, out): each file's records in order between its opening and closing text."""
    if "%M" in open_ + fmt + close or "%m" in open_ + close:
        matches = number_files(matches, key)
    record = template(fmt, key=key, labels=labels, separator=separator)
    by_file = lambda f: template(f.replace("%m", "%M"), key=key, separator=separator)  # noqa: E731  in a file's frame %m is the file's number
    rows = matches.select(key, "match_no", record.alias("r"), by_file(open_).alias("open"), by_file(close).alias("close"))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("match_no", "r"))).alias("r"), F.min("open").alias("open"), F.min("close").alias("close"))
    return by.select(key, F.concat("open", F.array_join(F.transform("r", lambda x: x["r"]), ""), "close").alias("out"))


def csv_records(matches: DataFrame, *, key: str = "key", file: bool = True, line: bool = False, column: bool = False, offset: bool = False, whole_line: bool = True) -> DataFrame:
    """(key, match_no, out): one CSV record a match."""
    fields = [E.quoted(F.col(key).cast("string"))] * file + [F.col("line_no").cast("string")] * line + [F.col("col").cast("string")] * column + [F.col("byte_off").cast("string")] * offset
    return matches.select(key, "match_no", F.concat_ws(",", *fields, E.csv_string("line" if whole_line else "match")).alias("out"))


def json_files(matches: DataFrame, *, key: str = "key", file: bool = True, line: bool = False, column: bool = False, offset: bool = False, whole_line: bool = True) -> DataFrame:
    """(key, out): one JSON object a file with its matches in order."""
    pair = lambda n, c: F.concat(F.lit(f'"{n}": '), F.col(c).cast("string"))
    fields = [pair("line", "line_no")] * line + [pair("column", "col")] * column + [pair("offset", "byte_off")] * offset
    one = F.concat(F.lit("{ "), F.concat_ws(", ", *fields, F.concat(F.lit('"match": '), E.json_string("line" if whole_line else "match"))), F.lit(" }"))
    by = matches.select(key, "match_no", one.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("match_no", "r"))).alias("r"))
    head = F.concat(F.lit('{ "file": '), E.json_string(F.col(key).cast("string")), F.lit(', "matches": [')) if file else F.lit('{ "matches": [')
    return by.select(key, F.concat(head, F.array_join(F.transform("r", lambda x: x["r"]), ", "), F.lit("] }")).alias("out"))


def xml_files(matches: DataFrame, *, key: str = "key", file: bool = True, line: bool = False, column: bool = False, offset: bool = False, whole_line: bool = True) -> DataFrame:
    """(key, out): one ``<file>`` element a file with a ``<match>`` each."""
    attribute = lambda n, c: F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))
    attributes = [attribute("line", "line_no")] * line + [attribute("column", "col")] * column + [attribute("offset", "byte_off")] * offset
    one = F.concat(F.lit("<match"), *attributes, F.lit(">"), E.xml_text("line" if whole_line else "match"), F.lit("</match>"))
    by = matches.select(key, "match_no", one.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("match_no", "r"))).alias("r"))
    head = F.concat(F.lit('<file name="'), E.xml_text(F.col(key).cast("string")), F.lit('">')) if file else F.lit("<file>")
    return by.select(key, F.concat(head, F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</file>")).alias("out"))


def cpp_array(matches: DataFrame, *, key: str = "key", whole_line: bool = True) -> DataFrame:
    """(key, out): a C++ array of each file's matches."""
    by = matches.select(key, "match_no", E.c_string("line" if whole_line else "match").alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("match_no", "r"))).alias("r"))
    return by.select(key, F.concat(F.lit("const char *matches[] = {\n  "), F.array_join(F.transform("r", lambda x: x["r"]), ",\n  "), F.lit(",\n};")).alias("out"))


def count_records(counts: DataFrame, style: str, *, key: str = "key") -> DataFrame:
    """Counts or a Boolean ``n`` in CSV, JSON or XML."""
    n, path = F.col("n").cast("string"), F.col(key).cast("string")
    out = {
        "csv": F.concat(E.quoted(path), F.lit(","), n), "json": F.concat(F.lit('{ "file": '), E.json_string(path), F.lit(', "matches": [{ "match": '), n, F.lit(" }] }")),
        "xml": F.concat(F.lit('<file name="'), E.xml_text(path), F.lit('"><match>'), n, F.lit("</match></file>")),
    }[style]
    return counts.select(key, out.alias("out"))


def tagged(rows: DataFrame, options: SearchOptions, begin: str = "___", end: str | None = None, column: str = "line") -> DataFrame:
    """Matches in a column wrapped in tags, in the JVM; for patterns whose first match is the longest and isn't empty."""
    esc = lambda t: re.sub(r"([\\$])", r"\\\1", t)
    return rows.withColumn(column, F.regexp_replace(column, F.lit(compile_patterns(options).jvm), F.lit(f"{esc(begin)}$0{esc(begin if end is None else end)}")))


def _pieces(fmt: str) -> list[tuple[str, str | None, str]]:
    out, at = [], 0
    for m in _FIELD.finditer(fmt):
        out += [(fmt[at : m.start()], None, "")] if m.start() > at else []
        out.append(("", m[2], m[3]))
        at = m.end()
    return out + ([(fmt[at:], None, "")] if at < len(fmt) else [])


def replaced(df: DataFrame, options: SearchOptions, fmt: str, *, key: str = "key", text: str = "text", whole: bool = False) -> DataFrame:
    """(key, line_no, line): matching lines with every match replaced by fields; ``%m`` numbers matches within the file.

    ``whole`` gives (key, text) with all lines instead."""
    pieces, compiled = _pieces(fmt), compile_patterns(options)
    schema = T.StructType([df.schema[key], T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())]) if not whole else T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def field(arg: str | None, f: str, r: dict) -> str:
        if f.isdigit():
            return r["groups"].get(f, "")
        if f == "#":
            return next((r["groups"][k] for k in (arg or "").split("|") if k in r["groups"]), "")
        known = {"o": r["match"], "m": str(r["match_no"]), "n": str(r["line_no"]), "k": str(r["col"]), "b": str(r["byte_off"]), "d": str(r["n_bytes"]), "w": str(r["width"]), "%": "%", "~": "\n", "t": "\t", "O": r["line"], "g": str(r["accept"]), "Z": str(r["cost"])}
        if f not in known:
            raise FormatError(f"unknown field %{f}")
        return known[f]

    def run(batches):
        finder = Finder(compiled, options)
        for batch in batches:
            at, numbers, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    if whole:
                        at.append(i)
                        out.append(t)
                    continue
                new, end, hit = [], 0, set()
                places = {(s, e) for s, e, *_ in finder.spans(t)}
                records = list(finder.records(t))
                order = sorted(places)
                for (s, e), r in zip(order, records):
                    new += [t[end:s], "".join(p if p else field(a, f, r) for p, a, f in pieces)]
                    end = e
                    hit.update(range(r["line_no"], r["line_end"] + 1))
                new.append(t[end:])
                done = "".join(new)
                if whole:
                    at.append(i)
                    out.append(done)
                    continue
                parts = done.split("\n")
                if t.endswith("\n"):
                    parts.pop()
                for n, line in enumerate(parts, 1):
                    if n in hit:
                        at.append(i)
                        numbers.append(n)
                        out.append(line)
            index = pa.array(at, pa.int64())
            cols = [batch.column(0).take(index)] + ([] if whole else [pa.array(numbers, pa.int64())]) + [pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(run, schema)


HEX = T.StructType([T.StructField("offset", T.LongType()), T.StructField("hex", T.StringType()), T.StructField("ascii", T.StringType())])


def hexdump(rows: DataFrame, column: str = "match", *, columns: int = 16, offset: str | None = "byte_off", keep: list[str] = ("key",)) -> DataFrame:
    """Rows of ``columns`` octets (8 to 64) of a text or binary column: offset, hex and printable characters, by built-in functions."""
    if not 8 <= columns <= 64:
        raise ValueError("8 to 64 octets a row")
    base = F.col(offset) if offset else F.lit(0)
    lead = F.pmod(base, F.lit(columns)).cast("int")
    data = F.col(column) if rows.schema[column].dataType == T.BinaryType() else F.encode(column, "UTF-8")
    rows = rows.select(*keep, (base - lead).cast("long").alias("__f"), lead.alias("__lead"), data.alias("__d")).filter(F.length("__d") > 0)
    n = F.ceil((F.col("__lead") + F.length("__d")) / columns).cast("int")
    # bytes are cut, not characters: a cut of bytes costs the same everywhere in a long text
    cut = lambda i: F.hex(F.substring(F.col("__d"), F.greatest(i * columns - F.col("__lead"), F.lit(0)) + 1, F.when(i == 0, columns - F.col("__lead")).otherwise(columns)))
    rows = rows.select(*keep, "__f", "__lead", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), cut)).alias("__i", "__r"))
    rows = rows.withColumn("__r", F.when(F.col("__i") == 0, F.concat(F.repeat(F.lit("--"), F.col("__lead")), "__r")).otherwise(F.col("__r")))
    pairs = F.regexp_extract_all("__r", F.lit("(..)"), F.lit(1))
    # control characters show as the letter of their control key, bytes above ASCII as a point
    code = lambda p: F.conv(p, 16, 10).cast("int")
    shown = F.array_join(F.transform(pairs, lambda p: F.when(p == "--", "-").when(code(p) < 32, F.char(code(p) + 64)).when(code(p) < 127, F.char(code(p))).when(code(p) == 127, "~").otherwise(".")), "")
    return rows.select(*keep, (F.col("__f") + F.col("__i") * columns).cast("long").alias("offset"), F.lower(F.rtrim(F.regexp_replace("__r", "(..)", "$1 "))).alias("hex"), shown.alias("ascii"))


_FRAMES = {"json": ("[\n  ", ",\n  ", "\n]\n"), "xml": ("<grep>\n  ", "\n  ", "\n</grep>\n"), "csv": ("", "\n", "\n"), "text": ("", "", "")}


def report(outs: DataFrame, style: str = "text", *, order: list[str] = ("key",)):
    """Pieces of a whole report in order, streamed from the executors: files between the style's opening and closing."""
    begin, between, end = _FRAMES[style]
    first = True
    for row in outs.orderBy(*order).select("out").toLocalIterator():
        yield (begin if first else between) + row["out"]
        first = False
    yield end if not first else (begin.rstrip(" ") + end.lstrip("\n") if style in ("json", "xml") else "")


def write_text(outs: DataFrame, path: str, *, order: list[str] = ("key",)) -> None:
    """Records as text files, in order over files and within them (a range sort)."""
    outs.orderBy(*order).select(F.col("out").alias("value")).write.text(path)
