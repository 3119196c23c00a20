"""Scalar functions of output fields, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(x) -> Column:
    """``"..."`` with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(_c(x), r'(["\\])', r"\\$1"), F.lit('"'))


_CONTROL = [("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x07", "\\a"), ("\b", "\\b"), ("\x0b", "\\v"), ("\f", "\\f")]


def _controls(x: Column, names, rest) -> Column:
    made = x
    for raw, shown in [*names, *((chr(c), rest(c)) for c in [*range(1, 32), 127])]:
        made = F.replace(made, F.lit(raw), F.lit(shown))
    return F.when(x.rlike(r"[\x01-\x1F\x7F]"), made).otherwise(x)


def csv_string(x) -> Column:
    """A CSV field: quotes doubled, backslashes and control characters escaped."""
    x = F.replace(_c(x), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), _controls(F.replace(x, F.lit('"'), F.lit('""')), _CONTROL, lambda c: f"\\x{c:02x}"), F.lit('"'))


def c_string(x) -> Column:
    """A C or C++ string literal."""
    x = F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), _controls(x, _CONTROL, lambda c: f"\\{c:03o}"), F.lit('"'))


def json_string(x) -> Column:
    x = F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = [p for p in _CONTROL if p[0] in "\t\n\r\b\f"]
    return F.concat(F.lit('"'), _controls(x, named, lambda c: f"\\u{c:04x}"), F.lit('"'))


def xml_text(x) -> Column:
    x = _c(x)
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return _controls(x, [], lambda c: f"&#{c};" if c != 9 else "&#9;")


def hex_text(x) -> Column:
    return F.lower(F.hex(F.encode(_c(x), "UTF-8")))


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path) -> Column:
    return F.when(F.contains(_c(path), F.lit("/")), F.regexp_replace(_c(path), r"/[^/]*$", "")).otherwise(F.lit("."))


def padded(x, width: int, fill: str = " ") -> Column:
    """Padded on the left to ``width`` characters (on the right for a negative width), never cut."""
    x, n = _c(x), abs(width)
    made = F.lpad(x, n, fill) if width > 0 else F.rpad(x, n, fill)
    return F.when(F.char_length(x) < n, made).otherwise(x)


def clipped(x, width: int) -> Column:
    return F.left(_c(x), F.lit(width))
