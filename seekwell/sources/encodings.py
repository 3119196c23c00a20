"""Decoding to text: built-in charsets in the JVM, the others by Python codecs in Arrow batches.

A byte-order mark decides over the named encoding.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_JVM = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-32": "UTF-32"}
_CODEC = {
    "ebcdic": "cp037", "mac": "mac_roman", "macroman": "mac_roman", "koi8-r": "koi8_r", "koi8-u": "koi8_u", "koi8-ru": "koi8_u", "utf-32be": "utf-32-be", "utf-32le": "utf-32-le", "cp437": "cp437", "cp850": "cp850", "cp858": "cp858",
    **{f"cp{n}": f"cp{n}" for n in range(1250, 1259)}, **{f"windows-{n}": f"cp{n}" for n in range(1250, 1259)}, **{f"iso-8859-{n}": f"iso8859_{n}" for n in range(2, 17) if n != 12},
}


def encodings() -> list[str]:
    return sorted({*_JVM, *_CODEC, "binary", "null-data"})


def _python(codec: str, mac: bool):
    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            t = codecs.decode(b, codec, "replace").removeprefix("﻿")
            return t.replace("\r", "\n") if mac else t

        return data.map(one)

    return decode


def custom_page(table: str):
    """A decoder for a code page of 256 characters of one's own."""
    if len(table) != 256:
        raise ValueError("a code page has 256 characters")

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else codecs.charmap_decode(b, "replace", table)[0])

    return decode


def decoded(content, encoding: str = "utf-8") -> Column:
    """Bytes as text; marks of UTF-8, UTF-16 and UTF-32 win over ``encoding``."""
    c = F.col(content) if isinstance(content, str) else content
    name = encoding.lower()
    if name == "binary":
        return F.decode(c, "ISO-8859-1")
    if name == "null-data":
        return F.replace(c.cast("string"), F.lit("\0"), F.lit("\n"))
    if name in _CODEC:
        plain = _python(_CODEC[name], name in ("mac", "macroman"))(c)
    elif name == "utf-8":
        plain = F.try_validate_utf8(c.cast("string"))
        plain = F.coalesce(plain, F.make_valid_utf8(c.cast("string")))
    elif name in _JVM:
        plain = F.decode(c, _JVM[name])
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    head = F.hex(F.substring(c, F.lit(1), F.lit(4)))
    rest = lambda n: F.substring(c, F.lit(n + 1), F.octet_length(c))
    # Python runs on every row, so it gets null for rows without the mark
    marked = lambda mark, codec: _python(codec, False)(F.when(head == mark, rest(4)))
    return (F.when(F.startswith(head, F.lit("EFBBBF")), rest(3).cast("string")).when(head == "FFFE0000", marked("FFFE0000", "utf-32-le")).when(head == "0000FEFF", marked("0000FEFF", "utf-32-be"))
            .when(F.startswith(head, F.lit("FFFE")), F.decode(rest(2), "UTF-16LE")).when(F.startswith(head, F.lit("FEFF")), F.decode(rest(2), "UTF-16BE")).otherwise(plain))
