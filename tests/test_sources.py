"""Globs, types, encodings, archives, the index, files and streams."""

import bz2
import gzip
import io
import lzma
import os
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from tests.conftest import FILES, rows

from seekwell.catalog import CATALOG, pattern
from seekwell.functions.find import find_matches
from seekwell.functions.regex import compile_patterns
from seekwell.model import SearchOptions as O
from seekwell.operators import search
from seekwell.plans import globs as G
from seekwell.sources import archives as A
from seekwell.sources import encodings, files as S, index as I, types as Y
from seekwell.streaming import search as ST

TRUTH = [
    ("*", "a b x/a x/y/b", ""), ("a", "a x/a x/y/a", "b x/b a/a/b"), ("/*", "a b", "x/a x/b x/y/a"), ("/a", "a", "x/a x/y/a"), ("a?b", "axb ayb", "a b ab a/b"), ("a[xy]b", "axb ayb", "a b azb"), ("a[a-z]b", "aab abb acb azb", "a b a3b aAb aZb"),
    ("a[^xy]b", "aab abb acb azb", "a b axb ayb"), ("a[^a-z]b", "a3b aAb aZb", "a b aab abb acb azb"), ("a/*/b", "a/x/b a/y/b", "a/b a/x/y/b"), ("**/a", "a x/a x/y/a", "b x/b"), ("a/**/b", "a/b a/x/b a/x/y/b", "x/a/b a/b/x"), ("a/**", "a/x a/y a/x/y", "a b/x"), (r"a\?b", "a?b", "a b ab axb a/b"),
]


def test_glob_table(spark):
    for glob, yes, no in TRUTH:
        df = spark.createDataFrame([(p, True) for p in yes.split()] + [(p, False) for p in no.split()], "p string, want boolean")
        bad = df.filter(G.glob_condition("p", glob) != F.col("want")).collect()
        assert not bad, (glob, bad)


def test_selection_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a.c", "a.h", "d/b.c", "d/e/b.txt", ".hid/x.c", "d/Makefile", "B.C")], "path string")
    of = lambda c: [p for p, in rows(df.filter(c), "path")]
    assert of(G.globs_condition("path", "*.c,!a.*")) == [".hid/x.c", "d/b.c"] and of(G.globs_condition("path", "*.c", ignore_case=True)) == [".hid/x.c", "B.C", "a.c", "d/b.c"]
    assert of(G.glob_condition("path", "d/")) == ["d/Makefile", "d/b.c", "d/e/b.txt"] and of(G.in_directory(F.col("path"), "e")) == ["d/e/b.txt"]
    assert of(G.last_rule("path", G.rules_of("# x\n*.c\n!a.c\n"))) == [".hid/x.c", "d/b.c"]
    assert of(G.ignored(df, {".": "*.c\n", "d": "!b.c\n/e/\n"})) == [".hid/x.c", "a.c", "d/e/b.txt"]
    assert of(G.depth_condition("path", 2, 2)) == [".hid/x.c", "d/Makefile", "d/b.c"] and of(G.hidden("path")) == [".hid/x.c"]
    assert of(G.extension_condition("path", "c,!h")) == [".hid/x.c", "a.c", "d/b.c"] and of(Y.type_condition("path", "make")) == ["d/Makefile"]
    assert Y.resolve("pyth") == "python" and G.size_bytes("2k") == 2048
    with pytest.raises(ValueError):
        Y.resolve("p")


def test_ignore_rules_are_for_entries(spark):
    df = spark.createDataFrame([(p,) for p in ("a.c", "k/a.c", "k/a.h", "x/a.h", "x/k/a.h", "d/k/a.h", "d/K/a.h", "dk/a.h", "x/k9/a.h", "x/9/k9.h")], "path string")
    of = lambda *a, **k: [p for p, in rows(df.filter(G.ignored(df, *a, **k)), "path")]
    assert of({".": "*.c\n!k/\n"}) == ["a.c", "k/a.c"]  # a directory's override isn't its files'
    assert of({".": "x/\n*9*\n!k9\n"}) == ["x/9/k9.h", "x/a.h", "x/k/a.h", "x/k9/a.h"]  # an ignored directory takes along what is below
    assert of({".": "x/\n!*9*\n"}) == ["x/a.h", "x/k/a.h", "x/k9/a.h"]  # but not a file that is named later
    assert of({".": "/*/\n!k\n!/x/\n"}) == ["d/K/a.h", "d/k/a.h", "dk/a.h"]
    assert of({"d": "k\n"}) == ["d/k/a.h"] and of({"d": "/k/\n"}, ignore_case=True) == ["d/K/a.h", "d/k/a.h"] and of({"": "!\n/\n./k/\n"}) == ["k/a.c", "k/a.h"]


def test_magic(spark):
    df = spark.createDataFrame([("run", bytearray(b"#!/bin/bash\nls\n")), ("x.pdf", bytearray(b"%PDF-1.4"))], "path string, content binary")
    assert rows(df.filter(Y.type_condition("path", "Shell", "content")), "path") == [("run",)]
    assert rows(df.select(S.magic_label("content", [("pdf", "%PDF"), ("script", "#!")]).alias("l")), "l") == [("pdf",), ("script",)]


def test_encodings_give_one_text(spark):
    text = "Éa ßü\nzwei"
    data = [("utf-8", text.encode()), ("utf-8", text.encode("utf-8-sig")), ("utf-8", text.encode("utf-16")), ("utf-8", b"\xff\xfe\0\0" + text.encode("utf-32-le")), ("utf-8", b"\xfe\xff" + text.encode("utf-16-be")), ("iso-8859-1", text.encode("latin-1")), ("cp1252", text.encode("cp1252")), ("cp437", text.encode("cp437")), ("ebcdic", text.encode("cp037")), ("utf-16le", text.encode("utf-16-le"))]
    for name, b in data:
        df = spark.createDataFrame([(bytearray(b),)], "c binary")
        assert df.select(encodings.decoded("c", name).alias("t")).first()["t"] == text, name
    assert spark.createDataFrame([(bytearray(b"a\rb"),)], "c binary").select(encodings.decoded("c", "macroman").alias("t")).first()["t"] == "a\nb"


def _tar(names=FILES, fmt=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = len(FILES[n])
            t.addfile(info, io.BytesIO(FILES[n].encode()))
    return out.getvalue()


def _cpio():
    out = b""
    for n, t in [*FILES.items(), ("TRAILER!!!", "")]:
        name = n.encode() + b"\0"
        head = b"070701" + b"".join(b"%08X" % v for v in (0, 0o100644, 0, 0, 1, 0, len(t), 0, 0, 0, 0, len(name), 0))
        out += head + name + b"\0" * (-(len(head) + len(name)) % 4) + t.encode() + b"\0" * (-len(t) % 4)
    return out


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in FILES.items():
            z.writestr(n, t)
    return out.getvalue()


def test_archives(spark):
    import zstandard

    plain = {"a.tar": _tar(), "a.tgz": gzip.compress(_tar()), "a.tbz": bz2.compress(_tar()), "a.txz": lzma.compress(_tar()), "a.tlz": lzma.compress(_tar(), lzma.FORMAT_ALONE), "a.tzst": zstandard.compress(_tar()), "a.cpio": _cpio(), "a.zip": _zip()}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in plain.items()], "path string, content binary")
    got = {r.key: bytes(r.content).decode() for r in A.expand(df).collect()}
    assert got == {f"{n}{{{f}}}": t for n in plain for f, t in FILES.items()}
    single = {"t.gz": gzip.compress(b"abc") + gzip.compress(b"def"), "t.bz2": bz2.compress(b"abcdef"), "t.txt": b"abcdef", "t.zz": zlib.compress(b"abcdef"), "t.Z": bytes.fromhex("1f9d90") + b"\x61\xc4\x8c\x21\x53\x06"}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in single.items()], "path string, content binary")
    got = {r.key: r.content for r in A.expand(df).collect()}
    assert all(bytes(got[n]) == b"abcdef" for n in ("t.gz", "t.bz2", "t.txt", "t.zz"))
    bad = spark.createDataFrame([("x.gz", bytearray(gzip.compress(b"abc" * 99)[:20])), ("y", None)], "path string, content binary")
    got = {r.key: (r.content, r.error) for r in A.expand(bad).collect()}
    assert got["x.gz"][0] is None and got["x.gz"][1] and bytes(got["y"][0]) == b""


def test_nested_archives(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in (("inner.tar", _tar(["h.txt"])), ("plain.txt", b"x")):
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    df = spark.createDataFrame([("o.tgz", bytearray(gzip.compress(out.getvalue())))], "path string, content binary")
    assert sorted(r.key for r in A.expand(df, depth=2).collect()) == ["o.tgz{inner.tar:h.txt}", "o.tgz{plain.txt}"]
    assert sorted(r.key for r in A.expand(df, depth=1).collect()) == ["o.tgz{inner.tar}", "o.tgz{plain.txt}"]


def _compress(data: bytes) -> bytes:
    """A small LZW writer for the .Z format (no clear codes)."""
    table, codes, w = {bytes([i]): i for i in range(256)}, [], b""
    sizes, size, n, nxt = [], 9, 0, 257
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        codes.append(table[w])
        table[w + bytes([c])] = nxt
        nxt += 1
        w = bytes([c])
    codes.append(table[w])
    out, bits, have, count, entries = bytearray(b"\x1f\x9d\x90"), 0, 0, 0, 257
    for i, code in enumerate(codes):
        bits |= code << have
        have += size
        count += 1
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8
        entries += i > 0
        if entries >= 1 << size and size < 16:
            left = -count % 8
            have += left * size
            while have > 0:
                out.append(bits & 255)
                bits >>= 8
                have -= 8
            bits = have = count = 0
            size += 1
    if have:
        out.append(bits & 255)
    del sizes, n
    return bytes(out)


def test_lzw_round_trip():
    data = (b"the quick brown fox " * 300) + bytes(range(256)) * 8
    assert A.lzw(_compress(data)) == data


def test_index_never_loses_a_match(spark):
    rng = __import__("random").Random(4)
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(400))), 0) for i in range(80)]
    df = spark.createDataFrame(docs, "path long, content string, modificationTime int")
    for accuracy in (0, 4, 9):
        made = I.build(df, accuracy=accuracy).cache()
        for lit in ("abc", "h a", "abcde"):
            o = O(patterns=(lit,))
            left = {r.path for r in I.pruned(df, made, o).collect()}
            assert {i for i, t, _ in docs if lit in t} <= left
    small = I.build(df, accuracy=9)
    assert I.pruned(df, small, O(patterns=("zzzzz",))).count() < 40
    newer = df.withColumn("modificationTime", F.when(F.col("path") < 3, 1).otherwise(0)).filter("path <> 79").union(spark.createDataFrame([(200, "new", 0)], df.schema))
    assert {r.state: r["count"] for r in I.stale(small, newer).collect()} == {"indexed": 76, "changed": 3, "added": 1, "deleted": 1}
    assert I.update(small, newer).count() == 80


def test_files_walk_and_filters(spark, tmp_path):
    (tmp_path / "d1" / "sub").mkdir(parents=True)
    (tmp_path / "d1" / "a.txt").write_text("Hello\n")
    (tmp_path / "d1" / "sub" / "b.txt").write_text("x")
    os.symlink(tmp_path / "d1" / "sub", tmp_path / "d1" / "link")
    os.symlink(tmp_path / "d1" / "a.txt", tmp_path / "d1" / "l.txt")
    base = lambda follow: [os.path.relpath(p, tmp_path) for p in S.walk([str(tmp_path)], follow=follow)]
    assert base("none") == ["d1/a.txt", "d1/sub/b.txt"] and base("files") == ["d1/a.txt", "d1/l.txt", "d1/sub/b.txt"] and "d1/link/b.txt" in base("all")
    df = S.read_files(spark, str(tmp_path))
    assert df.filter("name = 'a.txt' and length < 100").count() == 1
    assert rows(S.as_text(df.filter("name = 'a.txt'"), key="name"), "text") == [("Hello\n",)]
    up = S.filtered(df.filter("name = 'a.txt'"), {"txt": "tr a-z A-Z"}, {"tr"})
    assert bytes(up.first().content) == b"HELLO\n"
    with pytest.raises(ValueError):
        S.filtered(df, {"txt": "rm x"}, {"tr"})
    assert S.listed(df, df.select("path").limit(1)).count() == 1
    assert rows(search.count_lines(S.pseudo_file(spark, "a\nb"), O(patterns=("",))), "key", "n") == [("(standard input)", 2)]


def test_catalog_patterns_compile():
    for language, named in CATALOG.items():
        for name in named:
            ps = pattern(f"{language}/{name}")
            o = O(patterns=ps)
            compile_patterns(o)


def test_zap_patterns(spark):
    df = spark.createDataFrame([("a", 'int main() { /* name */ return "name"; } // name\n')], "key string, text string")
    found = find_matches(df, O(patterns=("name", *pattern("c/zap_comments,c/zap_strings"))))
    assert found.count() == 0


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "1.json").write_text("\n".join('{"source":"s","seq":%d,"line":"%s"}' % (i, x) for i, x in enumerate(["a", "hit", "b", "c", "d", "hit", "e"])))
    stream = spark.readStream.schema("source string, seq long, line string").json(str(src))
    got = ST.numbered(stream, O(patterns=("hit",)), before=1, after=1)
    q = got.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(str(out)), "line_no", "line", "hit") == [(1, "a", False), (2, "hit", True), (3, "b", False), (5, "d", False), (6, "hit", True), (7, "e", False)]
    assert ST.stream_lines(stream, O(patterns=("x",)), "line").isStreaming


def test_index_tables_are_passed_on_in_slices():
    import pyarrow as pa

    rng = __import__("random").Random(6)
    texts = [rng.randbytes(40_000) for _ in range(150)] + [b"", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(152)), pa.array([0] * 152), pa.array(texts, pa.binary())], names=["key", "mtime", "c"])
    made = list(I.tables([batch, batch.slice(150), batch.slice(0, 0)], 9, ["key", "mtime", "log2", "noise", "table"]))
    assert [k for b in made for k in b.column(0).to_pylist()] == [*range(152), 150, 151] and max(b.nbytes for b in made) < 5 << 20
    assert [t for b in made for t in b.column(4).to_pylist()][:152] == [I.build_table(t or b"", 9)[2] for t in texts]


def _table_by_definition(content, accuracy):
    """As the index's own description says: filled at full size, folded in half while it isn't too noisy."""
    bits = {(k, sum(61 ** (k - j) * c for j, c in enumerate(content[i : i + k + 1])) & 0xFFFF) for k in range(8) for i in range(len(content) - k)}
    size, most = 16, 0.1 + 0.7 * (9 - accuracy) / 9
    while size > 7 and len({(k, h & ((1 << size - 1) - 1)) for k, h in bits}) / (8 << size - 1) <= most:
        size -= 1
    table = bytearray(b"\xff" * (1 << size))
    for k, h in bits:
        table[h & ((1 << size) - 1)] &= 0xFF ^ (1 << k)
    return size, bytes(table)


def test_index_tables_are_by_definition_and_made_fast():
    import time

    rng = __import__("random").Random(8)
    for n in (0, 1, 2, 7, 8, 60, 400, 3000):
        for accuracy in (0, 4, 9):
            data = bytes(rng.choice(b"abcdefgh \xc3\xff\0") for _ in range(n))
            assert I.build_table(data, accuracy)[::2] == _table_by_definition(data, accuracy), (n, accuracy)
    assert len(I.build_table(b"x" * 200, 4)[2]) == 128
    began = time.process_time()
    for _ in range(300):
        I.build_table(b"a few words of a short text")
    assert time.process_time() - began < 0.15  # 1.4 ms each when every table was made at full size


def test_index_is_tested_without_python(spark):
    rng = __import__("random").Random(9)
    df = spark.createDataFrame([(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(300)))) for i in range(60)], "key int, content string")
    made = I.build(df.withColumn("mtime", F.lit(0)), key="key", mtime="mtime").localCheckpoint()
    for p in ("abc", "é b", "abcdabcdabcd", "a", "ab|cd é"):
        o = O(patterns=(p,))
        got = made.select("table", "log2", I.prune_condition(o).alias("ok"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert all(r.ok == any(I.admits(bytes(r.table), r.log2, x) for x in I.literals(o)) for r in got.collect()), p
    assert made.select(F.lit(None).cast("binary").alias("table"), "log2").select(I.prune_condition(O(patterns=("abc",)))).distinct().collect() == [(True,)]


def test_archive_parts_are_held_in_slices():
    import pyarrow as pa

    from seekwell.shipping import slices

    made = []
    rows = ((str(i), made.append(i) or b"x" * (1 << 20)) for i in range(40))
    seen = 0
    for b in slices(rows, [("path", pa.string()), ("content", pa.binary())]):
        seen += b.num_rows
        assert b.num_rows <= 4 and len(made) - seen <= 1
    assert seen == 40 and not list(slices(iter(()), [("path", pa.string())]))
    assert [b.num_rows for b in slices([(b"x" * (9 << 20),), (None,), (b"",)], [("c", pa.binary())])] == [1, 2]
    assert [b.num_rows for b in slices([(None,)] * 9000, [("c", pa.binary())])] == [8192, 808]


def test_packed_documents(spark):
    df = spark.createDataFrame([(3, "é"), (5, None), (None, "x")], "doc_id long, text string")
    got = {r.path: bytes(r.content) for r in A.packed(df, lambda i, t: b"%d:" % i + t).collect()}
    assert got == {"f3": b"3:" + "é".encode(), "f5": b"5:", None: b"0:x"}
    parts = A.expand(A.packed(df, lambda i, t: gzip.compress(t) if i == 3 else t), depth=2)
    assert {(r.key, bytes(r.content)) for r in parts.collect()} == {("f3", "é".encode()), ("f5", b""), (None, b"x")}
