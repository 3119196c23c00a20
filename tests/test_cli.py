"""The command line on small files."""

import io
import json

import pytest
from tests.conftest import FILES

from seekwell.__main__ import run


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    for n, t in FILES.items():
        (d / n).write_text(t)
    return d


@pytest.mark.parametrize("args, want, status", [
    (["Hello"], ['h.bat:echo "Hello World!"', "h.java:record shape Hello -- shows on Hello World! greeting", 'h.java:  [ Console.showing.to("Hello World!");', 'h.sh:echo "Hello World!"', "h.txt:Hello"], 0),
    (["-c", "Hello"], ["empty.txt:0", "emptyline.txt:0", "h.bat:1", "h.java:2", "h.sh:1", "h.txt:1"], 0),
    (["-co", "Hello", "-g", "*.java"], ["3"], 0),
    (["-l", "Hello", "-O", "sh,bat"], ["h.bat", "h.sh"], 0),
    (["-L", "Hello"], ["empty.txt", "emptyline.txt"], 0),
    (["-on", "Hello", "--include", "h.java"], ["3:Hello", "3:Hello", "5:Hello"], 0),
    (["-nkb", "Hello", "-t", "batch"], ['2:7:16:echo "Hello World!"'], 0),
    (["--bool", "Hello -World"], ["h.txt:Hello"], 0),
    (["-e", "Hello", "--andnot", "World"], ["h.txt:Hello"], 0),
    (["-nC1", "Hello", "-g", "h.sh"], ["1-#!/bin/sh", '2:echo "Hello World!"'], 0),
    (["--replace=(%m:%o)", "Hello", "-g", "h.sh"], ['echo "(1:Hello) World!"'], 0),
    (["absent"], [], 1),
    (["-m1", "Hello", "-g", "*.java"], ["record shape Hello -- shows on Hello World! greeting"], 0),
])
def test_command_line(spark, folder, args, want, status):
    out = io.StringIO()
    got = run([*args, str(folder)], spark, out)
    assert (got, [x.replace(f"{folder}/", "") for x in out.getvalue().splitlines()]) == (status, want)


def test_reports(spark, folder):
    out = io.StringIO()
    assert run(["--json", "-n", "Hello", str(folder)], spark, out) == 0
    assert [len(x["matches"]) for x in json.loads(out.getvalue())] == [1, 2, 1, 1]
    assert run(["-q", "Hello", str(folder)], spark, out) == 0 and run(["-q", "absent", str(folder)], spark, out) == 1
