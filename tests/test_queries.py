"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seekwell.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@needs_data
def test_fuzzy_query_has_least_costs(spark):
    rows = QUERIES["fuzzy_best"](spark, SF).collect()
    assert any(r.match.lower() == "license" and r.cost == 1 for r in rows)
    least = {}
    for r in rows:
        assert least.setdefault(r.doc_id, r.cost) == r.cost <= 2


@needs_data
def test_counting_needs_no_shuffle(spark):
    plan = QUERIES["grep_count_zero"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "text" in plan and "lang" not in plan


def test_decoding_leaves_no_document_out(spark, tmp_path):
    texts = ["plain", "", None, "Éa ßü\nñ", "œuvre €", "¤ ¼", "日本 \U0001F600", "шрифт"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.utf16, r.utf32, r.koi8, r.latin9) for r in QUERIES["decode_all_documents"](spark, str(tmp_path)).collect()}
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    held = lambda t, page: digest(t) if t is not None and t.encode(page, "ignore").decode(page) == t else None
    assert got == {i: (digest(t), digest(t), held(t, "ascii"), held(t, "iso8859_15")) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(ORACLE_SQL["decode_all_documents"]).fetchall()} == got


def test_ignore_rules_of_directories_hold_below(spark, tmp_path):
    """An override of names with a 9 is for pages; one of a directory's or a host's name doesn't bring back what is below."""
    paths = ["a.org/en/926/", "a.org/en/9/b.html", "a9.org/en/b.html", "a.org/en/b9.html", "a.org/en/b.html", "a.org/en9/b.html", "a.org/x/en/b.html", "a.org/en", "a.org/en/", "a.org/en/9\n", "a.example.net/9.html", "a9.example.net/en/b", "a.org", ""]
    spark.createDataFrame([(i, f"https://{p}", "") for i, p in enumerate(paths)] + [(99, None, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["ignore_rules"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["ignore_rules"]).fetchall())
    assert [paths[i] for i, _ in got] == ["a.org/en/b9.html", "a.org/en9/b.html", "a.org/x/en/b.html", "a.org/en", "a.org/en/9\n", "a.org", ""]
