"""Registered queries over the tables, one for each capability, and the same in DuckDB's SQL."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import pattern
from .functions import escape as E
from .functions import fuzzy
from .functions.find import find_matches, scan_tokens
from .model import SearchOptions
from .operators import context, render, search
from .operators.lines import is_binary, lines
from .plans import boolean, globs
from .sources import archives, encodings, index
from .streaming import search as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_O = SearchOptions

_LINES = """WITH lines AS (
  SELECT doc_id, i AS line_no, l AS line FROM (
    SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
  WHERE NOT (i = n AND l = ''))
"""


def _query(sql: str | None = None, with_lines: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (_LINES if with_lines else "") + sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "line_no", "line")


@_query("SELECT d.doc_id, CAST(count(l.doc_id) AS BIGINT) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def lines_count(spark, sf_dir):
    return search.count_lines(_docs(spark, sf_dir), _O(patterns=("",)), key="doc_id")


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'er(at|on)ing')")
def grep_lines(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("er(at|on)ing",)), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE NOT regexp_matches(line, '[aeiou]n')")
def grep_invert(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("[aeiou]n",), invert=True), key="doc_id"))


@_query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, 'thing') GROUP BY doc_id HAVING count(*) >= 2")
def grep_count(spark, sf_dir):
    return search.at_least(search.count_lines(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id"), 2)


@_query("SELECT d.doc_id, CAST(count(l.doc_id) AS BIGINT) AS n FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id AND regexp_matches(line, 'thing') GROUP BY d.doc_id")
def grep_count_zero(spark, sf_dir):
    return search.count_lines(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id")


@_query("SELECT d.doc_id, CAST(coalesce(sum(len(regexp_extract_all(line, 'th[aeio]'))), 0) AS BIGINT) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def grep_count_matches(spark, sf_dir):
    return search.count_matches(_docs(spark, sf_dir), _O(patterns=("th[aeio]",)), key="doc_id")


@_query("SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '[0-9]{4}')")
def grep_files_with(spark, sf_dir):
    return search.files_with(_docs(spark, sf_dir), _O(patterns=("[0-9]{4}",)), key="doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE regexp_matches(line, '[0-9]'))")
def grep_files_without(spark, sf_dir):
    return search.files_without(_docs(spark, sf_dir), _O(patterns=("[0-9]",)), key="doc_id")


@_query("SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'mail2.example.com') OR contains(line, '***')")
def grep_fixed(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("mail2.example.com\n***",), dialect="fixed"), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)ingthe')")
def grep_ignore_case(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("INGTHE",), ignore_case=True), key="doc_id"))


@_query("SELECT doc_id, line_no, line, 'insensitive' AS mode FROM lines WHERE regexp_matches(line, '(?i)license') UNION ALL SELECT doc_id, line_no, line, 'sensitive' FROM lines WHERE regexp_matches(line, 'License')")
def grep_smart_case(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    made = [_numbered(search.matching_lines(docs, _O(patterns=(p,), smart_case=True), key="doc_id")).withColumn("mode", F.lit(m)) for p, m in (("license", "insensitive"), ("License", "sensitive"))]
    return made[0].union(made[1])


@_query(r"SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(^|[^\p{L}\p{N}_])thing([^\p{L}\p{N}_]|$)')")
def grep_word(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("thing",), word=True), key="doc_id"))


@_query(r"SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '^([A-Z][a-z]+\. ?)+$')")
def grep_whole_line(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=(r"([A-Z][a-z]+\. ?)+",), whole_line=True), key="doc_id"))


@_query(r"SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(ing|ed)\.')")
def grep_basic(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=(r"\(ing\|ed\)\.",), dialect="bre"), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'th[bcdfghjklmnpqrstvwxyz]{3}')")
def grep_class_algebra(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("th[a-z--[aeiou]]{3}",)), key="doc_id"))


@_query(r"SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '\p{Lu}[äöüéèñ]')")
def grep_unicode(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=(r"\u[äöüéèñ]",)), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(replace(line, 'thing', ''), 'ing')")
def grep_negative_pattern(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("ing",), negatives=("thing",)), key="doc_id"))


def _bool(spark, sf_dir, text, **base):
    return lines(_docs(spark, sf_dir), key="doc_id").filter(boolean.line_condition(boolean.parse(text), base=_O(**base))).select("doc_id", "line_no", "line")


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'thing') AND regexp_matches(line, 'ation')")
def bool_and(spark, sf_dir):
    return _bool(spark, sf_dir, "thing ation")


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'license') OR regexp_matches(line, '@mail')")
def bool_or(spark, sf_dir):
    return _bool(spark, sf_dir, "license|@mail")


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'thing') AND NOT regexp_matches(line, 'er')")
def bool_not(spark, sf_dir):
    return _bool(spark, sf_dir, "thing -er")


@_query("SELECT doc_id, line_no, line FROM lines WHERE (contains(line, 'of the') OR regexp_matches(line, 'in(g|t)th')) AND NOT (regexp_matches(line, 'ble') OR (regexp_matches(line, 'or') AND regexp_matches(line, 'st')))")
def bool_nested(spark, sf_dir):
    return _bool(spark, sf_dir, '("of the" OR in(g|t)th) NOT (ble | (or AND st))')


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'thing') AND (regexp_matches(line, 'ation') OR NOT regexp_matches(line, 'er'))")
def bool_option_terms(spark, sf_dir):
    e = boolean.from_terms([(["thing"], []), (["ation"], ["er"])])
    return lines(_docs(spark, sf_dir), key="doc_id").filter(boolean.line_condition(e)).select("doc_id", "line_no", "line")


@_query("SELECT doc_id FROM lines GROUP BY doc_id HAVING bool_or(regexp_matches(line, 'thing')) AND bool_or(regexp_matches(line, 'tionth'))")
def bool_files_and(spark, sf_dir):
    return boolean.matching_files(_docs(spark, sf_dir), boolean.parse("thing tionth"), key="doc_id")


@_query("SELECT doc_id, line_no, line FROM lines WHERE doc_id IN (SELECT doc_id FROM lines GROUP BY doc_id HAVING bool_or(regexp_matches(line, 'thing')) AND NOT bool_or(regexp_matches(line, 'and'))) AND (regexp_matches(line, 'thing') OR regexp_matches(line, 'and'))")
def bool_files_not(spark, sf_dir):
    return _numbered(boolean.file_lines(_docs(spark, sf_dir), boolean.parse("thing -and"), key="doc_id"))


@_query(r"SELECT doc_id, line_no, CAST(generate_subscripts(m, 1) AS BIGINT) AS match_no, unnest(m) AS match FROM (SELECT *, regexp_extract_all(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS m FROM lines)")
def only_matching(spark, sf_dir):
    return search.only_matching(_docs(spark, sf_dir), _O(patterns=("[A-Za-z0-9._]+@[A-Za-z0-9.]+",)), key="doc_id")


@_query(r"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]+ingth[a-z]+')) AS match, line FROM lines")
def ungroup(spark, sf_dir):
    return search.ungrouped(_docs(spark, sf_dir), _O(patterns=("[a-z]+ingth[a-z]+",)), key="doc_id").select("doc_id", "line_no", "match", "line")


@_query("""SELECT doc_id, line_no, CAST(strpos(line, 'eron') AS BIGINT) AS col, CAST(off + strlen(left(line, strpos(line, 'eron') - 1)) AS BIGINT) AS byte_off
FROM (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines) WHERE contains(line, 'eron')""")
def line_column_offset(spark, sf_dir):
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("eron",)), "doc_id")
    return found.select("doc_id", "line_no", "col", "byte_off")


@_query("""SELECT doc_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_off FROM lines""")
def line_offsets(spark, sf_dir):
    return lines(_docs(spark, sf_dir), key="doc_id", offsets=True).select("doc_id", "line_no", "line", "byte_off")


_CONTEXT = """, h AS (SELECT *, regexp_matches(line, 'ingthion|license|@mail') AS hit FROM lines),
c AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) = 1 AS shown FROM h)
SELECT doc_id, line_no, line, hit, NOT coalesce(prev, false) AS starts_group FROM (SELECT *, lag(shown) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM c) WHERE shown"""


@_query(_CONTEXT)
def context_before_after(spark, sf_dir):
    return context.with_context(_docs(spark, sf_dir), _O(patterns=("ingthion|license|@mail",)), before=2, after=1, key="doc_id")


@_query("SELECT doc_id, line_no, line, regexp_matches(line, 'thing') AS hit FROM lines")
def any_line(spark, sf_dir):
    return search.any_line(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id").select("doc_id", "line_no", "line", "hit")


@_query("SELECT doc_id, line_no, line FROM lines WHERE line_no BETWEEN 3 AND 5 AND regexp_matches(line, 'th')")
def line_range(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("th",), min_line=3, max_line=5), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines WHERE regexp_matches(line, 'th')) WHERE r <= 2")
def max_count(spark, sf_dir):
    return _numbered(search.max_count(_docs(spark, sf_dir), _O(patterns=("th",)), 2, key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE regexp_matches(line, 'thing')) WHERE n >= 3")
def min_count(spark, sf_dir):
    return _numbered(search.min_count(_docs(spark, sf_dir), _O(patterns=("thing",)), 3, key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM (SELECT *, dense_rank() OVER (ORDER BY doc_id) AS r FROM lines WHERE regexp_matches(line, 'thing')) WHERE r <= 5")
def max_files(spark, sf_dir):
    return _numbered(search.max_files(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id"), 5, key="doc_id"))


@_query(r"SELECT doc_id, word, CAST(levenshtein(regexp_replace(word, '[^\x00-\x7F]', '#', 'g'), 'therethat') AS INTEGER) AS cost FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS word FROM documents) WHERE left(word, 1) = 't' AND levenshtein(regexp_replace(word, '[^\x00-\x7F]', '#', 'g'), 'therethat') <= 2", with_lines=False)
def best_match_levenshtein(spark, sf_dir):
    """All words; in the SQL, whose distance is of bytes, a character beyond ASCII counts as one that the pattern lacks."""
    return fuzzy.fuzzy_words(_docs(spark, sf_dir), "therethat", 2, key="doc_id")


@_query()
def fuzzy_best(spark, sf_dir):
    """The best fuzzy matches of each document; ``regex`` alone says what a fuzzy match is, so tests check it by brute force."""
    found = fuzzy.fuzzy_matches(_docs(spark, sf_dir), _O(patterns=("licence",), ignore_case=True), 2, keep=["doc_id"])
    return fuzzy.best_only(found, "doc_id").select("doc_id", "line_no", "col", "match", "cost")


@_query(r"SELECT doc_id, line_no, regexp_replace(line, '([0-9]+)@([a-z0-9]+)', '<\2:\1>', 'g') AS line FROM lines WHERE regexp_matches(line, '[0-9]+@[a-z0-9]+')")
def replace(spark, sf_dir):
    return render.replaced(_docs(spark, sf_dir), _O(patterns=("([0-9]+)@([a-z0-9]+)",), dialect="perl"), "<%2:%1>", key="doc_id")


@_query(r"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '([0-9]+)@([a-z0-9]+)\.', 1)) AS name, unnest(regexp_extract_all(line, '([0-9]+)@([a-z0-9]+)\.', 2)) AS host FROM lines")
def capture_groups(spark, sf_dir):
    found = find_matches(_docs(spark, sf_dir), _O(patterns=(r"(?P<name>[0-9]+)@(?P<host>[a-z0-9]+)\.",), dialect="perl"), keep=["doc_id"])
    return found.select("doc_id", "line_no", F.col("groups")["name"].alias("name"), F.col("groups")["host"].alias("host"))


@_query("SELECT doc_id, line_no, match, CAST(CASE match WHEN 'idiot' THEN 1 WHEN 'clown' THEN 2 WHEN 'disgusting' THEN 3 ELSE 4 END AS INTEGER) AS accept FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'idiot|clown|disgusting|license')) AS match FROM lines)")
def accept_index(spark, sf_dir):
    return find_matches(_docs(spark, sf_dir), _O(patterns=("idiot", "clown", "disgusting", "license")), keep=["doc_id"]).select("doc_id", "line_no", "match", "accept")


@_query(r"""SELECT doc_id, '"' || doc_id || '",' || line_no || ',' || strpos(line, 'license') || ',"' || replace(replace(line, '\', '\\'), '"', '""') || '"' AS out FROM lines WHERE contains(line, 'license')""")
def format_csv(spark, sf_dir):
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("license",)), "doc_id")
    return render.csv_records(found, key="doc_id", line=True, column=True).select("doc_id", "out")


_JSON_LINE = r"""replace(replace(line, '\', '\\'), '"', '\"')"""


@_query(rf"""SELECT doc_id, '{{ "file": "' || doc_id || '", "matches": [' || string_agg('{{ "line": ' || line_no || ', "match": "' || {_JSON_LINE} || '" }}', ', ' ORDER BY line_no) || '] }}' AS out FROM lines WHERE contains(line, 'license') GROUP BY doc_id""")
def format_json(spark, sf_dir):
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("license",)), "doc_id")
    return render.json_files(found, key="doc_id", line=True)


@_query(r"""SELECT doc_id, '<file name="' || doc_id || '">' || string_agg('<match line="' || line_no || '">' || replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</match>', '' ORDER BY line_no) || '</file>' AS out FROM lines WHERE contains(line, '&&&') GROUP BY doc_id""")
def format_xml(spark, sf_dir):
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("&&&",), dialect="fixed"), "doc_id")
    return render.xml_files(found, key="doc_id", line=True)


@_query(r"""SELECT doc_id, '# ' || doc_id || chr(10) || string_agg(n || ': ' || m || chr(10), '' ORDER BY n) || '--' AS out
FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+@[a-z0-9]+') AS ms FROM documents)) GROUP BY doc_id""", with_lines=False)
def format_template(spark, sf_dir):
    found = find_matches(_docs(spark, sf_dir), _O(patterns=("[0-9]+@[a-z0-9]+",)), keep=["doc_id"])
    return render.formatted(found, "%m: %o%~", open_="# %f%~", close="--", key="doc_id")


@_query("SELECT doc_id, line_no, regexp_replace(line, 'th[aeio]ng', '___\\0___', 'g') AS line FROM lines WHERE regexp_matches(line, 'th[aeio]ng')")
def tag_matches(spark, sf_dir):
    o = _O(patterns=("th[aeio]ng",))
    return _numbered(render.tagged(search.matching_lines(_docs(spark, sf_dir), o, key="doc_id"), o))


ORACLE_SQL["tag_matches"] = ORACLE_SQL["tag_matches"].replace("\\\\", "\\")
# patterns of our dialect, and what they are in SQL
_SET = [(1, "lic[a-z]+", "lic[a-z]+"), (2, "[[:digit:]]{5}", "[0-9]{5}"), (3, "@mail", "@mail"), (4, r"\*\*\*", r"\*\*\*"), (5, r"\<thing", r"\bthing"), (6, "[a-z--[aeiou]]{5}", "[b-df-hj-np-tv-z]{5}")]


@_query("SELECT doc_id, line_no, pattern_id FROM lines JOIN (VALUES " + ", ".join(f"({i}, '{p}')" for i, _, p in _SET) + ") AS p(pattern_id, regex) ON regexp_matches(line, regex)")
def pattern_set_join(spark, sf_dir):
    return search.pattern_set(_docs(spark, sf_dir), spark.createDataFrame([x[:2] for x in _SET], "pattern_id int, regex string"), key="doc_id")


@_query("SELECT page_id, CAST(generate_subscripts(m, 1) AS BIGINT) AS match_no, unnest(m) AS match FROM (SELECT page_id, regexp_extract_all(html, 'href=\"[^\"\\n]*\"') AS m FROM pages)", with_lines=False)
def html_href(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return find_matches(pages, _O(patterns=pattern("data/html_link")), text="html", keep=["page_id"]).select("page_id", "match_no", "match")


@_query("SELECT conv_id, CAST(coalesce(sum(len(regexp_extract_all(text, '[^\\n]*thing[^\\n]*'))), 0) AS BIGINT) AS n FROM conversations GROUP BY conv_id", with_lines=False)
def conversation_grep(spark, sf_dir):
    """A conversation is a file of several rows."""
    return search.count_lines(_table(spark, sf_dir, "conversations").select("conv_id", "text"), _O(patterns=("thing",)), key="conv_id", unique=False)


@_query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(contains(text, 'thing')) AND NOT bool_or(contains(text, 'ation'))", with_lines=False)
def conversation_files(spark, sf_dir):
    return boolean.matching_files(_table(spark, sf_dir, "conversations").select("conv_id", "text"), boolean.parse("thing -ation"), key="conv_id")


@_query("""SELECT (SELECT count(*) FROM documents) AS files, count(DISTINCT CASE WHEN hit THEN doc_id END) AS files_matched, count(*) AS lines, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS lines_matched, CAST(sum(m) AS BIGINT) AS matches,
(SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes, count(DISTINCT CASE WHEN hit THEN doc_id END) / (SELECT count(*) FROM documents) AS ratio
FROM (SELECT doc_id, regexp_matches(line, 'thing') AS hit, len(regexp_extract_all(line, 'thing')) AS m FROM lines)""")
def stats_summary(spark, sf_dir):
    return search.stats(_docs(spark, sf_dir), _O(patterns=("thing",)))


@_query("SELECT page_id, url FROM pages WHERE regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*\\.example\\.(net|com)/en/[^/]*$') AND NOT regexp_matches(url, '\\.html$')", with_lines=False)
def glob_select(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_replace("url", "^https?://", "")
    return pages.filter(globs.globs_condition(path, ["*.example.net/en/*", "*.example.com/en/*"], exclude=["*.html"]))


@_query("SELECT dir, count(*) AS files, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([split_part(p, '/', 1), split_part(p, '/', 1) || '/' || split_part(p, '/', 2), '']) AS dir, n FROM (SELECT regexp_extract(url, '^https?://([^/]+/[^/]+/)', 1) || 'x' AS p, strlen(html) AS n FROM pages)) GROUP BY dir", with_lines=False)
def tree_counts(spark, sf_dir):
    path = F.concat(F.regexp_extract("url", "^https?://([^/]+/[^/]+/)", 1), F.lit("x"))
    return search.tree(_table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").alias("n")), n="n")


@_query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS length FROM pages WHERE strlen(html) BETWEEN 2048 AND 8192", with_lines=False)
def size_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("length"))
    return pages.filter(globs.size_condition("length", "2k", "8k"))


@_query("SELECT doc_id, doc_id % 3 > 0 OR contains(text, chr(0)) AS binary FROM documents", with_lines=False)
def binary_filter(spark, sf_dir):
    """A third of the documents end in NUL, a third in a byte that isn't UTF-8."""
    end = F.element_at(F.array(F.lit(b""), F.lit(b"\0"), F.lit(b"\xff")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", is_binary(F.concat(F.encode("text", "UTF-8"), end)).alias("binary"))


@_query("SELECT key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '\"([a-z_]+)\":', 1)) AS key FROM events) GROUP BY key", with_lines=False)
def json_keys(spark, sf_dir):
    found = search.only_matching(_table(spark, sf_dir, "events").select("event_id", "props"), _O(patterns=pattern("data/json_key")), key="event_id", text="props")
    return found.groupBy(F.regexp_replace("match", '"', "").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]\\.\\n[A-Z]')) AS BIGINT) AS n FROM documents", with_lines=False)
def multi_line(spark, sf_dir):
    """Matches over a line end, zeros kept."""
    return search.count_matches(_docs(spark, sf_dir), _O(patterns=(r"[a-z]\.\n[A-Z]",)), key="doc_id")


@_query(r"SELECT doc_id, line_no, CASE WHEN s > 10 THEN '...' || substr(line, s - 7, 8) ELSE substr(line, 1, s) END || 'license' || substr(line, s + 8, CASE WHEN length(line) - s - 7 > 10 THEN 7 ELSE 10 END) || CASE WHEN length(line) - s - 7 > 10 THEN '...' ELSE '' END AS context FROM (SELECT *, strpos(line, 'license') - 1 AS s FROM lines) WHERE s >= 0")
def column_context(spark, sf_dir):
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("license",)), "doc_id")
    return context.column_context(found, 10).select("doc_id", "line_no", "context")


@_query("SELECT doc_id, line_no, left(line, 20) AS line FROM lines WHERE contains(line, 'thing')")
def line_width(spark, sf_dir):
    return _numbered(context.cut_width(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("thing",), dialect="fixed"), key="doc_id"), 20))


@_query("SELECT doc_id, line_no, lower(hex(encode(match))) AS hex FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]+@[a-z0-9]+')) AS match FROM lines)")
def hex_fields(spark, sf_dir):
    return search.only_matching(_docs(spark, sf_dir), _O(patterns=("[0-9]+@[a-z0-9]+",)), key="doc_id").select("doc_id", "line_no", E.hex_text("match").alias("hex"))


@_query("SELECT doc_id, CAST(i * 16 AS BIGINT) AS offset, lower(substr(h, i * 32 + 1, 32)) AS hex FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 31) // 32)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))", with_lines=False)
def hexdump(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("text", F.encode("text", "UTF-8"))
    return render.hexdump(rows, "text", offset=None, keep=["doc_id"]).select("doc_id", "offset", F.replace("hex", F.lit(" "), F.lit("")).alias("hex"))


_MATCHING = "SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'licen')"


@_query(_MATCHING)
def index_prune(spark, sf_dir):
    """Search through the index: documents that can't hold the literal aren't searched, and no match is lost."""
    files = _docs(spark, sf_dir).withColumn("mtime", F.lit(0))
    o = _O(patterns=("licen",))
    made = index.build(files, key="doc_id", content="text", mtime="mtime")
    return _numbered(search.matching_lines(index.pruned(files, made, o, key="doc_id", mtime="mtime"), o, key="doc_id"))


def _packed(kind: int, name: str, data: bytes) -> bytes:
    if kind == 3:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        return out.getvalue()
    return (gzip.compress, bz2.compress, lzma.compress)[kind](data)


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'f' || doc_id || '{t.txt}' ELSE 'f' || doc_id END AS key, md5(text) AS digest FROM documents", with_lines=False)
def archive_parts(spark, sf_dir):
    """Documents packed by gzip, bzip2, xz or zip and read back as archive parts."""
    files = archives.packed(_docs(spark, sf_dir), lambda i, t: _packed(i % 4, "t.txt", t))
    return archives.expand(files).select(F.substring_index(F.substring("path", 2, 99), "{", 1).cast("long").alias("doc_id"), "key", F.md5("content").alias("digest"))


_LATIN9 = r"[\x00-\x{A3}\x{A5}\x{A7}\x{A9}-\x{B3}\x{B5}-\x{B7}\x{B9}-\x{BB}\x{BF}-\x{FF}\x{152}\x{153}\x{160}\x{161}\x{178}\x{17D}\x{17E}\x{20AC}]*"


@_query(rf"SELECT doc_id, md5(text) AS utf16, md5(text) AS utf32, CASE WHEN regexp_full_match(text, '[\x00-\x7F]*') THEN md5(text) END AS koi8, CASE WHEN regexp_full_match(text, '{_LATIN9}') THEN md5(text) END AS latin9 FROM documents", with_lines=False)
def decode_all_documents(spark, sf_dir):
    """Every document by way of UTF-16, UTF-32 and two code pages; a page that lacks one of its characters gives null in that column alone."""
    ascii_ = F.when(F.col("text").rlike(r"\A[\x00-\x7F]*\z"), F.encode("text", "US-ASCII"))
    # ISO-8859-15 is ISO-8859-1 but for eight characters
    latin9 = F.when(F.col("text").rlike(rf"\A{_LATIN9}\z"), F.encode(F.translate("text", "€ŠšŽžŒœŸ", "¤¦¨´¸¼½¾"), "ISO-8859-1"))
    docs = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-16").alias("utf16"), F.encode("text", "UTF-32").alias("utf32"), ascii_.alias("koi8"), latin9.alias("latin9"))
    return docs.select("doc_id", *(F.md5(encodings.decoded(out, name)).alias(out) for name, out in (("utf-8", "utf16"), ("utf-32", "utf32"), ("koi8-r", "koi8"), ("iso-8859-15", "latin9"))))


def _stream_out(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seekwell-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'thing')")
def stream_grep(spark, sf_dir):
    """The same search over a stream of document files, to a file sink."""
    out = _stream_out(spark)
    schema = _docs(spark, sf_dir).schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents*")
    q = streams.stream_documents(docs, _O(patterns=("thing",)), key="doc_id").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id long, line_no long, line string").parquet(f"{out}/rows")


@_query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events WHERE regexp_matches(props, '[0-9]') GROUP BY 1, 2", with_lines=False)
def stream_window_counts(spark, sf_dir):
    out = _stream_out(spark)
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streams.windowed_counts(events, _O(patterns=("[0-9]",)), at="ts", column="props", window="1 hour", by=["event_type"])
    counts = counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/log").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start string, event_type string, n long").parquet(f"{out}/rows")


@_query("SELECT event_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS piece_no, unnest(a) AS piece FROM (SELECT event_id, regexp_split_to_array(props, '[,:] ?') AS a FROM events)", with_lines=False)
def split_fields(spark, sf_dir):
    return search.split_text(_table(spark, sf_dir, "events").select("event_id", "props"), _O(patterns=("[,:] ?",)), key="event_id", text="props")


@_query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, 'S[A-Z]+|PRO(M|T)O')", with_lines=False)
def whole_text(spark, sf_dir):
    return search.whole_text(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), _O(patterns=("S[A-Z]+|PRO(M|T)O",)), text="p_type")


@_query("SELECT c_custkey, CAST(generate_subscripts(m, 1) AS BIGINT) AS match_no, unnest(m) AS match, CAST(CASE WHEN regexp_matches(unnest(m), '[A-Za-z]') THEN 1 WHEN regexp_matches(unnest(m), '[0-9]') THEN 2 ELSE 3 END AS INTEGER) AS accept FROM (SELECT c_custkey, regexp_extract_all(c_name, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]') AS m FROM customer)", with_lines=False)
def scan_names(spark, sf_dir):
    found = scan_tokens(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _O(patterns=("[A-Za-z]+", "[0-9]+", "[^A-Za-z0-9]")), text="c_name", keep=["c_custkey"])
    return found.select("c_custkey", "match_no", "match", "accept")


@_query("SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 1 THEN lower(hex(encode(line))) ELSE line END AS out FROM lines WHERE contains(line, 'thing')")
def binary_policy(spark, sf_dir):
    """Odd documents end in a NUL line, so they are binary and shown in hexadecimal."""
    content = F.encode(F.concat("text", F.when(F.col("doc_id") % 2 == 1, F.lit("\n\0")).otherwise(F.lit(""))), "UTF-8")
    return search.by_binary_policy(_docs(spark, sf_dir).select("doc_id", content.alias("content")), _O(patterns=("thing",), binary="with-hex"), key="doc_id")


from . import queries_more  # noqa: E402, F401  (adds its queries)
