"""More registered queries: longest matches, further dialect switches, path rules, archives, fields and the index."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import functions as F

from .functions.find import find_matches
from .operators import render, search
from .plans import boolean, globs
from .queries import _MATCHING, _O, _docs, _numbered, _query, _table
from .sources import archives, index
from .sources.types import type_condition

# --- longest matches; SQL's engine takes the first alternative, so its patterns name the longer ones first
_ANY = ("th|the|there|thing", "there|thing|the|th")


@_query(f"SELECT d.doc_id, CAST(coalesce(sum(len(regexp_extract_all(line, '{_ANY[1]}'))), 0) AS BIGINT) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def grep_count_alternatives(spark, sf_dir):
    return search.count_matches(_docs(spark, sf_dir), _O(patterns=(_ANY[0],)), key="doc_id")


@_query("SELECT d.doc_id, CAST(coalesce(sum(len(regexp_extract_all(line, 'ent|en|e|n'))), 0) AS BIGINT) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def grep_count_list(spark, sf_dir):
    return search.count_matches(_docs(spark, sf_dir), _O(patterns=("e", "en", "ent", "n")), key="doc_id")


@_query(f"SELECT doc_id, line_no, CAST(generate_subscripts(m, 1) AS BIGINT) AS match_no, unnest(m) AS match FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_ANY[1]}') AS m FROM lines)")
def only_matching_longest(spark, sf_dir):
    return search.only_matching(_docs(spark, sf_dir), _O(patterns=(_ANY[0],)), key="doc_id")


@_query(f"""SELECT (SELECT count(*) FROM documents) AS files, count(DISTINCT CASE WHEN m > 0 THEN doc_id END) AS files_matched, count(*) AS lines, CAST(sum(CAST(m > 0 AS INTEGER)) AS BIGINT) AS lines_matched, CAST(sum(m) AS BIGINT) AS matches,
(SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes, count(DISTINCT CASE WHEN m > 0 THEN doc_id END) / (SELECT count(*) FROM documents) AS ratio
FROM (SELECT doc_id, len(regexp_extract_all(line, '{_ANY[1]}')) AS m FROM lines)""")
def stats_alternatives(spark, sf_dir):
    return search.stats(_docs(spark, sf_dir), _O(patterns=(_ANY[0],)))


# --- dialect switches


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'thing')")
def grep_lookahead(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("th(?=ing)",)), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '[0-9]{2}[!-/:-@[-`{-~]|[A-Z]{2}')")
def grep_posix_classes(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("[[:digit:]]{2}[[:punct:]]|[[:upper:]]{2}",), ascii=True), key="doc_id"))


@_query(r"SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]+ .*\.$')")
def grep_anchors(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=(r"^[A-Z][a-z]+ .*\.$",)), key="doc_id"))


@_query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'th[aeio]ng')")
def grep_free_space(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("t h [aeio] n g  # a thing",), free_space=True), key="doc_id"))


@_query("SELECT d.doc_id, count(l.doc_id) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def grep_empty_matches(spark, sf_dir):
    """A pattern that matches the empty text selects every line."""
    return search.count_lines(_docs(spark, sf_dir), _O.egrep("(thing)*"), key="doc_id")


@_query("SELECT d.doc_id, count(l.doc_id) FILTER (WHERE NOT regexp_matches(l.line, 'thing')) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id")
def grep_count_inverted(spark, sf_dir):
    return search.count_lines(_docs(spark, sf_dir), _O(patterns=("thing",), invert=True), key="doc_id")


@_query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?s)license.{1,9}')) AS BIGINT) AS n FROM documents", with_lines=False)
def dot_all(spark, sf_dir):
    """Matches that may run over a line's end."""
    return search.count_matches(_docs(spark, sf_dir), _O(patterns=("license.{1,9}",), dot_all=True), key="doc_id")


@_query("SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'thing')")
def null_separated(spark, sf_dir):
    """Lines that end in NUL."""
    docs = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\0")))
    return _numbered(search.matching_lines(docs, _O(patterns=("thing",), null_data=True), key="doc_id"))


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = d.doc_id AND contains(line, 'the'))")
def files_inverted(spark, sf_dir):
    return search.files_with(_docs(spark, sf_dir), _O(patterns=("the",), invert=True), key="doc_id")


@_query("SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'thing') AND NOT (contains(line, 'ation') AND contains(line, 'the'))")
def bool_and_not(spark, sf_dir):
    return _numbered(search.matching_lines(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id").filter(boolean.line_condition(boolean.parse("thing -(ation the)"))))


@_query("SELECT doc_id, line_no, match, CAST(strlen(match) AS BIGINT) AS n_bytes, CAST(length(match) AS BIGINT) AS width FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'f[^ ]{3,6}')) AS match FROM lines)")
def match_sizes(spark, sf_dir):
    found = find_matches(_docs(spark, sf_dir), _O(patterns=("f[^ ]{3,6}",)), keep=["doc_id"])
    return found.select("doc_id", "line_no", "match", "n_bytes", "width")


# --- path rules; a page's address is its path
_PATHS = "(SELECT page_id, regexp_replace(url, '^https?://', '') AS path, strlen(html) AS n FROM pages)"


def _pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.octet_length("html").cast("long").alias("length"))


@_query(f"SELECT page_id, path FROM {_PATHS} WHERE len(string_split(rtrim(path, '/'), '/')) BETWEEN 3 AND 4 AND NOT ends_with(path, '/')", with_lines=False)
def depth_filter(spark, sf_dir):
    pages = _pages(spark, sf_dir).filter(~F.endswith("path", F.lit("/")))
    return pages.filter(globs.depth_condition("path", 3, 4)).select("page_id", "path")


@_query(f"SELECT page_id, path, regexp_matches(path, '\\.html$') AS html, NOT regexp_matches(path, '\\.(html|php)$') AS other FROM {_PATHS}", with_lines=False)
def extension_filter(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "path", globs.extension_condition("path", "html").alias("html"), globs.extension_condition("path", "!html,^php").alias("other"))


@_query(f"SELECT page_id, path FROM {_PATHS} WHERE regexp_matches(split_part(path, '/', -1), '\\.(htm|html|xhtml)$')", with_lines=False)
def type_filter(spark, sf_dir):
    return _pages(spark, sf_dir).filter(type_condition("path", "html")).select("page_id", "path")


@_query(f"SELECT page_id, path FROM {_PATHS} WHERE NOT (regexp_matches(path, '^[^/]*/en/') AND NOT regexp_matches(path, '9[^/]*$')) AND NOT contains(path, '.example.net/')", with_lines=False)
def ignore_rules(spark, sf_dir):
    """Rules of an ignore file: of those that match a path the last decides."""
    pages = _pages(spark, sf_dir)
    return pages.filter(~globs.ignored(pages, {"": "# rules\n*/en/\n!*9*\n*.example.net/\n"})).select("page_id", "path")


@_query(f"SELECT page_id, path FROM {_PATHS} WHERE NOT regexp_matches(path, '(?i)\\.HTML$') AND NOT contains(path, '/en/')", with_lines=False)
def directory_globs(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return pages.filter(~globs.glob_condition("path", "*.HTML", ignore_case=True) & ~globs.in_directory("path", "en")).select("page_id", "path")


@_query("SELECT page_id, regexp_matches(html, '^<(!DOCTYPE|html)') AS markup FROM pages", with_lines=False)
def magic_bytes(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return pages.select("page_id", globs.magic_condition("content", "<(!DOCTYPE|html)").alias("markup"))


@_query(f"SELECT page_id, n AS length FROM {_PATHS} ORDER BY n DESC, path DESC, page_id LIMIT 20", with_lines=False)
def sort_by_size(spark, sf_dir):
    return search.sorted_files(_pages(spark, sf_dir), "size", reverse=True).limit(20).select("page_id", "length")


# --- fields of templates


@_query("SELECT doc_id, doc_id || ':' || line_no || ':' || col || ':' || strlen(left(line, col - 1)) || ':3|the' AS out FROM (SELECT *, CAST(strpos(line, 'the') AS BIGINT) AS col FROM lines WHERE line_no = 1 AND contains(line, 'the'))")
def format_places(spark, sf_dir):
    """File, line, column, offset and size of the first match in first lines."""
    found = search.first_matches(_docs(spark, sf_dir), _O(patterns=("the",), max_line=1), "doc_id")
    return found.select("doc_id", render.template("%f:%n:%k:%b:%d|%o", key="doc_id").alias("out"))


@_query("SELECT doc_id, '\"' || doc_id || '\",' || n AS out FROM (SELECT d.doc_id, count(l.doc_id) AS n FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id AND contains(line, 'thing') GROUP BY d.doc_id)")
def count_records(spark, sf_dir):
    return render.count_records(search.count_lines(_docs(spark, sf_dir), _O(patterns=("thing",)), key="doc_id"), "csv", key="doc_id")


# --- archives


def _newc(name: str, data: bytes) -> bytes:
    def entry(n: str, d: bytes) -> bytes:
        raw = n.encode() + b"\0"
        head = b"070701" + b"".join(b"%08x" % v for v in (1, 0o100644, 0, 0, 1, 0, len(d), 0, 0, 0, 0, len(raw), 0))
        out = head + raw
        out += b"\0" * (-len(out) % 4) + d
        return out + b"\0" * (-len(out) % 4)

    return entry(name, data) + entry("TRAILER!!!", b"")


def _tar(name: str, data: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@_query("SELECT doc_id, 'f' || doc_id || '{t.txt}' AS key, md5(text) AS digest FROM documents", with_lines=False)
def archive_members(spark, sf_dir):
    """Documents as members of tar, cpio and compressed tar archives, read back."""
    of = (_tar, _newc, lambda n, d: gzip.compress(_tar(n, d)))
    files = archives.packed(_docs(spark, sf_dir), lambda i, t: of[i % 3]("t.txt", t))
    parts = archives.expand(files, depth=2)
    return parts.select(F.substring_index(F.substring("path", 2, 99), "{", 1).cast("long").alias("doc_id"), "key", F.md5("content").alias("digest"))


# --- index


@_query("SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'licen') OR contains(line, 'idiot') OR contains(line, 'clown')")
def index_prune_list(spark, sf_dir):
    """A list of patterns, one with alternatives: a file is searched if it may hold any of their literals."""
    files = _docs(spark, sf_dir).withColumn("mtime", F.lit(0))
    o = _O(patterns=("licen", "idiot|clown"))
    return _numbered(search.matching_lines(index.pruned(files, index.build(files, key="doc_id", content="text", mtime="mtime"), o, key="doc_id", mtime="mtime"), o, key="doc_id"))


@_query(_MATCHING)
def index_update(spark, sf_dir):
    """An index of old texts brought up to date for changed and new documents, then searched."""
    files = _docs(spark, sf_dir).withColumn("mtime", (F.col("doc_id") % 2).cast("int"))
    old = files.filter("doc_id % 3 > 0").select("doc_id", F.lit("nothing here").alias("text"), F.lit(0).alias("mtime"))
    old = files.filter("doc_id % 3 > 0 and mtime = 0").unionByName(old.filter("doc_id % 2 = 1"))
    o = _O(patterns=("licen",))
    made = index.build(old, key="doc_id", content="text", mtime="mtime")
    made = index.update(made, files, key="doc_id", content="text", mtime="mtime")
    return _numbered(search.matching_lines(index.pruned(files, made, o, key="doc_id", mtime="mtime"), o, key="doc_id"))
