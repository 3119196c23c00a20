"""The ten operators as registered queries over their whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, mixing, near_dup, packing, quality, token_counts, url_lists, warc
from .shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _number(column) -> F.Column:
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("int")


def _day(n) -> F.Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the corpus's own hosts, domains and first path segments by their hashes."""
    host = url_lists.host_of(F.col("url"))
    first = F.split(F.regexp_extract("url", url_lists.PATH, 1), "/")[0]
    hosts = pages.select(host.alias("entry")).filter("entry is not null").distinct().select("entry", _number(F.col("entry")).alias("h"))
    domains = pages.select(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("entry")).filter("entry <> ''").distinct().select("entry", _number(F.col("entry")).alias("h"))
    paths = pages.select(host.alias("host"), first.alias("s")).filter("host is not null and s <> ''").select(F.concat("host", F.lit("/"), "s").alias("entry")).distinct().select("entry", _number(F.col("entry")).alias("h"))
    start = F.col("h") % 200
    of = lambda rows, name, action, day: rows.select(F.lit(name).alias("list"), "entry", F.lit(action).alias("action"), _day(day).alias("effective"))
    hot = hosts.filter("h % 3 = 0")
    return (of(hot, "hosts", "add", start).union(of(hot, "hosts", "remove", start + 60)).union(of(hot.filter("h % 2 = 0"), "hosts", "add", start + 120))
            .union(of(domains, "domains", "add", start)).union(of(domains, "domains", "remove", start + 30))
            .union(of(paths.filter("h % 5 = 0"), "paths", "add", start)))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, fetched on a day of 2024 set by their id, against ``dated_list``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", _day(F.pmod(F.col("page_id") * 37, F.lit(366))))
    out = url_lists.active_entries(captures, dated_list(pages))
    return out.withColumn("fetched", F.col("fetched").cast("string"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with later answers (from turn 2 to 4 on, by its id) cut to their first half."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    worse = F.when((F.col("role") == "assistant") & (F.col("turn") >= 2 + F.pmod(F.col("pair_id"), F.lit(3))), F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    sides = turns.select("pair_id", "turn", "role", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("t")), F.struct(F.lit("rejected").alias("side"), worse.alias("t")))).alias("x"))
    return chat.preference_pairs(sides.select("pair_id", "turn", "role", "x.side", F.col("x.t").alias("text")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(~quality.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_nearest_neighbours, op4_chat_formatting, op5_packing, op6_decontamination, op7_warc, op8_near_duplicates, op9_quality, op10_mixing)}

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)"
_H = "CAST(('0x' || substr(md5(entry), 1, 7)) AS INTEGER) AS h"

ORACLE_SQL = {
    "op2_url_filters": rf"""
WITH c AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched FROM pages),
h AS (SELECT entry, {_H} FROM (SELECT DISTINCT host AS entry FROM c WHERE host IS NOT NULL)),
d AS (SELECT entry, {_H} FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS entry FROM c) WHERE entry <> ''),
p AS (SELECT entry, {_H} FROM (SELECT DISTINCT host || '/' || split_part(path, '/', 1) AS entry FROM c WHERE host IS NOT NULL AND split_part(path, '/', 1) <> '')),
e AS (
  SELECT 'hosts' AS l, entry, 1 AS a, h % 200 AS day FROM h WHERE h % 3 = 0
  UNION ALL SELECT 'hosts', entry, 0, h % 200 + 60 FROM h WHERE h % 3 = 0
  UNION ALL SELECT 'hosts', entry, 1, h % 200 + 120 FROM h WHERE h % 6 = 0
  UNION ALL SELECT 'domains', entry, 1, h % 200 FROM d
  UNION ALL SELECT 'domains', entry, 0, h % 200 + 30 FROM d
  UNION ALL SELECT 'paths', entry, 1, h % 200 FROM p WHERE h % 5 = 0),
s AS (SELECT *, lead(day) OVER (PARTITION BY l, entry ORDER BY day, a) AS until FROM e),
hits AS (
  SELECT DISTINCT c.page_id, s.l || ':' || s.entry AS hit
  FROM c JOIN s ON s.a = 1 AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry) OR c.host || '/' || c.path = s.entry OR starts_with(c.host || '/' || c.path, s.entry || '/'))
  WHERE c.fetched >= DATE '2024-01-01' + CAST(s.day AS INTEGER) AND (s.until IS NULL OR c.fetched < DATE '2024-01-01' + CAST(s.until AS INTEGER)))
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, CAST(count(hit) AS BIGINT) AS n_active, coalesce(string_agg(hit, ',' ORDER BY hit), '') AS entries, count(hit) > 0 AS blocked
FROM c LEFT JOIN hits USING (page_id) GROUP BY c.page_id, c.host, c.fetched""",
    "op4_chat_formatting": r"""
WITH s AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn >= 2 + conv_id % 3 THEN left(text, length(text) // 2) ELSE text END FROM conversations),
t AS (SELECT pair_id, side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM s),
n AS (
  SELECT pair_id, coalesce(min(i) FILTER (WHERE differ) - 1, max(i)) AS n
  FROM (SELECT pair_id, i, count(*) < 2 OR count(DISTINCT role) > 1 OR count(DISTINCT text) > 1 AS differ FROM t GROUP BY pair_id, i) GROUP BY pair_id),
r AS (SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body,
  '0:' || (length(role) + 5) || ',' || CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END || (length(text) + 8) AS mask FROM t JOIN n USING (pair_id))
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i <= n), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n), '') AS chosen,
  coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 'chosen' AND i > n), '') AS chosen_mask,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n), '') AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 'rejected' AND i > n), '') AS rejected_mask
FROM r GROUP BY pair_id""",
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
ms AS (SELECT DISTINCT m FROM b),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw USING (m, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256,
  coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM m""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS rnd FROM documents),
s AS (SELECT source, sum(size) AS ssize, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM d GROUP BY source),
f AS (SELECT *, (SELECT sum(ssize) FROM s) * 1.5 - coalesce(sum(2.0 * ssize) OVER (ORDER BY 2.0 * ssize / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 2.0 * ssize / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
x AS (SELECT arg_min(rest / ws, 2.0 * ssize / w) AS x FROM f WHERE rest / ws * w <= 2.0 * ssize),
t AS (SELECT source, CAST(ssize AS BIGINT) AS source_size, CAST(least(2.0 * ssize, coalesce(x.x * w, 2.0 * ssize)) AS DOUBLE) AS target FROM s, x),
r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY rnd, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM e""",
    # exact by prefix filter: two sets this alike share one of the rarest fifth (and one) of the larger set's shingles
    "op8_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.*, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, g) AS k FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)),
p AS (SELECT * FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
m AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
