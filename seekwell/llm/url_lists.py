"""URL filters with dated lists: a temporal list join in DataFrame operations.

A list is a table of dated events (list, entry, action, effective): an entry is added or removed from a date
on.  Events become validity intervals ``[from, to)``.  An entry is a domain, which covers its subdomains, or
a domain and leading path segments (``host/a/b``), which cover what lies below.  A capture's candidates are
its host's suffixes and its host with each run of leading segments; each is looked up as of its fetch time.

Candidates and times are made distinct before the interval join (so a host that holds a third of all
captures is joined once a fetch time) and answers are joined back on both, then gathered by capture.  The
list is never broadcast by hint; Spark decides by its measured size.

Cases: a null or host-less URL, or a null time, has no active entries; entries of null name or date are no
events; at equal dates ``add`` wins over ``remove``; an entry added twice is active once; repeated capture
keys share their rows' entries; empty tables give an empty result or no active entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url) -> F.Column:
    """Lower-case host, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def candidates_of(url) -> F.Column:
    """All entries that could cover a URL: suffixes of its host, and its host with leading path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(suffixes, prefixes))


def entry_of(entry) -> F.Column:
    """An entry with its host in lower case; a path keeps its case, as in URLs."""
    host = F.substring_index(entry, "/", 1)
    return F.concat(F.lower(host), F.substring(entry, F.length(host) + 1, F.length(entry)))


def intervals(events: DataFrame) -> DataFrame:
    """(list, entry, from, to) in which an entry is active; ``to`` is null while it still is."""
    e = events.filter(F.col("entry").isNotNull() & F.col("effective").isNotNull()).select("list", entry_of(F.col("entry")).alias("entry"), "action", "effective").distinct()
    order = W.partitionBy("list", "entry").orderBy("effective", F.when(F.col("action") == "add", 1).otherwise(0))
    e = e.withColumn("to", F.lead("effective").over(order))
    return e.filter((F.col("action") == "add") & (F.col("to").isNull() | (F.col("to") > F.col("effective")))).select("list", "entry", F.col("effective").alias("from"), "to")


def active_entries(captures: DataFrame, events: DataFrame, *, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """key, host, fetched, n_active, entries (``list:entry`` joined by commas, sorted) and blocked of every capture."""
    rows = captures.select(captures[key].alias("k"), captures[url].alias("u"), captures[at].alias("at"))
    seen = rows.select("k", host_of(F.col("u")).alias("host"), "at", F.explode_outer(candidates_of(F.col("u"))).alias("entry"))
    asked = seen.select("entry", "at").filter("entry is not null and at is not null").distinct()
    spans = intervals(events).withColumnsRenamed({"entry": "e"})
    answers = asked.join(spans, (F.col("entry") == F.col("e")) & (F.col("at") >= F.col("from")) & (F.col("to").isNull() | (F.col("at") < F.col("to"))))
    answers = answers.select("entry", "at", F.concat(F.coalesce("list", F.lit("")), F.lit(":"), "e").alias("hit")).distinct()
    joined = seen.join(answers, ["entry", "at"], "left")
    out = joined.groupBy("k", "host", "at").agg(F.collect_set("hit").alias("hits"))
    return out.select(F.col("k").alias(key), "host", F.col("at").alias(at), F.size("hits").cast("long").alias("n_active"), F.array_join(F.array_sort("hits"), ",").alias("entries"), (F.size("hits") > 0).alias("blocked"))
