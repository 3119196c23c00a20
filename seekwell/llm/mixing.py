"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source it is dealt by ranges of that key into buckets of
about ``per_bucket`` documents, sorted in them, and its place in the source's running total of sizes is the
bucket's offset (a running total of bucket totals) plus the running total inside the bucket: a range sort and
a distributed prefix sum in which a hot source is as many small tasks as its size asks for.  A source's
budget is cut exactly: it is its size for as many whole epochs as fit, then the documents before the rest of
the budget, the last of them in part.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; together they get ``share`` of all
sizes; no target is above ``most`` times its source's size, the excess being shared again by weight.  That is
min(most * size, x * weight) with the one x that gives the right total, found from the sources sorted by
size over weight.

Cases: null text has size 0 and is taken 0 times; null source is a source of its own, the last; all
sizes 0 give targets 0; repeated rows are rows of their own, ties in the key (a hash of id and text) are cut
by size and id, and equal rows are alike; an empty table gives an empty result.  Equal input gives equal output.

Sources are corpora, few beside documents: their table (one row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import free_name, sent_if_small, written

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size, target of each source of (source, size); one row a source."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(most))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    by = by.withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, 0)) + F.col("cap"))
    by = by.withColumn("x", F.col("left") / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("x", F.min(F.when(F.col("x") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "x"))).over(everything)["x"])
    return by.select("source", "n_docs", "source_size", F.least("cap", F.coalesce(F.col("x") * F.col("weight"), "cap")).alias("target"))


def _size(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _random(key: F.Column, text: F.Column, seed: str) -> F.Column:
    """The hash-random key: of the id and the text, so that null or repeated ids spread over the buckets as well."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit("")))))


def _sizes(df: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return written(df.select(df[key].alias("doc_id"), df[source].alias("source"), _size(df[text]).alias("size"), _random(df[key], df[text], seed).alias("rnd")), "sizes")


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, per_bucket: int = 4096, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    sizes = _sizes(df, key, text, source, seed)
    return _placed(sizes, weights=weights, share=share, most=most, per_bucket=per_bucket).select("doc_id", "size", "source_size", F.col("target").cast("double"), _taken().alias("taken"))


def _placed(sizes: DataFrame, *, weights, share: float, most: float, per_bucket: int) -> DataFrame:
    """(doc_id, source, size, rnd), which is read twice, with its source's size, target, whole epochs and rest of the budget, the
    words before each row (``before``), the rows equal in all of the order (``equals``) and those of them that come before it (``ahead``)."""
    # sources are few beside documents, but nothing bounds them: their table is not hinted
    targets = written(source_targets(sizes.select("source", "size"), weights=weights, share=share, most=most), "targets")
    rows = sizes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")))
    # sixteen bits of the key deal each source into equal ranges of it
    top = F.conv(F.substring("rnd", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(top * F.ceil(F.col("n_docs") / per_bucket) / F.lit(float(1 << 32))).cast("long"))
    order = W.partitionBy("source", "bucket").orderBy("rnd", "size", "doc_id")
    rows = rows.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("ahead", F.row_number().over(order) - F.rank().over(order))
    rows = rows.withColumn("equals", F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offsets = totals.withColumn("offset", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).select(F.col("source").alias("os"), F.col("bucket").alias("ob"), "offset")
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("os")) & (F.col("bucket") == F.col("ob")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "rnd", "source_size", "target", "ahead", "equals", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).cast("long").alias("rest"), (F.col("offset") + F.col("upto") - F.col("size")).alias("before"))


def _taken() -> F.Column:
    part = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return (F.col("epochs") * F.col("size") + part).cast("long")


def apply_mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, per_bucket: int = 4096, seed: str = "mix") -> DataFrame:
    """``df`` as the mix takes it: a document's rows once for each whole epoch, and once more, whole or cut after the words taken of
    it in part (one document a source), where its budget goes beyond whole epochs.

    Only the place of each source's cut is joined with the rows, so texts are not shuffled.  Rows equal in source, id and text
    are taken one after another; only those that stand at a cut are numbered."""
    placed = _placed(_sizes(df, key, text, source, seed), weights=weights, share=share, most=most, per_bucket=per_bucket)
    at_cut = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size"))
    cuts = placed.groupBy("source").agg(
        F.max("epochs").alias("epochs"),
        F.min(F.when(at_cut, F.struct("rnd", "size", "doc_id", (F.col("rest") - F.col("before") + F.col("ahead") * F.col("size")).alias("words"), "equals"))).alias("cut"))
    own = free_name(df, "sw_mix")
    # one row a source, written and then sent or shuffled by its counted rows
    cuts = written(cuts.select(F.struct("source", "epochs", "cut").alias(own)), "cuts")
    tied = not cuts.filter(f"`{own}`.cut.equals > 1").isEmpty()
    of = lambda name: F.col(f"`{own}`.{name}")
    rnd, size, number, extra = _random(df[key], df[text], seed), *(free_name(df, c) for c in ("sw_copy", "sw_number", "sw_extra"))
    rows = df.filter(df[text].rlike(WORD)).withColumn(size, F.lit(None).cast("long"))
    rows = rows.join(sent_if_small(cuts, 1 << 16), rows[source].eqNullSafe(of("source")))
    # words beyond whole epochs: none (0), all (null), or at the cut (-1) what is left there
    equal = rnd == of("cut.rnd")
    lesser = (rnd < of("cut.rnd")) | (equal & F.coalesce(df[key] < of("cut.doc_id"), df[key].isNull()))
    rows = rows.withColumn(extra, F.when(of("cut").isNull(), F.lit(0)).when(equal & df[key].eqNullSafe(of("cut.doc_id")), F.lit(-1)).when(lesser, F.lit(None)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn(number, F.lit(0))
    if tied:
        cutting = rows.filter(F.col(extra) == -1).withColumn(number, F.row_number().over(W.partitionBy(of("source")).orderBy(F.lit(1))) - 1)
        rows = rows.filter(F.coalesce(F.col(extra), F.lit(0)) != -1).unionByName(cutting)
    left = F.greatest(F.lit(0), of("cut.words") - F.col(number) * of("cut.size"))
    rows = rows.withColumn(extra, F.when(F.col(extra) == -1, F.when(left < of("cut.size"), left)).otherwise(F.col(extra)))
    times = of("epochs") + F.when(F.col(extra).isNull() | (F.col(extra) > 0), F.lit(1)).otherwise(F.lit(0))
    rows = rows.filter(times > 0).withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.when(F.col(size) > of("epochs"), F.col(extra))
    parts = F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+", (words + 1 + F.col(f"`{text}`").rlike(r"\A[\x20\x09-\x0D]").cast("long")).cast("int"))
    cut = F.left(F.col(f"`{text}`"), F.length(f"`{text}`") - F.length(F.element_at(parts, -1)))
    return rows.select(*(F.when(words.isNotNull(), cut).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
