"""From raw documents to packed training rows: quality, near duplicates, contamination, mixture, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  ``run`` writes each
stage's rows to the shared folder and reads them back, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm import decontaminate, mixing, near_dup, packing, quality
from seekwell.llm.shared import discard, free_name, sent_if_small, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 for quality.

    Every row is scored by its own text: repeated rows and null ids are rows of their own, null and empty texts score the
    model's bias, an empty table stays empty, further columns pass, and without labels all score 0.5 and stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "sw_score")
    return quality.score(docs, model, out=name).filter(F.col(name) >= 0.3).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the least id.

    Texts without words, null ones among them, are like nothing and stay.  Where ids are null or repeat, rows are numbered
    by id (null last) and by their other columns that have an order, and the numbers stand for the ids: each row is
    judged by itself, and the first row of a group stays.  An empty table stays empty; further columns pass."""
    row, gone_id = free_name(docs, "sw_row"), free_name(docs, "sw_gone")
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        keyed = docs.withColumn(row, F.col("doc_id").cast("long"))
    else:
        order = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        # written, so that numbers stay when tasks are repeated
        keyed = written(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text", *order).withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_dup.near_duplicates(keyed, key=row)
    gone = written(groups.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    discard(*groups._seekwell_tables)
    return keyed.join(sent_if_small(gone), F.col(row) == F.col(gone_id), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item (13 words, or the whole of a shorter item).

    One window is enough, however long the document: a passage in a long text trains a model just as well.  Null and empty
    texts and rows of an empty benchmark have no hits and stay; repeated rows and null ids are rows of their own."""
    hits = free_name(docs, "sw_n_hit")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), prefix="sw_").filter(F.col(hits) == 0).select(*(f"`{c}`" for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, the last of each source cut to the budget.

    Texts without words are taken 0 times; a null source is a source of its own; equal rows are taken one after another;
    an empty table stays empty; further columns pass."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids: each row's text is one document, null and empty ones without tokens; ids may be null or
    repeat; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-ID output", packing_stage),
]

#: The classifier and the vocabulary are beyond SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
