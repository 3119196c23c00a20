"""Connected components of a link table by alternating large-star and small-star steps, and of a forest by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, sent_if_small, written


def _kept(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written down, with their number and sum of hashes, both from one pass."""
    seen = Observation()
    out = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")), "links")
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of ``links``; comp is the least node reachable.

    Each step links nodes to the least neighbour they know, so a hub's links are only ever joined with one
    row a hub and combined before they are shuffled.  Steps end when the links no longer change."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, state = _kept(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a small table is sent to the tasks and, beyond that, Spark can split a hub's links
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(sent_if_small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(sent_if_small(lower), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        old, before = e, state
        e, state = _kept(small)
        discard(old, least, lower)
        if before == state:
            break
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out = written(out, "components")
    discard(e)
    return out


def forest(parents: DataFrame) -> DataFrame:
    """(node, comp) of every node of a table of (node, parent) with at most one lesser parent a node; comp is the tree's root.

    Each step replaces a parent by its parent, so steps are as many as the binary logarithm of the depth."""
    p = written(parents.select("node", "parent"), "parents")
    while True:
        seen = Observation()
        above = p.select(F.col("node").alias("n"), F.col("parent").alias("up"))
        step = p.join(above, F.col("parent") == F.col("n"), "left").observe(seen, F.count("up").alias("moved")).select("node", F.coalesce("up", "parent").alias("parent"))
        old, p = p, written(step, "parents")
        discard(old)
        if not seen.get["moved"]:
            break
    out = written(p.select("node", F.col("parent").alias("comp")).union(p.select(F.col("parent").alias("node"), F.col("parent").alias("comp")).distinct()), "components")
    discard(p)
    return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after new ``links`` (a, b), which are few: only their components are joined anew."""
    of = lambda side: labels.select(F.col("node").alias(f"n_{side}"), F.col("comp").alias(f"c_{side}"))
    between = links.join(of("a"), F.col("a") == F.col("n_a"), "left").join(of("b"), F.col("b") == F.col("n_b"), "left")
    between = written(between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).filter("a <> b").distinct(), "between")
    moves = components(between).withColumnsRenamed({"node": "was", "comp": "now"})
    new = between.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    everyone = labels.select("node", "comp").union(new)
    out = written(everyone.join(moves, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp")), "components")
    discard(between)
    return out
