"""Approximate nearest neighbours with a forest of random-projection trees.

*Index.* Each tree is grown on a bounded sample (``sample`` rows, those with the least hash of their id): a
node splits at the median along the difference of two means of a few of its rows, down to leaves of about
``leaf_rows`` of all rows, or of two rows of the sample, so that the forest stays some tens of megabytes
(``trees * sample / 2`` nodes) and can be sent to every task.  Every row is then dealt to one leaf of every tree.

*Search.* A query has one priority queue over all trees; the node with the best margin is opened next, and
leaves are visited until they hold a budget of rows, repeats over trees counted.  The budget is a number of rows
learned from the data: ``probes`` queries are compared with all rows once, and where in their queues the true
neighbours' leaves stand tells how many rows must be visited to find a share ``recall`` of them.  On vectors with
structure that is few rows at any table size; on random ones it's a large share of all, which no index avoids.

*Reranking.* Leaves of a tree that lie side by side make a cell.  A query goes once to every cell that holds
leaves of its, with the leaves' numbers, and is compared exactly with the rows of those leaves.  The ``k`` best of
the sample's first ``first_rows`` are a query's first hits, and the least of their scores keeps lesser ones from being emitted.  The best are merged
over cells, by scores that are sums of double-precision products of the original vectors.

Equal vectors are searched once, as a class of its least ``k + 1`` ids (no more can be among a query's k);
cells of more than ``block`` rows are cut into parts, so none must fit one task.

Cases: vectors that are null, zero, hold null or non-finite components, or lack the table's most common
dimension take no part, nor do null ids; ids should be unique (of repeated ids the rows are candidates of
their own); ties, however many, go to the smaller id; fewer than k candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import map_arrow
from .shared import group_of_row, ship, written


class Forest:
    """Perfect binary trees in arrays: node i has children 2i+1 and 2i+2; leaves follow the inner nodes."""

    def __init__(self, x: np.ndarray, trees: int, leaves: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        depth = 0
        while (2 << depth) <= leaves and (4 << depth) <= max(len(x), 1):  # leaves of two sample rows at least
            depth += 1
        self.depth, self.inner, d = depth, (1 << depth) - 1, x.shape[1]
        self.w = np.zeros((trees, self.inner, d), np.float32)
        self.t = np.zeros((trees, self.inner), np.float32)
        for k in range(trees):
            rows = {0: np.arange(len(x))}
            for i in range(self.inner):
                own = rows.pop(i)
                w = rng.normal(size=d)
                if len(own) >= 2:
                    few = x[rng.choice(own, min(len(own), 256), replace=False)]
                    a, b = few[0], few[1]
                    for _ in range(4):
                        left = few @ (a - b) > (a @ a - b @ b) / 2
                        if left.all() or not left.any():
                            break
                        a, b = few[left].mean(0), few[~left].mean(0)
                    if np.linalg.norm(a - b) > 1e-12:
                        w = a - b
                w = (w / np.linalg.norm(w)).astype(np.float32)
                p = x[own] @ w
                t = np.float32(np.median(p)) if len(own) else np.float32(0)
                self.w[k, i], self.t[k, i] = w, t
                rows[2 * i + 1], rows[2 * i + 2] = own[p <= t], own[p > t]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, (rows, trees)."""
        out = np.zeros((len(x), len(self.w)), np.int32)
        for k in range(len(self.w)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.w[k][at]) > self.t[k][at])
            out[:, k] = at - self.inner
        return out

    def queue(self, q: np.ndarray):
        """Numbers ``tree * leaves + leaf`` in the order of one priority queue shared by all trees."""
        w, t, inner = self.w, self.t, self.inner
        heap = [(-np.inf, k, 0) for k in range(len(w))]
        while heap:
            far, k, i = heapq.heappop(heap)
            while i < inner:
                m = float(w[k, i] @ q - t[k, i])
                near, other = (2 * i + 2, 2 * i + 1) if m > 0 else (2 * i + 1, 2 * i + 2)
                heapq.heappush(heap, (max(far, abs(m)), k, other))
                i = near
            yield k * (inner + 1) + i - inner

    def depths(self, q: np.ndarray) -> np.ndarray:
        """The margin at which ``queue`` reaches each leaf, by numbers ``tree * leaves + leaf``, all at once."""
        m = np.einsum("kij,j->ki", self.w, q) - self.t
        far = np.full((len(self.w), 1), -np.inf, np.float32)
        for level in range(self.depth):
            at = m[:, (1 << level) - 1 : (2 << level) - 1]
            beyond = np.maximum(far, np.abs(at))
            far = np.stack([np.where(at > 0, beyond, far), np.where(at > 0, far, beyond)], axis=2).reshape(len(far), -1)
        return far.ravel()

    def visits(self, q: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves in the queue's order until they hold ``enough`` rows, a leaf of each tree at least."""
        out, have = [], 0
        for leaf in self.queue(q):
            out.append(leaf)
            have += sizes[leaf]
            if have >= enough and len(out) >= len(self.w):
                break
        return out


HITS = T.StructType([T.StructField("q", T.LongType()), T.StructField("c", T.LongType()), T.StructField("score", T.DoubleType())])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _best(exact: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query by (score descending, id), of flat lists."""
    order = np.lexsort((ids, -exact, q))
    first = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the ``k`` best rows of each query whose scores reach its ``bound``, ties to the smaller id.

    A matrix product, exact but for rounding, chooses; scores are summed anew in one fixed order, and ties are kept whole until then."""
    s = queries @ rows.T
    slack = 1e-9 * (1 + np.abs(s).max(initial=0))
    floor = bound - slack
    if s.shape[1] > k:
        many = np.flatnonzero((s >= floor[:, None]).sum(1) > k)
        if len(many):
            floor[many] = np.maximum(floor[many], np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
    q, c = np.nonzero(s >= floor[:, None])
    exact = np.concatenate([(queries[q[i : i + 65536]] * rows[c[i : i + 65536]]).sum(1) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
    best = _best(exact, ids[c], q, k)
    return q[best], ids[c[best]], exact[best]


def nearest(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query_filter: str = "id % 20 = 0", k: int = 20, trees: int = 16, leaf_rows: int = 64, sample: int = 16384, recall: float = 0.95, probes: int = 96, first_rows: int = 1024, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by largest inner product of each row that ``query_filter`` (on ``id``) admits."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[vector].dataType.elementType.simpleString()
    rows = df.select(df[key].cast("long").alias("id"), df[vector].alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one vector
    rows = rows.withColumn("v", F.transform("v", lambda x: (x + F.lit(0).cast(kind)).cast(kind)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    rows = rows.filter(F.size("v") == dims["d"])
    least = W.partitionBy("v").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    members = written(kept.withColumn("class", F.min("id").over(W.partitionBy("v"))), "classes")
    reps = members.filter("n = 1").select(F.col("id").alias("class"), "v")
    queries = written(rows.filter(F.expr(query_filter)).join(reps, "v").select("id", "class"), "queries")

    total = reps.count()
    chosen = reps.orderBy(F.xxhash64("class"), "class").limit(sample).collect()
    x = np.array([r["v"] for r in chosen], np.float64)
    forest = Forest(x, trees, max(1, -(-total // leaf_rows)))
    n_leaves = forest.inner + 1
    sent = spark.sparkContext.broadcast((forest, x[:first_rows], np.array([r["class"] for r in chosen[:first_rows]], np.int64)))
    vt = f"array<{kind}>"

    def deal(batches):
        f = sent.value[0]
        for batch in batches:
            v = _matrix(batch.column(1)).astype(np.float32)
            at = f.leaf(v) + np.arange(trees, dtype=np.int32) * n_leaves
            n = len(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), pa.array(at.ravel(), pa.int32()))], names=["class", "v", "leaf"])

    dealt = written(map_arrow(reps, deal, f"class long, v {vt}, leaf array<int>"), "leaves")
    counts = np.zeros(trees * n_leaves, np.int64)
    for r in dealt.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().collect():  # one row a leaf of the bounded forest
        counts[r["leaf"]] = r["count"]
    enough = _budget(dealt, queries, forest, counts, k, recall, probes)
    known = spark.sparkContext.broadcast((counts, enough))

    # cells: runs of leaves of one tree of at most about ``block`` rows
    side = 1
    while side < n_leaves and counts.sum() / len(counts) * side * 2 <= block:
        side *= 2

    def seek(batches):
        (f, x, names), (n, enough) = sent.value, known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = _matrix(part.column(1)).astype(np.float64)
                # the best of the sample, one more than k, as the query may stand in it: each query's first hits and its bound
                most = min(k + 1, len(x))
                _, best, score = (z.reshape(len(v), most) for z in top(v, x, names, most, np.full(len(v), -np.inf)))
                low = score[:, -1] if most > k else np.full(len(v), -np.inf)
                own, cells, leaves, first = [], [], [], []
                for i, q in enumerate(v.astype(np.float32)):
                    seen = np.sort(np.array(f.visits(q, n, enough), np.int32))
                    cut = np.flatnonzero(np.diff(seen // side)) + 1
                    for j, run in enumerate(np.split(seen, cut)):
                        first.append([{"c": c, "score": z} for c, z in zip(best[i].tolist(), score[i].tolist())] if j == 0 else [])
                        own.append(i)
                        cells.append(run[0] // side)
                        leaves.append(run)
                take = pa.array(own, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cells, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), pa.array(low[own]), pa.array(first, pa.list_(pa.struct([("c", pa.int64()), ("score", pa.float64())])))], names=["class", "v", "cell", "leaves", "low", "first"])

    asked = map_arrow(queries.select("class").distinct().join(reps, "class"), seek, f"class long, v {vt}, cell int, leaves array<int>, low double, first array<struct<c: long, score: double>>")
    asked = written(asked, "visits")
    sampled = asked.select(F.col("class").alias("q"), F.inline("first"))
    asked = asked.select(F.lit(1).alias("kind"), "class", "v", "cell", "leaves", "low")
    per_cell = counts.reshape(-1, side).sum(1)
    parts = F.element_at(F.array(*(F.lit(int(c)) for c in -(-np.maximum(per_cell, 1) // block))), F.col("cell") + 1) if per_cell.max(initial=0) > block else F.lit(1)
    own = dealt.select(F.lit(0).alias("kind"), "class", "v", F.explode("leaf").alias("leaf"))
    own = own.select("kind", "class", "v", F.floor(F.col("leaf") / side).cast("int").alias("cell"), F.array("leaf").alias("leaves"), F.lit(None).cast("double").alias("low"))
    own = own.withColumn("part", group_of_row("class", parts.cast("long")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    # a cell's rows come first, its queries stream after them in batches: any number of queries is fine
    both = own.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")

    def rank(batches):
        at, held, ids, vs, starts, leaves = None, [], None, None, None, None
        for batch in batches:
            kinds, classes, cell, low, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 5, 6))
            m = _matrix(batch.column(2)).astype(np.float64)
            lists = batch.column(4)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) if len(lists) else np.zeros(1, np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            where = cell.astype(np.int64) * (1 << 31) + part
            edge = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kinds[1:] != kinds[:-1])))) if len(where) else []
            for a, b in zip(edge, [*edge[1:], len(where)]):
                if where[a] != at:
                    at, held, ids = where[a], [], None
                if kinds[a] == 0:
                    held.append((flat[ends[a] : ends[b]], classes[a:b], m[a:b]))
                    continue
                if not held:
                    continue
                if ids is None:  # rows sorted by leaf
                    leaf = np.concatenate([h[0] for h in held])
                    order = np.argsort(leaf, kind="stable")
                    ids, vs = np.concatenate([h[1] for h in held])[order], np.concatenate([h[2] for h in held])[order]
                    leaves, starts = np.unique(leaf[order], return_index=True)
                    starts, held = np.append(starts, len(order)), [()]
                for s in range(a, b, 1024):
                    e = min(b, s + 1024)
                    which, who = flat[ends[s] : ends[e]], np.repeat(np.arange(s, e), np.diff(ends[s : e + 1]))
                    order = np.argsort(which, kind="stable")
                    which, who = which[order], who[order]
                    out = []
                    for x, y, f, t in zip(np.searchsorted(which, leaves).tolist(), np.searchsorted(which, leaves, "right").tolist(), starts[:-1].tolist(), starts[1:].tolist()):
                        if x < y:
                            q, c, score = top(m[who[x:y]], vs[f:t], ids[f:t], k + 1, low[who[x:y]])
                            out.append((who[x:y][q], c, score))
                    if not out:
                        continue
                    q, c, score = (np.concatenate(z) for z in zip(*out))
                    best = _best(score, c, q, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(classes[q[best]]), pa.array(c[best]), pa.array(score[best])], names=HITS.names)

    # a pair that meets in several trees has one score
    hits = map_arrow(both, rank, HITS).union(sampled).groupBy("q", "c").agg(F.max("score").alias("score"))
    best = hits.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("n") <= k + 1).select("q", "c", "score")
    ids = members.select(F.col("class").alias("c"), F.col("id").alias("vec_id"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = best.join(ids, "c").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("q", "vec_id", "score")
    # one class's list is joined with the queries of that class and its own id taken out
    out = queries.withColumnRenamed("id", "query_id").join(found, F.col("class") == F.col("q")).filter("vec_id <> query_id")
    final = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", final).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _budget(dealt: DataFrame, queries: DataFrame, forest: Forest, counts: np.ndarray, k: int, recall: float, probes: int) -> int:
    """Rows to visit: the least number that finds a share ``recall`` of the true neighbours of ``probes`` queries.

    The probes (those with the least hash of their class) are compared with every row, in blocks; each batch hands on its ``k`` best."""
    spark = dealt.sparkSession
    asked = queries.select("class").distinct().orderBy(F.xxhash64("class"), "class").limit(probes)
    asked = dealt.join(F.broadcast(asked), "class").select("class", "v").collect()  # at most ``probes`` rows
    if not asked:
        return 0
    names, v = np.array([r["class"] for r in asked]), np.array([r["v"] for r in asked], np.float64)
    sent = spark.sparkContext.broadcast((names, v))

    def run(batches):
        names, v = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = part.column(0).to_numpy()
                q, c, score = top(v, _matrix(part.column(1)).astype(np.float64), np.arange(len(ids)), k + 1, np.full(len(v), -np.inf))
                other = ids[c] != names[q]
                yield pa.RecordBatch.from_arrays([pa.array(names[q[other]]), pa.array(ids[c[other]]), pa.array(score[other]), part.column(2).take(pa.array(c[other]))], names=["q", "c", "score", "leaf"])

    hits = map_arrow(dealt, run, "q long, c long, score double, leaf array<int>")
    best = hits.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("n") <= k)
    leaves: dict[int, list] = {}
    for r in best.select("q", "leaf").collect():  # probes * k rows
        leaves.setdefault(r["q"], []).append(r["leaf"])
    need = []
    for name, q in zip(names.tolist(), v.astype(np.float32)):
        order = np.argsort(forest.depths(q), kind="stable")
        until = np.zeros(len(counts), np.int64)
        until[order] = np.cumsum(counts[order])
        need += [int(until[np.array(ls)].min()) for ls in leaves.get(name, [])]
    return int(np.quantile(need, recall, method="higher")) if need else 0
