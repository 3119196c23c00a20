"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters.  Of every text the hashes of
``k``-word grams are winnowed: in each window of ``window - k + 1`` consecutive grams the least one (the
rightmost on ties) is kept as a fingerprint.  Two texts that share ``window`` words share such a window of
grams and so keep the same fingerprint in it.  Fingerprints of documents are joined with those of the
benchmark, each hit fixes a diagonal (place in the document less place in the item), and along it the words
are compared: runs of at least ``window`` equal words are hit.  Items of fewer words are one window, which
winnowing can't promise to keep; documents are looked up for them by grams of each such length.

The benchmark is sent to every task only up to ``max_broadcast_bytes`` of text, which is checked; a larger
one is dealt into blocks of about that size at most, documents are passed once per block, one block after
another is sent and destroyed, and word hits and items are united per document.

Cases: null texts have no words; items without words occur nowhere; null item ids take part but carry no
id; repeated item rows count once; repeated documents are rows of their own; empty tables give an empty
result or no hits.  Fingerprints of documents never leave their task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, Words, grams, map_arrow, words
from .shared import free_name, schema_with, ship, written

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the fingerprints of gram hashes ``g``: the rightmost least of every ``w`` consecutive ones."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        better = g[j : j + n] <= least
        np.copyto(least, g[j : j + n], where=better)
        at[better] = np.flatnonzero(better) + j
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if n > 1 else at


class Benchmark:
    """Items as word hashes, fingerprints of the long ones and whole-item grams of the short ones."""

    def __init__(self, ids: list, texts: list, window: int, k: int):
        self.window, self.k = window, k
        w: Words = words(pa.array(texts, pa.large_string()), ALNUM)
        items, places, prints = [], [], []
        self.ids, self.words, self.raw = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        seen = set()
        for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
            if a == b or (ids[i], w.hash[a:b].tobytes()) in seen:
                continue
            seen.add((ids[i], w.hash[a:b].tobytes()))
            me = len(self.ids)
            self.ids.append(ids[i])
            self.words.append(w.hash[a:b])
            if b - a < window:
                self.short.setdefault(b - a, {}).setdefault(int(grams(w.hash[a:b], b - a)[0]), []).append(me)
                continue
            g = grams(w.hash[a:b], k)
            at = winnow(g, window - k + 1)
            items.append(np.full(len(at), me))
            places.append(at)
            prints.append(g[at])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        prints = cat(prints, np.uint64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.item, self.place = prints[order], cat(items, np.int64)[order], cat(places, np.int64)[order]
        self.short_keys = {m: np.array(sorted(d), np.uint64) for m, d in self.short.items()}

    def hits(self, h: np.ndarray, g: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray | None, set[int]]:
        """Hit words of a document of word hashes ``h`` and the items whose windows it holds; ``fp`` are the places
        in ``g`` of those of its fingerprints that the benchmark has."""
        hit, found = None, set()
        done = set()
        for p in fp.tolist():
            lo, hi = np.searchsorted(self.prints, g[p]), np.searchsorted(self.prints, g[p], "right")
            for item, place in zip(self.item[lo:hi].tolist(), self.place[lo:hi].tolist()):
                if (item, p - place) in done:
                    continue
                done.add((item, p - place))
                mine, d = self.words[item], p - place
                a, b = max(0, -d), min(len(mine), len(h) - d)
                same = np.concatenate(([False], mine[a:b] == h[a + d : b + d], [False]))
                edge = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s >= self.window:
                        hit = np.zeros(len(h), bool) if hit is None else hit
                        hit[a + d + s : a + d + e] = True
                        found.add(item)
        for m, keys in self.short_keys.items():
            s = grams(h, m)
            for p in np.flatnonzero(_in(s, keys)).tolist():
                for item in self.short[m][int(s[p])]:
                    if np.array_equal(self.words[item], h[p : p + m]):
                        hit = np.zeros(len(h), bool) if hit is None else hit
                        hit[p : p + m] = True
                        found.add(item)
        return hit, found


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def _batch_hits(w: Words, bench: Benchmark):
    """(number of words, hit words or None, items) of every document of a batch."""
    k, span = bench.k, bench.window - bench.k + 1
    distinct = bench.prints[np.concatenate(([True], bench.prints[1:] != bench.prints[:-1]))] if len(bench.prints) else bench.prints
    bounds = w.bounds
    # grams of the whole batch; those that cross documents never win a window, as documents are winnowed within their bounds
    g = grams(w.hash, k)
    known = np.flatnonzero(_in(g, distinct))
    lo = np.searchsorted(known, bounds[:-1])
    hi = np.searchsorted(known, np.maximum(bounds[1:] - k + 1, bounds[:-1]))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        fp = np.zeros(0, np.int64)
        if hi[i] > lo[i] and b - a >= bench.window:
            mine = g[a : b - k + 1]
            at = winnow(mine, span)
            fp = at[_in(mine[at], distinct)]
        if len(fp) or bench.short:
            yield b - a, *bench.hits(w.hash[a:b], g[a : max(a, b - k + 1)], fp)
        else:
            yield b - a, None, set()


def sha_of(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _blocks(items: DataFrame, limit: int) -> tuple[int, DataFrame]:
    """Number of blocks of at most about ``limit`` bytes each, and the benchmark with a column ``block``."""
    total = items.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("c")).first()
    size = (total["n"] or 0) + 16 * total["c"]
    n = 1 if size <= limit else int(2 * size // limit) + 2
    return n, items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))


def contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, share: int = 20, max_broadcast_bytes: int = 64 << 20, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with n_words, n_hit, n_items, items_sha256 and contaminated (hit words are at least one in ``share``) added.

    One Arrow pass without a shuffle while the benchmark is within ``max_broadcast_bytes``."""
    spark = df.sparkSession
    ship(spark)
    items = benchmark.select(benchmark[item].cast("string").alias("id"), benchmark[item_text].alias("text")).filter(F.col("text").isNotNull()).distinct()
    n_words, n_hit, n_items, sha, bad = (free_name(df, prefix + c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    bits, names = free_name(df, "sw_bits"), free_name(df, "sw_items")
    passed = schema_with(df, T.StructField(bits, T.BinaryType()), T.StructField(names, T.ArrayType(T.StringType())))
    kept = df.columns if keep is None else keep
    places = [df.columns.index(c) for c in kept]
    final = schema_with(df.select(*(df[i] for i in places)), T.StructField(n_words, T.LongType()), T.StructField(n_hit, T.LongType()), T.StructField(n_items, T.LongType()), T.StructField(sha, T.StringType()), T.StructField(bad, T.BooleanType()))
    column, width = df.columns.index(text), len(df.columns)

    def over(broadcast, first: bool, last: bool):
        made: list[Benchmark] = []

        def run(batches):
            if not made:
                made.append(Benchmark(*broadcast.value, window, k))
            bench = made[0]
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows = [(n, hit, {bench.ids[i] for i in found} - {None}) for n, hit, found in _batch_hits(words(part.column(column), ALNUM), bench)]
                    if not first:  # hits of earlier blocks
                        for i, (old, ids) in enumerate(zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist())):
                            n, hit, found = rows[i]
                            if old is not None:
                                was = np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                                hit = was if hit is None else hit | was
                            rows[i] = n, hit, found | set(ids)
                    if not last:
                        yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array([None if h is None else np.packbits(h).tobytes() for _, h, _ in rows], pa.binary()), pa.array([sorted(f) for *_, f in rows], pa.list_(pa.string()))], names=passed.names)
                        continue
                    n = [r[0] for r in rows]
                    hits = [0 if r[1] is None else int(np.count_nonzero(r[1])) for r in rows]
                    yield pa.RecordBatch.from_arrays([
                        *(part.column(i) for i in places), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                        pa.array([sha_of(r[2]) for r in rows], pa.string()), pa.array([h > 0 and share * h >= m for h, m in zip(hits, n)])], names=final.names)

        return run

    n, items = _blocks(items, max_broadcast_bytes)
    out = df
    for j in range(n):  # one block at a time is on the driver and in the tasks
        rows = items.filter(F.col("block") == j).collect()
        sent = spark.sparkContext.broadcast(([r["id"] for r in rows], [r["text"] for r in rows]))
        last = j == n - 1
        out = map_arrow(out, over(sent, j == 0, last), final if last else passed)
        if not last:
            out = written(out, "hits")
            sent.destroy()
    return out
