"""Near duplicates by b-bit MinHash.

1. One Arrow pass gives every text its set of distinct ``shingle``-word shingles, a digest of that set,
   ``bands * rows`` minima, the hash of each band of ``rows`` minima, and the low ``bits`` bits of all
   minima packed into a signature.
2. Rows with equal sets are one class, represented by its least id; only representatives go on.
3. Representatives that share a band hash are candidates.  A band's members are compared with its least
   member (the pivot) alone.  A candidate's similarity is first estimated from the packed signatures (equal
   groups of bits, counted by population count, corrected for the 2**-bits chance of equal bits); pairs whose
   estimate is hopelessly low are let go, all others are confirmed on full sets.
4. Links give components.  Bands whose members lie in several components are open: within each, every two members
   of different components are compared by signature alone, in blocks of bounded rows, and those that aren't
   hopeless are chained (a chain is at most as long as the band).  What hangs together by such chains is a cluster;
   in it every two documents of different components are compared, by signature and unless hopeless on full sets,
   in pairs of blocks of bounded rows and bytes.  A large component has blocks of its own, which are not compared
   with one another.  So every pair of a band is compared, hopeless by signature or known to be in one component,
   and no group is expanded into all its pairs.

With 40 bands of 5 rows a pair at similarity 0.8 is missed with probability 1.3e-7, and the estimate's
threshold (0.65) lies 5 standard deviations below it.

Hot pivots are salted, full sets are joined only for candidates, and every table that is read again is
written to the shared folder.

Cases: texts without words have no shingles, component of their own and are linked with nothing; texts of
fewer words than a shingle are one shingle; null ids get the component of an equal set that has an id, else
null; rows that share an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, forest, joined
from .kernels import SPACED, common, map_arrow, mix, release, shingle_set, words
from .shared import discard, group_of_row, sent_if_small, ship, written

BANDS, ROWS, BITS = 40, 5, 4
LOW = 0.65
_rng = np.random.default_rng(8)
_A = _rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_ODD = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)

SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
])


def minima(s: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set of shingles; 512 shingles at a time."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * _A + _B).min(0), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    return mix((mix(low).reshape(BANDS, ROWS) * _ODD).sum(1, dtype=np.uint64) + _SALT).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS (4) bits of each minimum, two to a byte, as 64-bit words."""
    nibbles = (mix(low) & np.uint64(15)).astype(np.uint8)
    b = nibbles[0::2] | (nibbles[1::2] << np.uint8(4))
    return np.concatenate([b, np.zeros(-len(b) % 8, np.uint8)]).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: differing groups by population count, corrected for chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1)
    chance = 2.0**-BITS
    return ((1 - differ / len(_A)) - chance) / (1 - chance)


def sign(df: DataFrame, *, key: str, text: str, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                w = words(part.column(1), SPACED)
                n, digest, bands, sigs = [], [], [], []
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                    s = shingle_set(w.hash[a:b], shingle)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None)
                        sigs.append(None)
                        bands.append(np.zeros(0, np.int64))
                        continue
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = minima(s)
                    bands.append(band_hashes(low))
                    sigs.append(packed(low).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bands]))), pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(sigs, pa.binary())], names=SIGNED.names)

    return map_arrow(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")), run, SIGNED)


SETS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("members", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """(doc, text) -> full sets with signatures."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w = words(part.column(1), SPACED)
                s = [shingle_set(w.hash[a:b], shingle) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([packed(minima(x)).tobytes() for x in s], pa.binary())], names=SETS.names)

    return map_arrow(df, run, SETS)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, per_salt: int = 256) -> DataFrame:
    """Those of ``pairs`` (doc, pivot) whose full sets have ``100 * intersection >= percent * union``, as (a, b).

    A pivot's set goes once to each salt of its members; rows stream sorted, so one set of a pivot is held."""
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / per_salt).alias("salts"))
    members = pairs.join(salts, "pivot").withColumn("salt", group_of_row("doc", F.col("salts"))).join(sets, "doc").select("pivot", "salt", F.lit(1).alias("kind"), "doc", "members", "sig")
    heads = salts.select("pivot", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")).join(sets.withColumnRenamed("doc", "pivot"), "pivot").select("pivot", "salt", F.lit(0).alias("kind"), F.col("pivot").alias("doc"), "members", "sig")
    rows = heads.union(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")

    def run(batches):
        head = own = sig = None
        for batch in batches:
            a, b = [], []
            for pivot, kind, doc, m, g in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                s, g = np.frombuffer(m.as_buffer(), np.uint64), np.frombuffer(g.as_buffer(), np.uint64)
                if kind == 0:
                    head, own, sig = pivot, s.copy(), g.copy()
                    continue
                if head != pivot or 100 * min(len(s), len(own)) < percent * max(len(s), len(own)) or estimate(g, sig) < LOW:
                    continue
                n = common(s, own)
                if 100 * n >= percent * (len(s) + len(own) - n):
                    a.append(doc)
                    b.append(pivot)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=LINKS.names)

    return map_arrow(rows, run, LINKS)


class _Forest:
    """Which components of a task's documents its own links have joined."""

    def __init__(self, comp: np.ndarray):
        names, self.of = np.unique(comp, return_inverse=True)
        self.up = np.arange(len(names))

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return self.up[self.of]
            self.up = up

    def join(self, i: int, j: int) -> None:
        r = self.roots()
        self.up[max(r[i], r[j])] = min(r[i], r[j])


def _cross(sets: list[np.ndarray], sigs: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between documents of ``left`` and ``right`` (numbers) that join components not yet joined; every pair of
    different components is compared, by signature and, unless hopeless, on full sets."""
    joined, out = _Forest(comp), []
    sizes = np.array([len(s) for s in sets])
    starts = values = owner = None
    for i in left.tolist():
        roots = joined.roots()
        js = right[roots[right] != roots[i]]
        js = js[(100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))]
        js = js[estimate(sigs[js], sigs[i]) >= LOW] if len(js) else js
        if len(js) > 24:  # count in one go by the shingles' lists of documents
            if values is None:
                shingles = np.concatenate([sets[j] for j in right.tolist()])
                docs = np.repeat(np.arange(len(right)), sizes[right])
                order = np.argsort(shingles, kind="stable")
                owner = docs[order]
                values, starts = np.unique(shingles[order], return_index=True)
                starts = np.append(starts, len(owner))
                place = np.full(len(sets), -1)
                place[right] = np.arange(len(right))
            at = np.searchsorted(values, sets[i])
            at[at == len(values)] = 0
            at = at[values[at] == sets[i]]
            n = np.zeros(len(right), np.int64)
            for x, y in zip(starts[at].tolist(), starts[at + 1].tolist()):
                n[owner[x:y]] += 1
            n = n[place[js]]
        else:
            n = np.array([common(sets[j], sets[i]) for j in js.tolist()], np.int64)
        for j in js[100 * n >= percent * (sizes[js] + sizes[i] - n)].tolist():
            if roots[j] != roots[i]:
                out.append((i, j))
                joined.join(i, j)
                roots = joined.roots()
    return out


def chained(key: np.ndarray, block: np.ndarray, comp: np.ndarray, size: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """For rows sorted by ``key`` the least row each hangs together with, by pairs of equal key, different blocks (unless -1) and
    different components whose estimated similarity isn't hopeless."""
    lab, x, y = np.arange(len(key)), [], []
    for s in range(1, len(key)):
        i = np.flatnonzero(key[s:] == key[:-s])
        if not len(i):
            break
        j = i + s
        good = (comp[i] != comp[j]) & ((block[i] != block[j]) | (block[i] < 0)) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[good], j[good]
        for at in range(0, len(i), 1 << 16):
            near = estimate(sig[i[at : at + (1 << 16)]], sig[j[at : at + (1 << 16)]]) >= LOW
            x.append(i[at : at + (1 << 16)][near])
            y.append(j[at : at + (1 << 16)][near])
        if sum(map(len, x)) > 1 << 20 or s == len(key) - 1:
            lab, x, y = _least(lab, x, y), [], []
    return _least(lab, x, y)


def _least(lab: np.ndarray, x: list, y: list) -> np.ndarray:
    if not x:
        return lab
    i, j = np.concatenate(x), np.concatenate(y)
    while True:
        low = np.minimum(lab[i], lab[j])
        now = lab.copy()
        for at in (lab[i], lab[j], i, j):
            np.minimum.at(now, at, low)
        now = now[now]
        if np.array_equal(now, lab):
            return lab
        lab = now


def _screened(open_bands: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Chains (a, b) of documents of different components that share an open band and aren't hopeless by signature.

    A band of more than ``block_rows`` members is dealt into blocks; each pair of blocks is a group of its own, but for those of
    the pivot's component, whose blocks are compared with the other components' only."""
    own = F.col("comp") == F.col("pcomp")
    n = open_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(own, 1)).alias("same"))
    blocks = lambda of: F.ceil(2 * of / block_rows).cast("int")
    large = written(n.filter(F.col("n") > block_rows).select("band", blocks(F.col("n") - F.col("same")).alias("mixed"), blocks(F.col("same")).alias("pure")), "large")
    rows = open_bands.join(sent_if_small(large), "band", "left")
    mine = F.when(own, F.col("mixed") + group_of_row("doc", F.col("pure")).cast("int")).otherwise(group_of_row("doc", F.col("mixed")).cast("int"))
    rows = rows.withColumn("block", F.coalesce(mine, F.lit(-1)))
    others = F.when(F.col("block") < 0, F.array(F.lit(-1))).when(own, F.sequence(F.lit(0), F.col("mixed") - 1)).otherwise(F.sequence(F.lit(0), F.col("mixed") + F.col("pure") - 1))
    rows = rows.withColumn("other", F.explode(others)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    sigs = sets.select("doc", "sig", F.floor(F.octet_length("members") / 8).alias("size"))
    rows = rows.select("band", "lo", "hi", "block", "doc", "comp").join(sigs, "doc").select("band", "lo", "hi", F.when(F.col("lo") == F.col("hi"), F.lit(-1)).otherwise(F.col("block")).alias("block"), "doc", "comp", "size", "sig")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")

    def run(batches):
        def found(t: pa.Table) -> pa.RecordBatch:
            band, lo, hi, block, doc, comp, size = (t.column(i).to_numpy() for i in range(7))
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(doc), -1)
            key = np.cumsum(np.concatenate(([0], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
            least = chained(key, block, comp, size, sig, percent)
            moved = np.flatnonzero(least != np.arange(len(least)))
            return pa.RecordBatch.from_arrays([pa.array(doc[moved]), pa.array(doc[least[moved]])], names=LINKS.names)

        held = None
        for batch in batches:  # the last group of a batch waits for its rest
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            keys = [t.column(i).to_numpy() for i in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = t.slice(cut)
            if cut:
                yield found(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield found(held)

    out = written(map_arrow(rows, run, LINKS).distinct(), "chains")
    discard(large)
    return out


def _settle(chains: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block_bytes: int, block_rows: int) -> DataFrame:
    """Links (a, b) that join components within clusters of documents connected by ``chains``.

    A cluster's documents are dealt into blocks of about ``block_bytes`` of sets and half of ``block_rows`` documents; a large
    component has blocks of its own, small ones share.  Each pair of blocks is one group, unless both are of one component."""
    clusters = components(chains)
    rows = clusters.select(F.col("node").alias("doc"), F.col("comp").alias("cluster")).join(labels, F.col("doc") == F.col("node"), "left").select("doc", "cluster", F.coalesce("comp", "doc").alias("own"))
    rows = rows.join(sets, "doc").withColumn("bytes", F.greatest(F.octet_length("members"), F.lit(2 * block_bytes // block_rows)))
    rows = written(rows, "settle")
    by = rows.groupBy("cluster", "own").agg(F.sum("bytes").alias("n"))
    by = by.withColumn("pure", F.col("n") * 2 > block_bytes)
    pool = by.groupBy("cluster").agg(F.ceil(F.coalesce(F.sum(F.when(~F.col("pure"), F.col("n"))), F.lit(0)) / block_bytes).alias("pool"))
    by = by.join(pool, "cluster").select("cluster", "own", "pure", F.ceil(F.col("n") / block_bytes).alias("blocks"), F.greatest(F.col("pool"), F.lit(1)).alias("pool"))
    block = F.when(F.col("pure"), F.concat_ws("/", F.lit("p"), F.col("own").cast("string"), group_of_row("doc", F.col("blocks")).cast("string"))).otherwise(F.concat(F.lit("s/"), group_of_row("own", F.col("pool")).cast("string")))
    dealt = rows.join(by, ["cluster", "own"]).withColumn("block", block).select("cluster", "block", F.when(F.col("pure"), F.col("own")).alias("only"), "doc", "own", "members", "sig")
    blocks = dealt.select("cluster", "block", "only").distinct()
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.cluster = y.cluster and x.block <= y.block and not (x.only <=> y.only and x.only is not null)"))
    pairs = pairs.select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("lo"), F.col("y.block").alias("hi"))
    sides = pairs.select("cluster", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    groups = sides.join(dealt, ["cluster", "block"]).select("cluster", "lo", "hi", "block", "doc", "own", "members", "sig")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["members"]]
        sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(len(sets_), -1)
        block_of, lo, hi = np.array(t["block"].to_pylist()), t["lo"][0].as_py(), t["hi"][0].as_py()
        docs = t["doc"].to_numpy()
        found = _cross(sets_, sigs, t["own"].to_numpy(), np.flatnonzero(block_of == lo), np.flatnonzero(block_of == hi), percent)
        release()
        return pa.table({"a": pa.array([docs[i] for i, _ in found], pa.int64()), "b": pa.array([docs[j] for _, j in found], pa.int64())})

    out = written(groups.groupBy("cluster", "lo", "hi").applyInArrow(run, LINKS), "settled")
    discard(rows, clusters)
    return out


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (band, doc, comp, pivot, pcomp) of the bands that lie in several components; the pivot is the band's least member."""
    now = members.join(labels, F.col("doc") == F.col("node"), "left").select("band", "doc", F.coalesce("comp", "doc").alias("comp"))
    heads = now.groupBy("band").agg(F.min("doc").alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band", "pivot")
    pcomp = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    # written first, so that Spark can split the bands' rows in the join that follows
    heads = written(heads.join(pcomp, F.col("pivot") == F.col("n"), "left").select("band", "pivot", F.coalesce("c", "pivot").alias("pcomp")), "heads")
    out = written(now.join(heads, "band"), "open")
    discard(heads)
    return out


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, block_bytes: int = 8 << 20, block_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``kept`` marks the least id of each component."""
    ship(df.sparkSession)
    signed = written(sign(df, key=key, text=text, shingle=shingle), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(classes.filter(F.col("rep").isNotNull()), "classes")
    # of rows that share the least id of a class any gives the same minima
    hashed = signed.select(F.col("digest").alias("d"), "doc_id", "bands").join(reps, (F.col("d") == F.col("digest")) & (F.col("doc_id") == F.col("rep")))
    hashed = hashed.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("band"))
    pivots = written(hashed.groupBy("band").agg(F.min("doc").alias("pivot"), F.max("doc").alias("other")).filter("pivot < other").select("band", "pivot"), "pivots")
    members = written(hashed.join(pivots, "band").distinct(), "members")
    discard(pivots)

    labels, done = None, [members]
    if not members.isEmpty():
        involved = written(members.select("doc").distinct(), "involved")
        texts = df.select(df[key].cast("long").alias("doc"), df[text].alias("text")).join(sent_if_small(involved), "doc", "left_semi")
        sets = written(_sets(texts, shingle), "sets")
        tested = written(members.groupBy("doc").agg(F.min("pivot").alias("pivot")).filter("doc <> pivot"), "pairs")
        links = written(confirm(tested, sets, percent), "confirmed")
        labels = forest(links.select(F.col("a").alias("node"), F.col("b").alias("parent")))
        done += [involved, sets, tested, links]
        now = _still_open(members.select("band", "doc"), labels)
        done.append(now)
        if not now.isEmpty():
            chains = _screened(now, sets, percent, block_rows)
            done.append(chains)
            new = _settle(chains, labels, sets, percent, block_bytes, block_rows)
            done.append(new)
            if not new.isEmpty():
                done.append(labels)
                labels = joined(labels, new)

    places = reps.select("digest", F.col("rep").alias("comp"))
    if labels is not None:
        places = written(reps.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("comp", "rep").alias("comp")), "places")
        done += [labels, reps]
    discard(*done)
    out = signed.select("doc_id", "n_shingles", F.col("digest").alias("d")).join(places, F.col("d") == F.col("digest"), "left")
    component = F.coalesce("comp", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    out._seekwell_tables = [signed, places]
    return out
