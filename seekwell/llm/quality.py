"""Quality classifier: supervised subword embeddings.

A text's features are its white-space words (case kept) and the 2- to 4-character n-grams that hold white
space at most at an edge (the word-boundary marks), each hashed to one of ``buckets`` vectors, and for each
word one of two marks with vectors of their own: whether it repeats the word before it.
Vectors are averaged over the text and a softmax layer gives the classes; vectors and layer are learned
together by stochastic gradient descent in numpy.

As the layer is linear in the average, a text's score is the softmax of the average of one number a bucket
(vector times layer), which is what executors get: ``buckets`` floats.  Scoring is one Arrow pass over
whole texts without a shuffle.

Training takes at most ``max_rows`` labelled rows, those with the least MD5 of their id: a bound on the
driver's work, documented here; all else covers all rows.  The driver holds their features compressed.

Cases: a null or empty text has no features and scores the bias alone; labels that are null, or whose
document is missing, aren't learned from; of contradicting labels of one document the largest holds, of
its texts the least;
without labels every score is 0.5; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import CASED, SPACED, bytes_of, map_arrow, words
from .shared import schema_with, ship

_SEGMENT = 1 << 20
MARKS = 2
_T = [np.random.default_rng(977 + i).integers(0, 1 << 32, 256, dtype=np.uint32) for i in range(4)]
_ODD = np.random.default_rng(981).integers(0, 1 << 31, 5, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + mean of weight[feature]))), with a weight for each bucket and mark"""

    weight: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (feature numbers, text's first feature) for words and each n-gram length, of texts in one buffer."""
    mask = np.uint32(buckets - 1)
    n = len(data)
    texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    w = words(texts, SPACED, codes=CASED)
    again = np.full(len(w.hash), buckets, np.uint32)
    again[1:] += w.hash[1:] == w.hash[:-1]
    first = w.bounds[:-1]
    again[first[first < len(again)]] = buckets
    out = [((w.hash >> np.uint64(32)).astype(np.uint32) & mask, w.bounds), (again, w.bounds)]
    code, space, ends = _characters(data, offsets)
    n = len(code)
    h = code
    ok = np.ones(n, bool)  # no white space strictly inside
    for k in (2, 3, 4):
        m = n - k + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x9E3779B1)) ^ (code[k - 1 :] * _ODD[k])
        if k > 2:
            ok = ok[:m] & ~space[k - 2 : k - 2 + m]
        good = ok[:m].copy()
        for back in range(1, k):  # none across texts
            at = ends[1:-1] - back
            good[at[(at >= 0) & (at < m)]] = False
        at = np.flatnonzero(good)
        g = h[at]
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((g >> np.uint32(13)) & mask, np.searchsorted(at, ends)))
    return out


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each character of UTF-8 texts (white space: of the blank), whether it is white space, and each text's first character."""
    space = ~SPACED[data]
    code = _T[0][np.where(space, np.uint8(32), data)]
    inner = (data & np.uint8(0xC0)) == 0x80
    if not inner.any():
        return code, space, offsets
    at = np.flatnonzero(~inner)
    code, n, go = code[at], len(data), np.ones(len(at), bool)
    for j in (1, 2, 3):
        after = np.minimum(at + j, n - 1)
        go = go & (at + j < n) & inner[after]
        code[go] = (code[go] * np.uint32(0x85EBCA6B)) ^ _T[j][data[after[go]]]
    return code, space[at], np.searchsorted(at, offsets)


def _pieces(offsets: np.ndarray, data: np.ndarray):
    """Texts cut at the first white space after each megabyte, and the text of each piece."""
    if len(offsets) < 2 or np.max(np.diff(offsets)) <= 2 * _SEGMENT:
        return offsets, np.arange(len(offsets) - 1)
    cuts, owner = [0], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > 2 * _SEGMENT:
            gap = np.flatnonzero(~SPACED[data[a + _SEGMENT : min(b, a + 2 * _SEGMENT)]])
            a += _SEGMENT + (int(gap[0]) if len(gap) else 0)
            cuts.append(a)
            owner.append(i)
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


def mean_weights(texts, weight: np.ndarray) -> np.ndarray:
    """Average of ``weight`` over each text's features, 0 without any; memory is bounded by some megabytes of text."""
    data, offsets = bytes_of(texts)
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    cuts, owner = _pieces(offsets, data)
    i = 0
    while i < len(owner):
        j = int(np.searchsorted(cuts, cuts[i] + _SEGMENT, "right")) - 1
        j = min(len(owner), max(j, i + 1))
        for f, b in _features(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], len(weight) - MARKS):
            n = np.diff(b)
            full = np.flatnonzero(n)
            if len(full):
                np.add.at(total, owner[i:j][full], np.add.reduceat(weight[f].astype(np.float64), b[:-1][full]))
                np.add.at(count, owner[i:j][full], n[full])
        i = j
    return total / np.maximum(count, 1)


def counted(texts, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares of each text, for training."""
    out = []
    data, offsets = bytes_of(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts, _ = _pieces(np.array([0, b - a]), data[a:b])
        found = [f for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for f, _b in _features(data[a + x : a + y], np.array([0, y - x]), buckets)]
        at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        out.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def packed(at: np.ndarray, share: np.ndarray) -> bytes:
    """One text's features and shares in few bytes: gaps of the sorted numbers, then the shares."""
    return zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + share.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    return np.cumsum(np.frombuffer(raw, np.int32, len(raw) // 8), dtype=np.int32), np.frombuffer(raw, np.float32, offset=len(raw) // 2)


def sgd(examples: list[bytes], labels: np.ndarray, *, buckets: int, dim: int = 12, epochs: int = 6, rate: float = 12.0, seed: int = 1) -> Model:
    """Learn vectors and layer from ``packed`` texts, one unpacked at a time; the two-class softmax is kept as its difference,
    a logistic layer."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets + MARKS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, dim).astype(np.float32), 0.0
    if len(labels) == 0:
        return Model(np.zeros(buckets + MARKS, np.float32), 0.0)
    steps, n = 0, epochs * len(labels)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            ids, share = unpacked(examples[i])
            now = rate * (1 - steps / n)
            steps += 1
            mean = share @ vectors[ids]
            g = np.float32(1 / (1 + np.exp(-np.clip(layer @ mean + bias, -30, 30))) - labels[i])
            if len(ids):
                vectors[ids] -= np.outer(share, (now * g) * layer)
                layer -= np.float32(now * g * 0.25) * mean
            bias -= float(0.02 * now * g)
    return Model(vectors @ layer, bias)


def learnable(key) -> F.Column:
    """Whether labels of this id may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(5)) != 0


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", may_learn=learnable, max_rows: int = 4096, buckets: int = 1 << 18, **options) -> Model:
    """A model from at most ``max_rows`` labelled rows that ``may_learn`` admits."""
    ship(docs.sparkSession)
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & may_learn(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.md5(F.col("k").cast("string")), "k").limit(max_rows)
    # at most max_rows rows of two numbers: small enough to send
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    # one row of an id that repeats, before features are made or collected: the least text, combined before the shuffle
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("id", "y", "text")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = counted(part.column(2), buckets)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([packed(*x) for x in made], pa.binary())], names=schema.names)

    got = sorted(map_arrow(rows, run, schema).collect(), key=lambda r: r["id"])  # at most max_rows rows
    return sgd([r["f"] for r in got], np.array([r["y"] for r in got], np.float32), buckets=buckets, **options)


def score(df: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1, higher: label 1 likelier) of every whole text as column ``out``."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    schema, column = schema_with(df, T.StructField(out, T.DoubleType())), df.columns.index(text)

    def run(batches):
        weight, bias = sent.value
        for batch in batches:
            logit = np.clip(mean_weights(batch.column(column), weight) + bias, -60, 60)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-logit)))], names=schema.names)

    return map_arrow(df, run, schema)
