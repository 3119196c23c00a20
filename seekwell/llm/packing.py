"""Token-ID output: texts become packed rows of token ids of one capacity.

Each task streams its texts, encodes them, ends each with ``eos`` and splits an overlong document into
pieces of one whole row each and a rest (nothing is lost: pieces carry their document and start).  Pieces
of a block of about ``block_tokens`` tokens are packed best fit decreasing; a segment tree over capacities
finds the fullest row that still has room in O(log capacity).  Memory is bounded by a block and the longest
document; there is no shuffle, and a lost task is redone from its own input.

Cases: a null or empty text is one piece holding ``eos`` alone, so that every document is present; ties in
length keep their order of arrival; a null id is kept as null; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import map_arrow
from .shared import ship

EOS = 50256
_encodings: dict = {}

SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("input_ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("piece_starts", T.ArrayType(T.LongType())),
])


def encoding(path: str):
    """The byte-level vocabulary of a ``.tiktoken`` file, one per worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class RoomTree:
    """Rows by the room they have left: a segment tree over 0..capacity that finds the least room of at least ``n``."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, taken out; None if no row has room."""
        i = n + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up, until a sibling to the right has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each row, in the order they were placed."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


def _rows(pieces: list[tuple], capacity: int, pad: int, dtype, shard: int, first: int) -> pa.RecordBatch:
    """pieces: (doc id, start in the document, ids)."""
    bins = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), capacity)
    ids = np.full((len(bins), capacity), pad, dtype)
    pos = np.zeros((len(bins), capacity), dtype)
    steps = np.arange(capacity, dtype=dtype)
    used, cu, docs, starts = [], [], [], []
    for r, members in enumerate(bins):
        at, cum = 0, [0]
        for i in members:
            piece = pieces[i][2]
            ids[r, at : at + len(piece)] = piece
            pos[r, at : at + len(piece)] = steps[: len(piece)]
            at += len(piece)
            cum.append(at)
        pos[r, at:] = steps[: capacity - at]
        used.append(at)
        cu.append(cum)
        docs.append([pieces[i][0] for i in members])
        starts.append([pieces[i][1] for i in members])
    n = len(bins)
    matrix = lambda m: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (capacity * m.itemsize)), pa.py_buffer(m)])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int64)), pa.array(used, pa.int32()), matrix(ids), matrix(pos),
        pa.array(cu, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
    ], names=SCHEMA.names)


def pack(df: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", capacity: int = 2048, eos: int = EOS, block_tokens: int = 1 << 21) -> DataFrame:
    """Packed rows of every whole text: ``input_ids`` and ``position_ids`` are little-endian matrices of ``capacity``
    numbers a row (16 bits where ids fit, else 32; padded with ``eos``), positions start anew at each piece and at the
    padding, ``cu_seqlens`` are cumulative lengths of the pieces, whose documents and starts stand beside them.

    ``(shard, row)`` names a row; shards follow the input's partitions."""
    ship(df.sparkSession)
    df = df.select(df[key].cast("long").alias("k"), df[text].alias("t"))

    def run(batches):
        enc = encoding(vocabulary)
        dtype = np.dtype("<u2") if max(enc.max_token_value, eos, capacity) < 1 << 16 else np.dtype("<u4")
        shard, row, pieces, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode_to_numpy(t.as_py() or "", disallowed_special=()), eos).astype(dtype)
                for a in range(0, len(ids), capacity):
                    piece = ids[a : a + capacity]
                    pieces.append((k, a, piece))
                    held += len(piece)
                    if held >= block_tokens:
                        out = _rows(pieces, capacity, eos, dtype, shard, row)
                        row, pieces, held = row + out.num_rows, [], 0
                        yield out
        if pieces:
            yield _rows(pieces, capacity, eos, dtype, shard, row)

    return map_arrow(df, run, SCHEMA)


def unpack(rows, capacity: int = 2048, eos: int = EOS, dtype="<u2") -> dict:
    """Ids of each document (without ``eos``) from collected rows: the round trip for tests."""
    found: dict = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["input_ids"]), dtype)
        for k, a, b, start in zip(r["doc_ids"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], r["piece_starts"]):
            found.setdefault(k, []).append((start, ids[a:b]))
    out = {}
    for k, parts in found.items():
        whole = np.concatenate([p for _, p in sorted(parts, key=lambda x: x[0])])
        assert whole[-1] == eos
        out[k] = whole[:-1].tolist()
    return out
