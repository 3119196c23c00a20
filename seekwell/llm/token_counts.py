"""Token counts with the exact output of a ``tokenizers`` file, for texts of any length.

A huge text is encoded in overlapping chunks with offsets.  Two neighbours are spliced at a boundary
that both encodings show inside the overlap and that is proven stable; when the overlap holds none, it
is widened, at last to the whole text.

*Why a boundary is stable.* ``splits_at_spaces`` accepts a tokenizer whose pre-tokenizer keeps only the
matches of a pattern that never matches white space, whose normalisers work on characters (NFC and NFD
never join anything with white space, lower-casing and ``\\s+`` -> one space keep word edges) and whose
added tokens hold no white space and strip none.  Then nothing to the left of a space influences a token
to its right, so encoding both sides apart gives the same tokens.  Other tokenizers are encoded whole.

The same fact lets short texts be counted word by word with a bounded cache of distinct words.

Cases: a null or empty text has 0 bytes and 0 tokens; special strings in a text become special tokens, as
is the library's default; repeated rows and ties are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import map_arrow
from .shared import ship

SPACES = " \n\t\r"
_TO_SPACE = str.maketrans(dict.fromkeys(SPACES, " "))
_KEEPS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_CACHE = 1 << 20
_counters: dict = {}


def splits_at_spaces(config: dict) -> bool:
    """Whether tokens on the two sides of a space are independent (see the module's proof)."""
    def flat(x, key):
        return [] if x is None else [z for y in x[key] for z in flat(y, key)] if x["type"] == "Sequence" else [x]

    for n in flat(config.get("normalizer"), "normalizers"):
        if n["type"] not in ("NFC", "NFD", "Lowercase") and (n["type"], n.get("pattern"), n.get("content")) != ("Replace", {"Regex": "\\s+"}, " "):
            return False
    pre = flat(config.get("pre_tokenizer"), "pretokenizers")
    if not pre or pre[0]["type"] != "Split" or pre[0]["pattern"] != {"Regex": _KEEPS} or pre[0]["behavior"] != "Removed" or not pre[0]["invert"]:
        return False
    if any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in pre[1:]):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in config.get("added_tokens", []))


class TokenCounter:
    """Counts, and ids for tests, of one tokenizer file."""

    def __init__(self, path: str, chunk_chars: int = 1 << 15, overlap_chars: int = 512):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_space = splits_at_spaces(json.load(f))
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.known: dict[str, int] = {}
        self.widened = 0

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.tok.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int] | None:
        """The first proven boundary in both encodings and its token numbers in the left and in the right one; offsets are of ``text``."""
        both, i, j = np.intersect1d(left[:, 0], right[:, 0], return_indices=True)  # the first token at each place
        for p, a, b in zip(both.tolist(), i.tolist(), j.tolist()):
            if p and text[p - 1] in SPACES:
                return p, a, b
        return None

    def spliced(self, text: str) -> np.ndarray:
        """Ids of a huge text from overlapping chunks, equal to those of the whole text."""
        n, out, a = len(text), [], 0
        b = min(n, self.chunk)
        ids, offs = self._encode(text[:b])
        while b < n:
            overlap, found = self.overlap, None
            while found is None:
                start = max(a, b - overlap)
                if start == a:  # the overlap is the whole left chunk: lengthen that chunk instead
                    b = min(n, b + (b - a))
                    ids, offs = self._encode(text[a:b])
                    if b == n:
                        break
                    overlap = self.overlap
                    continue
                end = min(n, start + self.chunk + overlap)
                new_ids, new_offs = self._encode(text[start:end])
                found = self._splice(text, offs + a, new_offs + start)
                if found is None:
                    overlap *= 2
                    self.widened += 1
            if found is None:
                break
            p, i, j = found
            out.append(ids[:i])
            ids, offs = new_ids[j:], new_offs[j:] + (start - p)
            a, b = p, end
        out.append(ids)
        return np.concatenate(out)

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.by_space:
            return [len(e.ids) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        pieces = [None if t is None or len(t) > self.chunk else t.translate(_TO_SPACE).split(" ") if not t.isascii() else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        unknown = {w for p in pieces if p for w in p} - self.known.keys()
        if len(self.known) + len(unknown) > _CACHE:
            self.known.clear()
            unknown = {w for p in pieces if p for w in p}
        if unknown:
            new = list(unknown)
            self.known.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False))))
        known = self.known.__getitem__
        return [0 if t is None else len(self.spliced(t)) if p is None else sum(map(known, p)) for t, p in zip(texts, pieces)]


def counter(path: str, chunk_chars: int, overlap_chars: int) -> TokenCounter:
    """One per worker, file and setting."""
    key = (path, chunk_chars, overlap_chars)
    if key not in _counters:
        _counters[key] = TokenCounter(*key)
    return _counters[key]


def count_tokens(df: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, chunk_chars: int = 1 << 15, overlap_chars: int = 512) -> DataFrame:
    """The ``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text.

    No shuffle: one Arrow pass over the two columns read."""
    ship(df.sparkSession)
    df = df.select(*keep, df[text].alias("\x00text"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        c = counter(tokenizer, chunk_chars, overlap_chars)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                n = np.array(c.counts(texts), np.int64)
                size = np.array([0 if t is None else len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    return map_arrow(df, run, schema)
