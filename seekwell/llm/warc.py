"""WARC archives of Zstandard frames with a dictionary.

*Writing.* Every task writes archives of its rows: first a skippable frame (magic 0x184D2A5D) with a
dictionary trained on a bounded number of the archive's first payloads, then one frame for each record.
A file gets its final name only when whole, and a repeated task writes the same bytes under the same name.
Of records with equal payloads of at least ``least`` bytes the one with the largest key is a response and
the others revisit it; equality is by SHA-256, found by an aggregation that combines before its shuffle.

*Reading.* A task streams an archive: it loads the dictionary from the leading skippable frame, decodes one
frame after another, each exactly one record, and validates version, header syntax, Content-Length against
the block, the trailing blank lines, HTTP length and, for responses, the payload's digest.

Files are opened with ``pyarrow.fs`` from the folder's URI, so the folder must be one that executors share.

Cases: a null payload is empty; a null URL leaves out the target header; characters that can't stand in a
header are percent-encoded; a null key is written and read back as null and never wins over another; rows
that repeat the largest key are responses each; an empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import map_arrow
from .shared import new_folder, sent_if_small, ship, written

MAGIC = 0x184D2A5D
ZSTD = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()),
])


class WarcError(ValueError):
    pass


def _record(kind: str, key, url, digest: str, size: int, payload: bytes, refers, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "") + "%"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The fields of one record; ``WarcError`` if it isn't exactly one valid record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:60]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError("bad Content-Length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} against a block of {len(rest) - 4} bytes")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if length != len(payload):
            raise WarcError(f"HTTP length {length} against a payload of {len(payload)} bytes")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload digest differs")
    elif fields["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in fields or length is None:
            raise WarcError("bad revisit record")
    else:
        raise WarcError(f"unknown record type {fields['warc-type']}")
    return {"fields": fields, "type": fields["warc-type"], "bytes": length, "digest": digest, "payload": payload}


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A trained dictionary, or a plain prefix of the samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ArchiveWriter:
    """One archive; records are kept until the dictionary is trained, then streamed."""

    def __init__(self, path: str, attempt: str, samples: int):
        self.fs, self.path = _filesystem(path)
        self.part, self.samples, self.held = f"{self.path}.{attempt}", samples, []
        self.out, self.records, self.bytes, self.comp = None, 0, 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.comp is None:
            self.held.append(record)
            if len(self.held) >= self.samples:
                self._begin()
        else:
            self._put(self.comp.compress(record))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        raw = dictionary([r[: 1 << 16] for r in self.held])
        packed = zstandard.ZstdCompressor(level=9).compress(raw)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self._put(struct.pack("<II", MAGIC, len(packed)) + packed)
        self.comp = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
        for r in self.held:
            self._put(self.comp.compress(r))
        self.held = []

    def close(self) -> None:
        if self.comp is None:
            self._begin()
        self.out.close()
        self.fs.move(self.part, self.path)


def read_archive(stream, path: str = "", max_record: int = 1 << 31):
    """(offset, record bytes) of an archive from a binary stream with ``read(n)``; one frame is held at a time."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != MAGIC:
        raise WarcError(f"{path}: no leading dictionary frame")
    n = struct.unpack("<I", head[4:])[0]
    raw = stream.read(n)
    if len(raw) != n:
        raise WarcError(f"{path}: the dictionary is cut off")
    if raw[:4] == ZSTD:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    offset, left = 8 + n, b""
    while left or (left := stream.read(1 << 16)):
        one, parts, used, have = d.decompressobj(), [], 0, 0
        while True:
            out = one.decompress(left)
            parts.append(out)
            have += len(out)
            used += len(left)
            if have > max_record:
                raise WarcError(f"{path} at {offset}: record above {max_record} bytes")
            if one.eof:
                left = one.unused_data
                used -= len(left)
                break
            left = stream.read(1 << 16)
            if not left:
                raise WarcError(f"{path} at {offset}: the frame is cut off")
        yield offset, b"".join(parts)
        offset += used


def marked(df: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), sha1, record_type and refers_to of every row."""
    rows = df.select(df[key].cast("long").alias("page_id"), df[url].cast("string").alias("url"), F.coalesce(df[payload].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "same": F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))})
    best = rows.filter(F.col("same").isNotNull()).groupBy("same").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("same").alias("s"), "best")
    # written first: a small table is sent to the tasks, with a large one Spark can split a payload that many pages have
    best = written(best, "payloads")
    rows = rows.join(sent_if_small(best, 1 << 19), F.col("same") == F.col("s"), "left")
    revisit = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, *, samples: int = 200, max_records: int = 20000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write rows of ``marked`` to archives of at most ``max_records`` records each; their manifest (path, records, bytes)."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def run(batches):
        task = TaskContext.get()
        attempt, writer, n = f"tmp{task.taskAttemptId()}", None, 0
        done = []
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for key, url, payload, sha1, kind, refers in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(cols))):
                if writer is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{n:04d}.warc.zst"
                    writer = ArchiveWriter(path, attempt, samples)
                    n += 1
                data = payload.as_buffer().to_pybytes()
                writer.add(_record(kind, key, url, sha1, len(data), data, refers, date))
                if writer.records >= max_records:
                    writer.close()
                    done.append((path, writer.records, writer.bytes))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, writer.records, writer.bytes))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=MANIFEST.names)

    return written(map_arrow(rows, run, MANIFEST), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every record of the manifest's archives; an archive with another number of records than listed is an error."""
    def run(batches):
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = _filesystem(path)
                rows, n = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for offset, data in read_archive(stream, path):
                        r = parse(data)
                        f = r["fields"]
                        rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), r["bytes"], r["digest"], r["type"], _page(f.get("warc-refers-to")), path, offset))
                        n += 1
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if n != count:
                    raise WarcError(f"{path} holds {n} records, not {count}")
                if rows:
                    yield _batch(rows)

    files = manifest.select("path", "records")
    return map_arrow(files.repartition(tasks or max(1, files.count()), "path"), run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=RECORDS.names)


def archive_and_read(df: DataFrame, **options) -> DataFrame:
    """Write a record for each row of ``df`` to the shared folder and read the archives back."""
    spark = df.sparkSession
    ship(spark)
    folder = new_folder(spark, "warc")
    return read_archives(spark, write_archives(marked(df, **options), folder))
