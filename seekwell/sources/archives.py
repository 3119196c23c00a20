"""Archives and compressed files: every part of every nested archive as a row ``archive{part}``.

gzip, zlib, compress (.Z), bzip2, xz, lzma, zstd, zip, tar (and pax) and cpio are read; lz4, brotli and 7z
where their libraries are installed.  Formats are told by first bytes, not by name, except where a format has
none.  Decoding stops at ``max_part`` bytes a part with an error row rather than exhausting a task.
"""

from __future__ import annotations

import bz2
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import ship, slices

PARTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.StringType()), T.StructField("key", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


class ArchiveError(ValueError):
    pass


def lzw(data: bytes, most: int = 1 << 31) -> bytes:
    """The compress (.Z) format: adaptive LZW of 9 to 16 bits in groups of eight codes."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise ArchiveError("not a .Z file")
    top, block = data[2] & 31, bool(data[2] & 128)
    if not 9 <= top <= 16:
        raise ArchiveError("bad .Z header")
    table = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out, size, old = bytearray(), 9, None
    bits = have = 0
    at, group = 3, 0  # codes read at this width
    while True:
        while have < size and at < len(data):
            bits |= data[at] << have
            have += 8
            at += 1
        if have < size:
            return bytes(out)
        code, bits, have = bits & ((1 << size) - 1), bits >> size, have - size
        group += 1

        def align():
            nonlocal at, bits, have, group
            if left := -group % 8:  # codes come in groups of eight
                skip = left * size - have
                at += max(0, -(-skip // 8))
            bits = have = group = 0

        if block and code == 256:
            align()
            del table[257:]
            size, old = 9, None
            continue
        if old is None:
            if code > 255:
                raise ArchiveError("bad .Z code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = old + old[:1]
            else:
                raise ArchiveError("bad .Z code")
            if len(table) < 1 << top:
                table.append(old + entry[:1])
        out += entry
        if len(out) > most:
            raise ArchiveError(f"more than {most} bytes")
        old = entry
        if len(table) >= 1 << size and size < top:
            align()
            size += 1


def _stream(make, data: bytes, most: int) -> bytes:
    """Concatenated members of a compressed format, to at most ``most`` bytes."""
    out, left = bytearray(), data
    while left:
        d = make()
        try:
            out += d.decompress(left, most + 1 - len(out)) if not isinstance(d, type(zlib.decompressobj())) else d.decompress(left, most + 1 - len(out))
        except Exception as e:
            if out:
                break  # padding after the last member
            raise ArchiveError(str(e)) from e
        if len(out) > most:
            raise ArchiveError(f"more than {most} bytes")
        if not d.eof:
            raise ArchiveError("the file is cut off")
        left = d.unused_data.lstrip(b"\0")
    return bytes(out)


def _zstd(data: bytes, most: int) -> bytes:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
        out = r.read(most + 1)
    if len(out) > most:
        raise ArchiveError(f"more than {most} bytes")
    return out


def _optional(name: str):
    try:
        return __import__(name)
    except ImportError as e:
        raise ArchiveError(f"the {name} library isn't installed") from e


def cpio(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of a cpio archive: new ASCII (with or without checksums), old ASCII, and old binary formats."""
    at = 0
    while at + 6 <= len(data):
        magic = data[at : at + 6]
        if magic in (b"070701", b"070702"):
            f = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
            mode, size, name_size = f[1], f[6], f[11]
            name_at = at + 110
            body = (name_at + name_size + 3) & ~3 if at % 4 == 0 else name_at + name_size + (-(110 + name_size) % 4)
            end = body + size + (-size % 4)
        elif magic == b"070707":
            mode, name_size, size = int(data[at + 18 : at + 24], 8), int(data[at + 59 : at + 65], 8), int(data[at + 65 : at + 76], 8)
            name_at = at + 76
            body = name_at + name_size
            end = body + size
        elif magic[:2] in (b"\xc7\x71", b"\x71\xc7"):
            order = "little" if magic[:2] == b"\xc7\x71" else "big"
            h = [int.from_bytes(data[at + 2 * i : at + 2 * i + 2], order) for i in range(13)]
            mode, name_size, size = h[3], h[10], (h[11] << 16) | h[12]
            name_at = at + 26
            body = name_at + name_size + name_size % 2
            end = body + size + size % 2
        else:
            raise ArchiveError("bad cpio header")
        name = data[name_at : name_at + name_size].rstrip(b"\0").decode("utf-8", "replace")
        if name == "TRAILER!!!":
            return
        if mode & 0o170000 == 0o100000:
            yield name, data[body : body + size]
        at = end


def _is_tar(data: bytes) -> bool:
    if len(data) < 512:
        return False
    try:
        return int(data[148:156].strip(b" \0") or b"0", 8) == sum(data[:148]) + 256 + sum(data[156:512]) and any(data[:100])
    except ValueError:
        return False


def unpacked(data: bytes, name: str = "", most: int = 1 << 30) -> tuple[str, object] | None:
    """('stream', bytes) of a compressed file, ('parts', iterator of (name, bytes)) of an archive, None of neither."""
    if data[:2] == b"\x1f\x8b":
        return "stream", _stream(lambda: zlib.decompressobj(31), data, most)
    if data[:2] == b"\x1f\x9d":
        return "stream", lzw(data, most)
    if data[:3] == b"BZh":
        return "stream", _stream(bz2.BZ2Decompressor, data, most)
    if data[:6] == b"\xfd7zXZ\0" or (name.endswith((".lzma", ".tlz")) and data[:1] == b"\x5d"):
        return "stream", _stream(lzma.LZMADecompressor, data, most)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "stream", _zstd(data, most)
    if data[:4] == b"\x04\x22\x4d\x18":
        return "stream", _optional("lz4.frame").frame.decompress(data)
    if name.endswith(".br"):
        return "stream", _optional("brotli").decompress(data)
    if name.endswith((".zz", ".zlib")) and data[:1] == b"\x78":
        return "stream", _stream(zlib.decompressobj, data, most)
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        def zipped():
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        if info.file_size > most:
                            raise ArchiveError(f"{info.filename} has more than {most} bytes")
                        yield info.filename, z.read(info)
        return "parts", zipped()
    if data[:6] == b"7z\xbc\xaf\x27\x1c":
        py7zr = _optional("py7zr")
        return "parts", ((n, b.read()) for n, b in py7zr.SevenZipFile(io.BytesIO(data)).readall().items())
    if data[:6] in (b"070701", b"070702", b"070707") or data[:2] in (b"\xc7\x71", b"\x71\xc7"):
        return "parts", cpio(data)
    if _is_tar(data):
        def tarred():
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m).read()
        return "parts", tarred()
    return None


def parts_of(data: bytes, name: str, depth: int, most: int) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(part or None, content, error); ``depth`` is how many more archives may be opened within one another."""
    try:
        found = unpacked(data, name, most)
        if found and found[0] == "stream":  # a compressed tar is one archive
            data = found[1]
            inner = unpacked(data, name, most)
            found = inner if inner and inner[0] == "parts" else found
        if not found or found[0] == "stream" or depth < 1:
            yield None, data, None
            return
        for part, content in found[1]:
            if depth > 1:
                for below, c, e in parts_of(content, part, depth - 1, most):
                    yield part if below is None else f"{part}:{below}", c, e
            else:
                nested = unpacked(content, part, most)
                yield part, nested[1] if nested and nested[0] == "stream" else content, None
    except (ArchiveError, zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as e:
        yield None, None, f"{type(e).__name__}: {e}"


def _rows(batches: Iterator[pa.RecordBatch], depth: int, most: int) -> Iterator[tuple]:
    for batch in batches:
        for p, c in zip(batch.column(0), batch.column(1)):
            p = p.as_py()
            for part, out, error in parts_of(c.as_py() or b"", p or "", depth, most):
                yield p, part, p if part is None else f"{p}{{{part}}}", out, error


def packed(docs: DataFrame, pack: Callable[[int, bytes], bytes]) -> DataFrame:
    """Documents as files: path (``f`` and the id) and content, made by ``pack(doc_id, text in UTF-8)`` a few MB at a time."""

    def run(batches):
        pairs = ((i.as_py(), (t.as_py() or "").encode()) for b in batches for i, t in zip(b.column(0), b.column(1)))
        yield from slices(((None if i is None else f"f{i}", pack(int(i or 0), t)) for i, t in pairs), [("path", pa.string()), ("content", pa.binary())])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "path string, content binary")


def expand(files: DataFrame, *, path: str = "path", content: str = "content", depth: int = 1, max_part: int = 1 << 30) -> DataFrame:
    """path, part, key (``path{part}``, nested ones ``outer:inner``), content and error of every file and archive part.

    Files that are neither compressed nor archives pass through with a null part."""
    if not 1 <= depth <= 99:
        raise ValueError("depth must be 1 to 99")

    def run(batches):
        yield from slices(_rows(batches, depth, max_part), [("path", pa.string()), ("part", pa.string()), ("key", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    ship(files.sparkSession)
    return files.select(path, content).mapInArrow(run, PARTS)
