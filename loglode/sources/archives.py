"""Lines of archives (tar, tar.gz, tar.bz2, zip, nested) of any size, without unpacking to disk.

`read_archives` lists packages with Spark, plans pieces of them in one set of tasks (runs of zip members, stretches of
plain tars) and reads the pieces in another, straight from the store: no package is ever a cell or held in memory.
Only a packed tar (tar.gz, tar.bz2) has to be read from its start and stays one task.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import posixpath
import re
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "archive_path string, file_path string, depth int, line_no bigint, content string, error string"
PIECES = "path string, kind string, first bigint, last bigint, bytes bigint"
#: A batch ends at so many lines or bytes; a line above MAX_LINE bytes is a fault of its member.
ROWS, BATCH_BYTES, MAX_LINE = 20_000, 16 << 20, 64 << 20
#: Packed bytes of members that make a piece, and the size up to which an inner zip is held in memory.
PIECE_BYTES, HELD = 64 << 20, 32 << 20
#: What damaged, encrypted or oddly packed packages and members raise.
FAULTS = (tarfile.TarError, zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, ValueError)
PACKED_TARS = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2")
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2")


def is_package(name: str) -> bool:
    return name.lower().endswith((*TARS, ".zip"))


def _stem(name: str) -> str:
    low = name.lower()
    for suffix in (".tar.gz", ".tar.bz2", ".tgz", ".tbz2", ".tar", ".zip"):
        if low.endswith(suffix):
            return name[: -len(suffix)]
    return name


def _safe(name: str) -> str | None:
    """A member's path below the root, or None where it would leave it."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return None if clean.startswith(("/", "..")) or clean == "." else clean


class _Blocks(io.RawIOBase):
    """A readable over blocks of bytes."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.rest = blocks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.rest:
            block = next(self.blocks, None)
            if block is None:
                return 0
            self.rest = memoryview(block)
        n = min(len(b), len(self.rest))
        b[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


class _Ahead:
    """Reads forward; what was taken too much can be given back."""

    def __init__(self, stream, rest: bytes = b""):
        self.stream, self.rest = stream, rest

    def upto(self, n: int) -> bytes:
        while len(self.rest) < n:
            more = self.stream.read(max(n - len(self.rest), 1 << 16))
            if not more:
                break
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def exactly(self, n: int) -> bytes:
        out = self.upto(n)
        if len(out) < n:
            raise EOFError("zip ends inside a member")
        return out

    def back(self, data: bytes) -> None:
        self.rest = data + self.rest


def _stored(f: _Ahead, n: int) -> Iterator[bytes]:
    while n > 0:
        data = f.exactly(min(n, 1 << 16))
        n -= len(data)
        yield data


def _inflated(f: _Ahead) -> Iterator[bytes]:
    unpack = zlib.decompressobj(-15)
    while not unpack.eof:
        data = f.upto(1 << 16)
        if not data:
            raise EOFError("zip ends inside a member")
        while data and not unpack.eof:
            yield unpack.decompress(data, 1 << 18)
            data = unpack.unconsumed_tail
    f.back(unpack.unused_data)


def forward_zip(f: _Ahead) -> Iterator[tuple[str, object]]:
    """Members of a zip in one pass from its start, by the headers that stand before them.

    Nothing is sought, so the zip may lie packed inside another package; a few blocks are held at a time.  What such a
    pass cannot tell (encryption, stored members of unknown length) raises ValueError.
    """
    while (mark := f.upto(4)) == b"PK\3\4":
        _, flags, method, _, _, _, packed, size, n_name, n_extra = struct.unpack("<5H3I2H", f.exactly(26))
        name, extra = f.exactly(n_name).decode("utf-8" if flags & 0x800 else "cp437", "replace"), f.exactly(n_extra)
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1 and packed == 0xFFFFFFFF:  # sizes of 64 bits, the packed one last
                packed = struct.unpack("<Q", extra[4 : 4 + n][8:16] if size == 0xFFFFFFFF else extra[4:12])[0]
            extra = extra[4 + n :]
        if flags & 1 or method not in (0, 8) or (method == 0 and flags & 8):
            raise ValueError(f"{name}: cannot be read in one pass")
        body = io.BufferedReader(_Blocks(_stored(f, packed) if method == 0 else _inflated(f)), 1 << 16)
        path = _safe(name)
        if path and not name.endswith("/"):
            yield path, body
        while body.read(1 << 16):
            pass
        if flags & 8:  # a descriptor follows, its mark is optional, its sizes have 4 or 8 bytes
            ahead = f.upto(26)
            at = 4 if ahead[:4] == b"PK\7\x08" else 0
            f.back(ahead[at + (12 if ahead[at + 12 : at + 14] == b"PK" else 20) :])
    if mark[:2] != b"PK":
        raise ValueError("not a zip, or a damaged one")


def members(name: str, stream, which: slice = slice(None)) -> Iterator[tuple[str, object]]:
    """(path, readable) of each regular file of a package; the fault in place of a zip member that cannot be opened.

    which picks entries of a zip's directory.
    """
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(stream) as z:
            for info in z.infolist()[which]:
                path = _safe(info.filename)
                if path and not info.is_dir():
                    try:
                        f = z.open(info)
                    except FAULTS as e:
                        f = e
                    yield path, f
    else:
        with tarfile.open(fileobj=stream, mode="r|*") as t:
            for m in t:
                path = _safe(m.name)
                if path and m.isreg():
                    yield path, t.extractfile(m)


def inner_members(name: str, f) -> Iterator[tuple[str, object]]:
    """members of a package inside a package, whose bytes come in one pass."""
    if not name.lower().endswith(".zip"):
        return members(name, f)
    head = f.read(HELD + 1)
    return members(name, io.BytesIO(head)) if len(head) <= HELD else forward_zip(_Ahead(f, head))


def walk(found: Iterator[tuple[str, object]], at: str, depth: int, max_depth: int) -> Iterator[tuple[str, int, object]]:
    """(path, depth, readable) of all files among members, going into packages inside packages.

    An inner package becomes a folder of its name; members that stand in a folder of that name already are not put
    into it twice.  In place of what cannot be read stands the fault; the walk goes on behind it.
    """
    for path, f in found:
        base = posixpath.basename(path)
        if isinstance(f, Exception):
            yield posixpath.join(at, path), depth, f
        elif is_package(base) and depth < max_depth:
            folder = posixpath.join(at, posixpath.dirname(path), _stem(base))
            try:
                for sub, d, g in walk(inner_members(base, f), "", depth + 1, max_depth):
                    own = sub.removeprefix(_stem(base) + "/")
                    yield posixpath.join(folder, own), d, g
            except FAULTS as e:
                yield posixpath.join(at, path), depth, e
        elif base.lower().endswith(".gz") and not is_package(base):
            yield posixpath.join(at, path[:-3]), depth, gzip.GzipFile(fileobj=f)
        elif base.lower().endswith(".bz2") and not is_package(base):
            yield posixpath.join(at, path[:-4]), depth, bz2.BZ2File(f)
        else:
            yield posixpath.join(at, path), depth, f


def _lines(source: str, path: str, depth: int, f) -> Iterator[tuple]:
    try:
        if isinstance(f, Exception):
            raise f
        no = 0
        while raw := f.readline(MAX_LINE + 1):
            no += 1
            if len(raw) > MAX_LINE:
                raise ValueError(f"line {no} has more than {MAX_LINE} bytes")
            yield source, path, depth, no, raw.rstrip(b"\r\n").decode(errors="replace"), None
    except FAULTS as e:
        yield source, path, depth, None, None, f"{type(e).__name__}: {e}"


def _rows(source: str, found: Callable[[], Iterator[tuple[str, object]]], max_depth: int) -> Iterator[tuple]:
    try:
        for path, depth, f in walk(found(), "", 1, max_depth):
            yield from _lines(source, path, depth, f)
    except FAULTS as e:
        yield from _lines(source, "", 1, e)


def _batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or "")
        if len(held) >= ROWS or size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=names).astype({"line_no": "Int64"})
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype({"line_no": "Int64"})


def explode_archives(files: DataFrame, max_depth: int = 10) -> DataFrame:
    """archive_path, file_path, depth, line_no, content of every line in the packages of a binaryFile table.

    For packages of at most 2 GB (a cell's limit) that lie in a table or in a store that only Spark can read;
    `read_archives` has no such limit.  Packages are dealt one by one over tasks; members stream through.  A member or
    package that cannot be read gives its lines up to the fault and one row with the error, without line_no and
    content; other members follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                yield from _batches(_rows(source, lambda: members(posixpath.basename(source), io.BytesIO(content)), max_depth))  # noqa: B023

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path", "content").repartition(n, "path").mapInPandas(run, SCHEMA)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark spells it, and the path there."""
    scheme, host, rest = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return pyarrow.fs.LocalFileSystem(), rest
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host or ''}/")
    return fs, root.rstrip("/") + rest


class _Raw(io.RawIOBase):
    """A file of a store with the seek errors that zipfile expects."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    seekable = readable

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.file.tell(), self.size)[whence]
        if at < 0:
            raise OSError("seek before the start")
        self.file.seek(at)
        return at

    def readinto(self, b) -> int:
        return self.file.readinto(b)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(path: str) -> io.BufferedReader:
    fs, at = _store(path)
    return io.BufferedReader(_Raw(fs.open_input_file(at)), 1 << 20)


def put(path: str, content: bytes) -> None:
    """Write a file under another name and move it into place, so that a reader never meets half of it."""
    fs, at = _store(path)
    fs.create_dir(posixpath.dirname(at))
    aside = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(aside) as out:
        out.write(content)
    fs.move(aside, at)


def _stretch(f, first: int, last: int) -> io.BufferedReader:
    """Bytes first to last (-1: the end) of a file."""

    def blocks() -> Iterator[bytes]:
        f.seek(first)
        left = last - first if last >= 0 else float("inf")
        while left > 0 and (data := f.read(int(min(left, 1 << 20)))):
            left -= len(data)
            yield data

    return io.BufferedReader(_Blocks(blocks()), 1 << 16)


def plan_pieces(path: str, length: int, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple]:
    """The pieces of one package, reading only a zip's directory or a plain tar's headers.

    ('zip', first, last) are entries of the directory, ('tar', first, last) bytes; what cannot be planned is one
    piece, whose reader meets the fault (if there is one) again.
    """
    low, first, size = path.lower(), 0, 0
    if low.endswith(PACKED_TARS):
        yield path, "tar", 0, -1, length
        return
    try:
        with _open(path) as f:
            if low.endswith(".zip"):
                with zipfile.ZipFile(f) as z:
                    sizes = [i.compress_size for i in z.infolist()]
                for at, n in enumerate(sizes, 1):
                    size += n
                    if size >= piece_bytes or at == len(sizes):
                        yield path, "zip", first, at, size
                        first, size = at, 0
                return
            with tarfile.open(fileobj=f, mode="r:") as t:
                while t.next():
                    t.members.clear()
                    if t.offset - first >= piece_bytes:
                        yield path, "tar", first, t.offset, t.offset - first
                        first = t.offset
    except FAULTS:
        pass
    yield path, "zip" if low.endswith(".zip") else "tar", first, -1, length - first


def _piece_members(path: str, kind: str, first: int, last: int) -> Iterator[tuple[str, object]]:
    with _open(path) as f:
        if kind == "zip":
            yield from members(path, f, slice(first, last if last >= 0 else None))
        elif first == 0 or f.seek(first) >= 0 and f.read(512).strip(b"\0"):  # zeros close a tar
            yield from members(path, _stretch(f, first, last))


def read_archives(spark: SparkSession, path: str, max_depth: int = 10, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of explode_archives for all packages below path, of any size.

    Pieces of about piece_bytes are dealt over tasks, which open the package where it lies (local, HDFS, S3, GCS) and
    hold a batch of lines at most; a lost executor costs the pieces it was reading.  A single member, or a packed tar,
    is one piece.  In stores that only Spark's readers know, packages come as cells of at most 2 GB.
    """
    names = "*.{" + "tar,tar.gz,tgz,tar.bz2,tbz2,zip" + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", "length")  # without its content, a file is not read
    some = listed.agg(F.min("path").alias("path"), F.sum("length").alias("length")).first()
    try:
        _store(some["path"] or "/")
    except (pa.ArrowException, OSError):
        return explode_archives(files, max_depth)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, length in zip(batch["path"], batch["length"]):
                pieces = plan_pieces(source, length, piece_bytes)
                for rows in itertools.batched(pieces, ROWS):
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, kind, first, last in zip(batch["path"], batch["kind"], batch["first"], batch["last"]):
                yield from _batches(_rows(source, lambda: _piece_members(source, kind, first, last), max_depth))  # noqa: B023

    # Pieces are small rows, so their number of tasks is set from the bytes behind them.
    least = spark.sparkContext.defaultParallelism
    tasks = max(least, min(100_000, (some["length"] or 0) // (2 * piece_bytes)))
    pieces = listed.repartition(least, "path").mapInPandas(plan, PIECES)
    return pieces.repartition(tasks, "path", "first").mapInPandas(run, SCHEMA)


def archive_lines(exploded: DataFrame) -> DataFrame:
    """The lines table of exploded packages, without error rows; the archive's id is a hash of its path."""
    return exploded.where("error IS NULL").select(F.substring(F.md5("archive_path"), 1, 12).alias("archive_id"), "file_path", "line_no", "content")
