"""Shared helpers of the training-data operators: scratch tables and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

NULL_ID = -(1 << 63)


@functools.lru_cache(maxsize=None)
def _own_scratch(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-loglode-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Local mode (tests) may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _own_scratch(spark.sparkContext.applicationId)


_thread = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/loglode-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for named in getattr(_thread, "recording", []):
        named.append(path)
    return path


@contextlib.contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """A list of what scratch_path() names in this thread meanwhile."""
    if not hasattr(_thread, "recording"):
        _thread.recording = []
    _thread.recording.append(named := [])
    try:
        yield named
    finally:
        _thread.recording.pop()


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables; for when the results that read them are written."""
    delete_path(spark, f"{scratch_dir(spark).rstrip('/')}/loglode-{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs one task."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove a scratch table that written() made and nothing reads any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder with one file for each bucket of `key`: tables bucketed alike are joined by it
    without moving their rows."""
    spark = df.sparkSession
    path, files = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "loglode_" + path.rpartition("-")[2]
    df.repartition(files, key).write.option("compression", "zstd").bucketBy(files, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and out knows them
    return out


class Memo(dict):
    """key -> make(key), remembered in two generations of limit/2 keys: what is asked for again outlives what is not."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_held: dict = {}


def memory(key, make: Callable):
    """What Python workers keep between tasks: one thing at a time, so a later stage starts without an earlier one's."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give free memory back to the system; Arrow's pool and the C library would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with at most `most` bytes together; a longer text is a run of its own.  What a run
    leaves free is given back before the next."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        release()
        a = b


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words (runs without ASCII white space) of some texts: where each lies in the joined texts, and whose it is."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = SPACES[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.stop = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.edges = np.concatenate([[0], np.searchsorted(self.start, ends)])  # words of text i: edges[i] to edges[i + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, from its bytes."""
        return span_hashes(BYTE_HASH[self.data], self.start, self.stop, mixed=True)


def word_hashes(texts: list[bytes], most: int = 1 << 18) -> list[np.ndarray]:
    """The hashes of the words of each text, computed over runs of texts of `most` bytes."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < most):
            size += len(texts[b]) + 1
            b += 1
        words = Words(texts[a:b])
        out += np.split(words.hashes(), words.edges[1:-1])
        a = b
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of every run of m symbols, from hashes of the symbols, in O(log m) passes."""
    if len(h) < m:
        return np.empty(0, np.uint64)
    n = len(h) - m + 1
    out, done, part, size, left = None, 0, h, 1, m
    while left:
        if left & 1:
            power = np.uint64(pow(BASE, size, 1 << 64))
            out = part[:n] if out is None else out * power + part[done : done + n]
            done += size
        left >>= 1
        if left:
            part = part[: len(part) - size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
            size *= 2
    return mix(out)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p[:size])
    return out[0], out[1]


def span_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray, mixed: bool = False) -> np.ndarray:
    """Hash of every span h[start:stop], which depends on its symbols only; mixed: h needs no mixing first."""
    power, inverse = _powers(1 << int(len(h)).bit_length())
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h if mixed else mix(h)) * power[: len(h)], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start] ^ (stop - start).astype(np.uint64))
