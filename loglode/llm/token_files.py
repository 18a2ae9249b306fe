"""Operator 9: token ids as Arrow files of fixed-size lists.

Documents are dealt into ranges of ascending doc_id; each range becomes one Arrow file whose record batches hold
`sequences` lists of exactly `length` ids (16 bits where the vocabulary allows, else 32) and as many lists of mask bits
(1: an id of the text, 0: padding at the end of the file).  A list sits at a fixed place, so the ids and packed mask of
any sequence are views of a memory map.  Beside each file lies an index file (doc_id, first, n_tokens).  Files are written under a name of their own and moved in
place, so a task that runs again leaves one whole file.

Null and empty texts give just the end id.  Rows that share a doc_id are written in order of their text; a null
doc_id comes first.  An empty table gives no file and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, written
from .tokens import encoder, tokenizer_path

MANIFEST = "part int, path string, n_docs long, n_tokens long"
INDEX = pa.schema([(name, pa.int64()) for name in ("doc_id", "first", "n_tokens")])
PADDING = 0


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _open(uri: str) -> pa.NativeFile:
    store, path = _store(uri)
    return pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)


class SequenceWriter:
    """Cuts a stream of ids into lists of `length` (a multiple of 8) and writes record batches of `sequences` lists."""

    def __init__(self, sink, length: int, sequences: int, dtype: np.dtype):
        self.length, self.dtype, self.block = length, dtype, length * sequences * dtype.itemsize
        self.kinds = pa.list_(pa.from_numpy_dtype(dtype), length), pa.list_(pa.bool_(), length)
        self.out = pa.ipc.new_file(sink, pa.schema([("ids", self.kinds[0]), ("mask", self.kinds[1])]))
        self.held, self.size = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            data = b"".join(self.held)
            whole = len(data) - len(data) % self.block
            for a in range(0, whole, self.block):
                ids = np.frombuffer(data, self.dtype, self.block // self.dtype.itemsize, a)
                self._put(ids, len(ids))
            self.held, self.size = [data[whole:]], len(data) - whole

    def _put(self, ids: np.ndarray, valid: int) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=k) for x, k in zip((ids, np.arange(len(ids)) < valid), self.kinds)]
        self.out.write_batch(pa.record_batch(arrays, names=["ids", "mask"]))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.full(-(-len(ids) // self.length) * self.length, PADDING, self.dtype)
            padded[: len(ids)] = ids
            self._put(padded, len(ids))
        self.out.close()


class SequenceReader:
    """Sequences and spans of one file, as views of the mapped memory where they lie in one batch."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(_open(uri))
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.at, self.ids, self.bits = -1, None, None

    def _load(self, batch: int) -> None:
        if batch != self.at:
            self.at, b = batch, self.file.get_batch(batch)
            self.ids = b.column("ids").values.to_numpy(zero_copy_only=True)
            self.bits = np.frombuffer(b.column("mask").values.buffers()[1], np.uint8)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sequence i and its packed mask (lowest bit first)."""
        b, row = divmod(i, self.per_batch)
        self._load(b)
        a = row * self.length
        return self.ids[a : a + self.length], self.bits[a // 8 : (a + self.length) // 8]

    def span(self, first: int, n: int) -> Iterator[np.ndarray]:
        step = self.per_batch * self.length
        while n > 0:
            b, a = divmod(first, step)
            self._load(b)
            part = self.ids[a : a + n]
            yield part
            first, n = first + len(part), n - len(part)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2, length: int = 2048, sequences: int = 64, rows_per_file: int = 10_000) -> DataFrame:
    """Write docs (doc_id, text) below folder; return the manifest (part, path, n_docs, n_tokens)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, writer, at, index = TaskContext.get().partitionId(), encoder(path), None, 0, []
        end = np.array([end_id], pieces.dtype)
        store, base = _store(folder)
        own, name = f"{base}/{uuid.uuid4().hex}.tmp", f"part-{part:07d}.arrow"
        for t in batches:
            for a, counts, ids in pieces.encode_all(t["text"]):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(own)
                    writer = SequenceWriter(sink, length, sequences, pieces.dtype)
                first = at + np.cumsum(counts + 1) - counts - 1
                writer.add(np.insert(ids, np.cumsum(counts), end).tobytes())
                index.append(pa.record_batch([t["doc_id"][a : a + len(counts)], pa.array(first), pa.array(counts + 1)], schema=INDEX))
                at += int(counts.sum()) + len(counts)
        if writer is not None:
            writer.close()
            sink.close()
            with store.open_output_stream(f"{own}.index") as f, pa.ipc.new_file(f, INDEX) as out:
                for some in index:
                    out.write_batch(some)
            store.move(f"{own}.index", f"{base}/{name}.index")
            store.move(own, f"{base}/{name}")
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([sum(map(len, index))], pa.int64()), pa.array([at], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    files = max(1, -(-docs.count() // rows_per_file))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranges.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for uri, base in zip(t["path"].to_pylist(), t["base"].to_pylist()):
                ids, index = SequenceReader(uri), pa.ipc.open_file(_open(f"{uri}.index")).read_all()
                crcs = []
                for first, n in zip(index["first"].to_pylist(), index["n_tokens"].to_pylist()):
                    crc = 0
                    for part in ids.span(first, n):
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    crcs.append(crc)
                start = index["first"].to_numpy() + base
                out = pa.table([index["doc_id"], pa.array(start), index["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from out.combine_chunks().to_batches()

    # One row a file: the running sum is over the manifest, never over documents.
    files = manifest.select("part", "path", before.alias("base")).repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, scratch_path(spark, "tokens"), tokenizer_path()))
