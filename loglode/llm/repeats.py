"""Where do windows of k symbols repeat across a corpus?  Shared by the two substring deduplications.

Every window is filed under its smallest m-gram hash (its anchor), so equal windows meet under one anchor and
nothing has to be compared with everything.  Neighbouring windows with one anchor form a segment.

1. Anchors that occur twice or more are found with one exchange of packed hashes (batch of documents x hash bucket).
2. Segments under such anchors are listed by position and content hash; equal segments collapse to one with its
   first position and its number of copies, combined before the shuffle.
3. Each distinct segment is fetched once and goes to the index of its shard (FM-index or growing BWT).
4. An anchor with more than `group_limit` distinct segments would load one shard with a group that grows with the
   corpus.  Its windows are filed anew under longer grams, which spreads them over more anchors, and go through the
   same index.  The last grams are as long as windows, so there every distinct window is an anchor of its own.

Rows are known by (batch, ord): batch is a hash of doc_id, ord the rank by (doc_id, text) in the batch, so rows that
share an id are documents of their own, in order of their text.  A null doc_id counts as lower than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, NULL_ID, delete, gram_hashes, release, scratch_path, span_hashes, word_hashes, written

CHUNK = 1 << 18


@dataclass(frozen=True)
class Unit:
    """What a symbol is: a word (runs without ASCII white space) or a byte."""

    words: bool
    window: int
    gram: int

    def parts(self, data: bytes):
        return data.split() if self.words else data

    def hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        """The symbols' hashes of each text."""
        return word_hashes(texts) if self.words else [BYTE_HASH[np.frombuffer(x, np.uint8)] for x in texts]

    def grams(self) -> Iterator[Unit]:
        """The same windows under longer and longer grams."""
        yield self
        for gram in sorted({(self.gram + self.window) // 2, self.window} - {self.gram}):
            yield replace(self, gram=gram)


def batched(docs: DataFrame, rows_per_batch: int) -> tuple[DataFrame, int]:
    """(doc_id, text, batch) bucketed by batch in the shared folder, so that each later pass reads it without a shuffle."""
    spark = docs.sparkSession
    n = max(1, -(-docs.count() // rows_per_batch))
    files = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path = scratch_path(spark, "batches")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(files, "batch")
    table = "loglode_" + path.rpartition("-")[2]
    out.write.option("compression", "zstd").bucketBy(files, "batch").sortBy("batch").option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and rows knows them
    return rows, n


def ordered(table: pa.Table) -> tuple[list, list]:
    """doc ids and texts (as UTF-8, null as empty) of a batch, in (doc_id, text) order."""
    release()
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()), key=lambda r: (NULL_ID if r[0] is None else r[0], r[1] or b"", r[1] is not None))
    return [r[0] for r in rows], [r[1] or b"" for r in rows]


def runs(unit: Unit, hashes: list[np.ndarray], content: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(document index, first window, number of windows, anchor, content hash) of every segment, in chunks of documents."""
    k, m = unit.window, unit.gram
    pieces = [(d, a, h[a : a + CHUNK + k - 1]) for d, h in enumerate(hashes) for a in range(0, max(1, len(h) - k + 1), CHUNK) if len(h) >= k]
    while pieces:
        size, take = 0, 0
        while take < len(pieces) and (not take or size + len(pieces[take][2]) <= CHUNK):
            size += len(pieces[take][2])
            take += 1
        yield _runs(k, m, pieces[:take], content)
        pieces = pieces[take:]
    release()


def _runs(k: int, m: int, pieces: list, content: bool) -> tuple[np.ndarray, ...]:
    h = pieces[0][2] if len(pieces) == 1 else np.concatenate([p[2] for p in pieces])
    g = gram_hashes(h, m)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)  # leftmost of the smallest
    size, w = 1, k - m + 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(h) - k + 1
    low = np.minimum(low[:n], low[w - size : w - size + n])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.array([len(p[2]) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    piece = np.repeat(np.arange(len(pieces)), lengths)[:n]
    valid = np.arange(n) <= (begin + lengths - k)[piece]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    new |= ~valid
    first = np.flatnonzero(new)
    size_of = np.diff(np.append(first, n))
    ok = valid[first]
    first, size_of = first[ok], size_of[ok]
    p = piece[first]
    doc = np.array([x[0] for x in pieces])[p]
    offset = np.array([x[1] for x in pieces])[p]
    c1 = span_hashes(h, first, first + size_of + k - 1) if content else None
    return doc, first - begin[p] + offset, size_of, g[at[first]], c1


def _dealt(batch: int, hashes: np.ndarray, buckets: int, record: np.ndarray | None = None) -> list[tuple]:
    """Rows (bucket, batch, payload) of hashes (or of records, which have one hash each)."""
    b = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, data = b[order], (hashes if record is None else record)[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    return [(int(b[i]), batch, data[i:j].tobytes()) for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))) if j > i]


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


PACKED = "bucket int, batch int, payload binary"
PACKED_ARROW = (["bucket", "batch", "payload"], [pa.int32(), pa.int32(), pa.binary()])


def repeated_anchors(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(batch, payload): the anchors of the batch that occur twice or more in the corpus, packed."""

    def emit(table: pa.Table) -> pa.Table:
        hashes = unit.hashes([t or b"" for t in table["text"].cast(pa.binary()).to_pylist()])
        keys = [r[3] for r in runs(unit, hashes)]
        if not keys:
            return _table([], *PACKED_ARROW)
        u, c = np.unique(np.concatenate(keys), return_counts=True)
        return _table(_dealt(table["batch"][0].as_py(), np.concatenate([u, u[c > 1]]), buckets), *PACKED_ARROW)

    def find(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["payload"].to_pylist()]
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        again = u[c > 1]
        rows = []
        for batch, p in zip(table["batch"].to_pylist(), parts):
            mine = np.unique(p)
            at = np.searchsorted(again, mine)
            hit = mine[(at < len(again)) & (again[np.minimum(at, len(again) - 1)] == mine)] if len(again) else mine[:0]
            if len(hit):
                rows.append((batch, hit.tobytes()))
        return _table(rows, ["batch", "payload"], [pa.int32(), pa.binary()])

    return docs.groupBy("batch").applyInArrow(emit, PACKED).groupBy("bucket").applyInArrow(find, "batch int, payload binary")


SEGMENT = "batch int, ord int, doc_id long, start long, n_win int, anchor long, c1 long"


def segments(docs: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """Every segment under a repeated anchor, by position; anchor and c1 together are its 128-bit content hash."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            again = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in right["payload"].to_pylist()]))
            ids, texts = ordered(left)
            ids = np.array([NULL_ID if i is None else i for i in ids])
            batch, hashes = left["batch"][0].as_py(), unit.hashes(texts)
            for doc, start, n_win, anchor, c1 in runs(unit, hashes, content=True):
                at = np.minimum(np.searchsorted(again, anchor), len(again) - 1)
                i = np.flatnonzero(again[at] == anchor)
                parts.append((np.full(len(i), batch), doc[i], ids[doc[i]], start[i], n_win[i], anchor[i].view(np.int64), c1[i].view(np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(emit, SEGMENT)


def longer_anchors(docs: DataFrame, segs: DataFrame, unit: Unit) -> DataFrame:
    """The windows of segs as segments under the grams of unit."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            _, texts = ordered(left)
            mine = sorted(set(right["ord"].to_pylist()))
            made = dict(zip(mine, unit.hashes([texts[o] for o in mine])))
            o, s, n, i = (right[c].to_numpy() for c in ("ord", "start", "n_win", "doc_id"))
            cut = [made[a][b : b + c + unit.window - 1] for a, b, c in zip(o.tolist(), s.tolist(), n.tolist())]
            for at, start, n_win, anchor, c1 in runs(unit, cut, content=True):
                parts.append((np.full(len(at), left["batch"][0].as_py()), o[at], i[at], s[at] + start, n_win, anchor.view(np.int64), c1.view(np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.groupBy("batch").cogroup(segs.groupBy("batch")).applyInArrow(emit, SEGMENT)


def distinct_segments(segs: DataFrame) -> DataFrame:
    """One row per distinct segment: its first place, its copies, and how many distinct segments its anchor has."""
    first = F.min(F.struct("doc_id", "ord", "start", "batch", "n_win")).alias("first")
    each = written(segs.groupBy("anchor", "c1").agg(F.count(F.lit(1)).alias("copies"), first), "each")
    per = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct_n"), F.max("copies").alias("most"))
    # Both sides of the join are tables, so Spark can split an anchor with very many segments over tasks.
    per = written(per.where("distinct_n > 1 or most > 1").drop("most"), "anchors")
    out = written(each.join(per, "anchor").select("anchor", "c1", "copies", "distinct_n", "first.*"), "distinct")
    delete(each)
    delete(per)
    return out


def with_content(docs: DataFrame, picked: DataFrame, unit: Unit) -> DataFrame:
    """picked, each row with the content of its first place: 8 bytes a word (its hash), or the bytes themselves."""
    schema = picked.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", content binary"

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if right.num_rows:
            texts = ordered(left)[1]
            mine = sorted(set(right["ord"].to_pylist()))
            some = [texts[o] for o in mine]
            seen = dict(zip(mine, unit.hashes(some) if unit.words else some))
            for o, s, n in zip(right["ord"].to_pylist(), right["start"].to_pylist(), right["n_win"].to_pylist()):
                x = seen[o][s : s + n + unit.window - 1]
                rows.append(x.tobytes() if unit.words else x)
        return right.append_column("content", pa.array(rows, pa.binary()))

    return docs.groupBy("batch").cogroup(picked.groupBy("batch")).applyInArrow(emit, schema)


FLAGS = "batch int, payload binary"
FLAG = np.dtype([("ord", "<i4"), ("start", "<i8"), ("n", "<i4")])


@dataclass
class Found:
    docs: DataFrame  # doc_id, text, batch
    flags: DataFrame  # batch, payload: packed FLAG records of repeated windows


def repeated_windows(docs: DataFrame, unit: Unit, index: Callable, index_schema: str, whole: Callable, read: Callable, lone: bool, rows_per_batch: int = 1500, group_limit: int = 8192, shard_rows: int = 8000) -> Found:
    """Flag every repeated window.

    index(unit) -> function from the table of a shard's distinct segments (with content) to (anchor, c1, payload);
    whole(distinct) -> (anchor, c1, payload) answers distinct segments that need no index, or None;
    read(payloads, rows, ord, doc_id, start) -> which windows are flagged, for every window of all occurrences (rows: whose it is);
    lone: does a segment that is alone under its anchor, but has copies, go through the index as well?
    """
    docs_b, n = batched(docs, rows_per_batch)
    segs = written(segments(docs_b, repeated_anchors(docs_b, unit, max(1, n // 8)), unit), "segments")
    spots = None
    for u in unit.grams():
        distinct = distinct_segments(segs)
        last = u.gram == u.window
        cold = distinct if last else distinct.where(F.col("distinct_n") <= group_limit)
        pick = cold if lone else cold.where("distinct_n > 1")
        shards = max(1, -(-pick.count() // shard_rows))
        held = with_content(docs_b, pick, u).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        answers = held.groupBy("shard").applyInArrow(index(u), index_schema)
        if not lone:
            answers = answers.unionByName(whole(cold.where("copies > 1")))
        found = segs.join(answers, ["anchor", "c1"]).select("batch", "ord", "doc_id", "start", "n_win", "payload")
        spots = found if spots is None else spots.unionByName(found)
        if last:
            break
        hot = written(distinct.where(F.col("distinct_n") > group_limit).select("anchor").distinct(), "hot")
        if hot.isEmpty():
            break
        following = next(x for x in unit.grams() if x.gram > u.gram)
        segs = written(longer_anchors(docs_b, segs.join(hot, "anchor", "left_semi"), following), "segments")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t["n_win"].to_numpy()
            rows = np.repeat(np.arange(len(n)), n)
            begin = np.concatenate([[0], np.cumsum(n)])
            own = {c: t[c].to_numpy()[rows] for c in ("ord", "doc_id", "start")}
            own["start"] = own["start"] + np.arange(len(rows)) - begin[rows]
            hit = read(t["payload"], rows, **own)
            first = hit.copy()
            first[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
            last = hit.copy()
            last[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            f = np.zeros(len(a), FLAG)
            f["ord"], f["start"], f["n"] = own["ord"][a], own["start"][a], b - a + 1
            batch = t["batch"].to_numpy()[rows[a]]
            order = np.argsort(batch, kind="stable")
            f, batch = f[order], batch[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(batch)) + 1, [len(batch)]])
            out = [(int(batch[x]), f[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:]) if y > x]
            yield from _table(out, ["batch", "payload"], [pa.int32(), pa.binary()]).to_batches()

    return Found(docs_b, spots.mapInArrow(pack, FLAGS))


def covered(found: Found, unit: Unit, out: Callable, schema: str) -> DataFrame:
    """out(ids, texts, flags) -> table, once per batch; flags[i] are the runs of flagged windows of document i."""

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = ordered(left)
        flags = np.concatenate([np.frombuffer(x, FLAG) for x in right["payload"].to_pylist()]) if right.num_rows else np.zeros(0, FLAG)
        flags = flags[np.argsort(flags["ord"], kind="stable")]
        edges = np.searchsorted(flags["ord"], np.arange(len(ids) + 1))
        return out(ids, texts, [flags[a:b] for a, b in zip(edges[:-1], edges[1:])])

    return found.docs.groupBy("batch").cogroup(found.flags.groupBy("batch")).applyInArrow(emit, schema)


def mask_of(n: int, flags: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols lie under a flagged window."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, flags["start"], 1)
    np.add.at(delta, flags["start"] + flags["n"] + window - 1, -1)
    return np.cumsum(delta[:-1]) > 0

