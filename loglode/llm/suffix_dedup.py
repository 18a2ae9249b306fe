"""Operator 6: suffix-array deduplication; the collection's suffix order is built column by column.

Each shard inserts one symbol of every string in each round, from the right: the new suffixes take their places in
the Burrows-Wheeler transform of all suffixes so far, and the common prefixes next to them are updated from range
minima.  Both arrays live in external files; a round reads them in blocks to find the places, and again in blocks to
write them out with the new rows.  Neighbours with a common prefix of `window` bytes mark repeated windows.

The strings of a shard are its distinct segments without the windows whose hash is theirs alone, which cannot repeat;
every other window stands in the transform, once for each distinct string that holds it.

A byte goes when it lies under a string of `window` bytes that also starts anywhere else, in the same document or
another.  Null texts count as empty.  Rows that share a doc_id are documents of their own.  Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, gram_hashes, release
from .repeats import Unit, covered, mask_of, repeated_windows
from .substring_dedup import ANSWER, ANSWER_ARROW

END = 0xFF  # never part of UTF-8; stands where a string has begun and has no further symbol


class ColumnwiseBWT:
    """BWT and common prefixes of a collection, kept in two files of `folder` that are read in blocks of `block` rows."""

    def __init__(self, strings: list[bytes], cap: int, folder: str, block: int = 1 << 20):
        self.strings, self.cap, self.m, self.block = strings, cap, len(strings), block
        self.kinds = np.dtype(np.uint8), np.dtype(np.uint8 if cap < 256 else np.uint16)
        self.files = [Path(folder, name) for name in ("bwt", "lcp")]
        self.spare = [Path(folder, name) for name in ("bwt.new", "lcp.new")]
        self.lengths = np.array([len(s) for s in strings])
        self.joined = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.cumsum(self.lengths)
        tails = np.array([s[-1] if s else END for s in strings], np.uint8)
        self._write(iter([(tails, np.zeros(self.m, self.kinds[1]))]))
        self.counts = np.bincount(tails, minlength=256)
        self.rows = np.arange(self.m)  # the row of every string's longest suffix so far
        for size in range(1, int(self.lengths.max(initial=0)) + 1):
            self._round(size)

    def _blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        with self.files[0].open("rb") as bwt, self.files[1].open("rb") as lcp:
            at = 0
            while data := bwt.read(self.block):
                yield at, np.frombuffer(data, np.uint8), np.frombuffer(lcp.read(len(data) * self.kinds[1].itemsize), self.kinds[1])
                at += len(data)

    def _write(self, blocks: Iterator) -> None:
        with self.spare[0].open("r+b" if self.spare[0].exists() else "wb") as bwt, self.spare[1].open("r+b" if self.spare[1].exists() else "wb") as lcp:
            for a, b in blocks:  # longer arrays go over shorter ones: truncating would wait for the disk
                bwt.write(a)
                lcp.write(b)
        self.files, self.spare = self.spare, self.files

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfile(self.files[0], np.uint8), np.fromfile(self.files[1], self.kinds[1])

    def _round(self, size: int) -> None:
        """All strings of `size` symbols or more put their suffix of that size in its place."""
        live = np.flatnonzero(self.lengths >= size)
        live = live[np.argsort(self.rows[live])]
        at = self.rows[live]
        less = np.concatenate([[0], np.cumsum(self.counts)])
        place, before, after = (np.zeros(len(live), np.int64) for _ in range(3))  # place: rows whose symbols sort before this one's
        seen, low, waiting = np.zeros(256, np.int64), np.full(256, self.cap, np.int64), np.full(256, -1)
        symbols = []
        for start, bwt, lcp in self._blocks():
            mine = slice(*np.searchsorted(at, [start, start + len(bwt)]).tolist())
            here = at[mine] - start
            symbol = bwt[here]
            symbols.append(symbol)
            order = np.argsort(bwt, kind="stable")
            inside = np.bincount(bwt, minlength=256)
            group = np.concatenate([[0], np.cumsum(inside)])
            by = np.argsort(symbol, kind="stable")
            nth = np.empty(len(here), np.int64)  # where each row stands in order
            cuts = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=256))])
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                some = by[cuts[c] : cuts[c + 1]]
                nth[some] = group[c] + np.searchsorted(order[group[c] : group[c + 1]], here[some])
            place[mine] = less[symbol] + seen[symbol] + nth - group[symbol]
            first, last = nth == group[symbol], nth + 1 == group[symbol.astype(np.int64) + 1]
            before[mine] = self._minima(lcp, order[np.maximum(nth - 1, 0)], here, ~first)
            after[mine] = self._minima(lcp, here, order[np.minimum(nth + 1, len(order) - 1)], ~last)
            if start or len(bwt) == self.block:  # what reaches over the edges of blocks
                down, up = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
                known = np.flatnonzero(inside)
                head, tail = order[group[known]], order[group[known + 1] - 1]
                for i in np.flatnonzero(first & (seen[symbol] > 0)).tolist():
                    before[mine.start + i] = min(self.cap, 1 + min(low[symbol[i]], down[here[i]]))
                for c, h in zip(known.tolist(), head.tolist()):
                    if waiting[c] >= 0:
                        after[waiting[c]] = min(self.cap, 1 + min(low[c], int(down[h])))
                        waiting[c] = -1
                low = np.minimum(low, int(down[-1]))
                low[known] = np.where(tail + 1 < len(lcp), up[np.minimum(tail + 1, len(lcp) - 1)], self.cap)
                waiting[symbol[last]] = mine.start + np.flatnonzero(last)
                seen += inside
        symbol = np.concatenate(symbols)
        by = np.argsort(place, kind="stable")
        live, new, before, after = live[by], self.m + place[by], before[by], after[by]
        left = self.lengths[live] > size
        put = np.full(len(live), END, np.uint8)
        put[left] = self.joined[self.ends[live[left]] - size - 1]
        self._write(self._grown(new, put, before, after))
        self.counts += np.bincount(put, minlength=256)
        self.rows[live] = new

    def _grown(self, new: np.ndarray, put: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The arrays with the rows `new`, block by block; `after` holds for the row that follows a new one."""
        done, start, carry = 0, 0, -1  # new rows written, rows written, common prefix for the next row
        for first, bwt, lcp in self._blocks():
            last = first + len(bwt) == sum(self.counts)
            stop = len(new) if last else done + int(np.searchsorted(new[done:] - np.arange(done, len(new)), first + len(bwt)))
            total = len(bwt) + stop - done
            own = new[done:stop] - start
            old = np.ones(total, bool)
            old[own] = False
            a, b = np.empty(total, np.uint8), np.empty(total, self.kinds[1])
            a[old], b[old] = bwt, lcp
            a[own] = put[done:stop]
            inner = own + 1 < total
            if carry >= 0:
                b[0] = carry
            b[own[inner] + 1] = after[done:stop][inner]
            b[own] = before[done:stop]
            carry = int(after[stop - 1]) if stop > done and not inner[-1] else -1
            yield a, b
            done, start = stop, start + total

    def _minima(self, lcp: np.ndarray, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """1 + min(lcp[a+1 .. b]), at most cap; 0 where not valid."""
        out = np.zeros(len(a), np.int64)
        which = np.flatnonzero(valid)
        if len(which):
            edges = np.empty(2 * len(which), np.int64)
            edges[0::2], edges[1::2] = a[which] + 1, b[which] + 1
            low = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), edges)[0::2]
            out[which] = np.minimum(low.astype(np.int64) + 1, self.cap)
        return out

    def windows(self) -> list[np.ndarray]:
        """For every string, which of its windows of `cap` symbols have an equal one next to them."""
        bwt, lcp = self.read()
        order = np.argsort(bwt, kind="stable")
        to = np.empty(len(bwt), np.int64)
        to[order] = self.m + np.arange(len(order))
        near = np.maximum(lcp, np.append(lcp[1:], lcp.dtype.type(0))) >= self.cap
        out = [np.zeros(max(0, n - self.cap + 1), bool) for n in self.lengths]
        row = np.arange(self.m)
        live = np.arange(self.m)
        for size in range(1, int(self.lengths.max(initial=0)) + 1):
            live = live[self.lengths[live] >= size]
            row[live] = to[row[live]]
            if size >= self.cap:
                for i in live[near[row[live]]]:
                    out[i][self.lengths[i] - size] = True
        return out


def without_anchors(strings: list[bytes], anchors: np.ndarray, n_win: np.ndarray, gram: int) -> tuple[list[bytes], int]:
    """The strings with their anchor replaced by a short name, and the name's length.

    All windows of a segment hold its anchor, a run of `gram` bytes that all segments under it share.  Written as its
    number in the shard, in bytes that UTF-8 never uses, it leaves equal windows equal and others different.
    """
    lengths = np.array([len(x) for x in strings])
    grams = gram_hashes(BYTE_HASH[np.frombuffer(b"".join(strings), np.uint8)], gram)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(strings)), lengths)[: len(grams)]
    at = np.flatnonzero(grams == anchors[owner])
    at = at[at - begin[owner[at]] >= n_win[owner[at]] - 1]  # the last window's leftmost
    _, first = np.unique(owner[at], return_index=True)
    place = (at[first] - begin).tolist()
    known: dict[bytes, int] = {}
    number = [known.setdefault(x[p : p + gram], len(known)) for x, p in zip(strings, place)]
    digits = 1
    while 9**digits < len(known):
        digits += 1
    names = [bytes(0xF5 + k // 9**d % 9 for d in range(digits)) for k in range(len(known))]
    return [x[:p] + names[k] + x[p + gram :] for x, p, k in zip(strings, place, number)], digits


def repeated_in_shard(strings: list[bytes], anchors: np.ndarray, n_win: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Which windows of each segment are repeated among all segments of the shard.

    A window whose hash is its own alone cannot repeat, so it is trimmed off first.  Strings that are equal then stand
    in the index once; being there twice or more, all their windows are repeated.
    """
    lengths = np.array([len(x) for x in strings])
    hashes = gram_hashes(BYTE_HASH[np.frombuffer(b"".join(strings), np.uint8)], window)
    begin, edges = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(n_win)])
    at = np.arange(edges[-1]) + np.repeat(begin[:-1] - edges[:-1], n_win)  # where each window starts in the joined text
    h = hashes[at]
    in_order = np.sort(h)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    kept = np.zeros(len(h), bool)
    if len(twice):
        kept = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    new = np.zeros(len(kept), bool)
    new[edges[:-1]] = True
    first = np.flatnonzero(kept & (new | ~np.concatenate([[False], kept[:-1]])))
    last = np.flatnonzero(kept & np.concatenate([new[1:] | ~kept[1:], [True]])[: len(kept)])
    out = np.zeros(len(kept), bool)
    if len(first):
        short, digits = without_anchors(strings, anchors, n_win, gram)
        size = window - gram + digits
        owner = np.searchsorted(edges, first, side="right") - 1
        pieces = [short[o][a : b + size] for o, a, b in zip(owner.tolist(), (first - edges[owner]).tolist(), (last - edges[owner]).tolist())]
        times: dict[bytes, int] = {}
        for x in pieces:
            times[x] = times.get(x, 0) + 1
        with tempfile.TemporaryDirectory() as folder:  # this task's own files; they go with it
            marks = dict(zip(times, ColumnwiseBWT(list(times), size, folder).windows()))
        for a, x in zip(first.tolist(), pieces):
            out[a : a + len(marks[x])] = marks[x] if times[x] == 1 else True
    return [out[a:b] for a, b in zip(edges[:-1], edges[1:])]


def repeated(docs: DataFrame, window: int = 400, gram: int = 320, group_limit: int = 8192):
    unit = Unit(False, window, gram)

    def index(u: Unit):
        def run(table: pa.Table) -> pa.Table:
            marks = repeated_in_shard(table["content"].to_pylist(), table["anchor"].to_numpy().view(np.uint64), table["n_win"].to_numpy().astype(np.int64), window, u.gram)
            keep = np.array([c == 1 and m.any() for c, m in zip(table["copies"].to_pylist(), marks)], bool)
            table = table.filter(pa.array(keep))
            release()
            payload = [m.tobytes() for m, k in zip(marks, keep) if k]
            return pa.table([table["anchor"], table["c1"], pa.array(payload, pa.binary())], schema=ANSWER_ARROW)

        return run

    def whole(distinct: DataFrame) -> DataFrame:
        return distinct.select("anchor", "c1", F.lit(None).cast("binary").alias("payload"))

    def read(payloads: pa.Array, rows: np.ndarray, **own: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        some = np.flatnonzero(payloads.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            out[np.isin(rows, some)] = np.frombuffer(b"".join(payloads.take(pa.array(some)).to_pylist()), bool)
        return out

    return unit, repeated_windows(docs, unit, index, ANSWER, whole, read, lone=False, group_limit=group_limit, shard_rows=1000)


def suffix_dedup(docs: DataFrame, window: int = 400, gram: int = 320, group_limit: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept_text, kept_sha256, text_sha256 of every document.

    The hash is of the kept bytes; kept_text leaves out characters that a cut has split.
    """
    unit, found = repeated(docs, window, gram, group_limit)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256", "text_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string(), pa.string()]

    def out(ids: list, texts: list, flags: list) -> pa.Table:
        rows = []
        for i, data, f in zip(ids, texts, flags):
            spans: list = []
            if len(f):
                gone = mask_of(len(data), f, window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = edge.reshape(-1, 2).tolist()
            kept = data if not spans else b"".join(data[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(data)]))
            rows.append((i, len(data), len(data) - len(kept), len(spans), spans, kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest(), hashlib.sha256(data).hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

    return covered(found, unit, out, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_text string, kept_sha256 string, text_sha256 string")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept_text", "text_sha256")
