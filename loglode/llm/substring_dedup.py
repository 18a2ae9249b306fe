"""Operator 2: substring deduplication with a compressed FM-index per shard.

A window of `window` words that also starts earlier in the corpus (smaller doc_id, or the same document and an earlier
start) is a repeat; words under repeats are removed.  Each shard keeps its distinct segments as one text of word
symbols, held as a Burrows-Wheeler transform in bit-packed wavelet levels.  The segments that documents bring to the
shard are streamed against it right to left: backward search keeps the interval of the longest match so far, and
every match of at least `window` words reports the earliest place in its interval.

Null and empty texts have no words.  Rows that share a doc_id are documents of their own, ordered by text; a null
doc_id counts as lower than all others.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Unit, covered, mask_of, repeated_windows

PLACE = np.dtype([("doc", "<i8"), ("ord", "<i4"), ("start", "<i8")])


class WaveletLevels:
    """A wavelet matrix: one bit-packed level for each bit of a symbol, with a count of ones for every 64 bits."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.n, self.levels = depth, len(symbols), []
        for level in range(depth):
            bit = (symbols >> (depth - 1 - level)) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            self.levels.append((packed, ones, self.n - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ends(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the sequence falls in the last level, going the way of `symbol`."""
        at = at.astype(np.int64)
        for level, (packed, ones, zeros) in enumerate(self.levels):
            within = packed[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            rank = ones[at >> 6] + np.bitwise_count(within)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1, zeros + rank, at - rank)
        return at


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of (first, second), and the rank of each position, equal for equal pairs."""
    n = len(first)
    bits = n.bit_length() + 1
    if 3 * bits <= 63:  # pair and position fit one integer, which sorts faster than positions by pair
        key = np.sort((first << bits | second) << bits | np.arange(n))
        order, key = key & ((1 << bits) - 1), key >> bits
    else:
        order = np.lexsort((second, first))
        key = first[order] * (n + 2) + second[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return order, rank


class FMIndex:
    """Backward search over a collection of sequences, with matches counted up to `reach` symbols."""

    def __init__(self, sequences: list[np.ndarray], reach: int):
        lengths = np.array([len(s) for s in sequences])
        words = np.concatenate(sequences)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(words) + len(lengths), np.int64)  # symbol 0 ends every sequence
        text[np.arange(len(words)) + owner] = ids + 1
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.reach, n = reach, len(text)
        levels, size = [text], 1  # levels[i]: ranks by the first 2^i symbols
        while size < reach:
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = levels[-1][size:] + 1
            self.sa, rank = _ranked(levels[-1], after)
            levels.append(rank)
            size *= 2
        if reach == 1:
            self.sa, _ = _ranked(text, np.zeros(n, np.int64))
        left = np.repeat(self.begin + lengths, lengths + 1) - np.arange(n)  # symbols before the sequence ends
        a, b = self.sa[:-1], self.sa[1:]
        common = np.zeros(len(a), np.int64)
        for i in reversed(range(len(levels))):
            x, y = a + common, b + common
            common += np.where((np.maximum(x, y) < n) & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)]), 1 << i, 0)
        self.lcp = np.zeros(n, np.int16)
        self.lcp[1:] = np.minimum(np.minimum(common, reach), np.minimum(left[a], left[b]))
        last = text[self.sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        self.levels = WaveletLevels(last, max(1, len(self.vocabulary).bit_length()))
        known = np.arange(len(self.vocabulary) + 1)
        self.origin = self.levels.ends(known, np.zeros_like(known))

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the interval of rows that share its first `depth` symbols."""
        n = len(self.sa)
        cut = self.lcp < depth
        cut[0] = True
        lo = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
        starts = np.flatnonzero(cut)
        return lo, np.append(starts[1:], n)[np.cumsum(cut) - 1]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.less[symbol] - self.origin[symbol]
        ends = self.levels.ends(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + ends[: len(symbol)], base + ends[len(symbol) :]

    def matching(self, queries: list[np.ndarray]):
        """Yield (position from the end, query numbers, match length, interval) while all queries are read right to left."""
        lengths = np.array([len(q) for q in queries])
        n, narrow = len(self.sa), {}
        lo, hi, have = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64), np.zeros(len(queries), np.int64)
        words, ends = np.concatenate(queries), np.cumsum(lengths)
        for j in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > j)
            word = words[ends[live] - 1 - j]
            at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == word
            have[live[~known]] = 0
            lo[live[~known]], hi[live[~known]] = 0, n
            todo, symbol = live[known], (at + 1)[known]
            full = have[todo] >= self.reach
            if full.any():  # drop the last word of a match that is as long as it is counted
                self._widen(narrow, todo[full], self.reach - 1, lo, hi, have)
            while len(todo):
                a, b = self.step(symbol, lo[todo], hi[todo])
                found = a < b
                lo[todo[found]], hi[todo[found]] = a[found], b[found]
                have[todo[found]] += 1
                todo, symbol = todo[~found], symbol[~found]
                for size in np.unique(have[todo]):  # shorten what could not be extended by one word, and try again
                    self._widen(narrow, todo[have[todo] == size], int(size) - 1, lo, hi, have)
            yield j, live, have[live], lo[live], hi[live]

    def _widen(self, narrow: dict, which: np.ndarray, depth: int, lo, hi, have) -> None:
        if depth <= 0:
            lo[which], hi[which], have[which] = 0, len(self.sa), 0
            return
        if depth not in narrow:
            narrow[depth] = self.bounds(depth)
        row = lo[which]
        lo[which], hi[which], have[which] = narrow[depth][0][row], narrow[depth][1][row], depth


ANSWER = "anchor long, c1 long, payload binary"
ANSWER_ARROW = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("payload", pa.binary())])


def earliest_places(table: pa.Table, window: int) -> list[bytes]:
    """For every segment of a shard, the earliest place of each of its windows among all segments of the shard."""
    sequences = [np.frombuffer(c, np.uint64) for c in table["content"].to_pylist()]
    index = FMIndex(sequences, window)
    lengths = np.array([len(s) for s in sequences])
    seq = np.searchsorted(index.begin, index.sa, side="right") - 1
    offset = index.sa - index.begin[seq]
    place = np.zeros(len(index.sa), PLACE)
    place["doc"], place["ord"] = table["doc_id"].to_numpy()[seq], table["ord"].to_numpy()[seq]
    place["start"] = table["start"].to_numpy()[seq] + offset
    order = np.lexsort((place["start"], place["ord"], place["doc"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    starts = np.flatnonzero(index.bounds(window)[0] == np.arange(len(order)))
    first = order[np.minimum.reduceat(rank, starts)]  # row of the earliest place of each interval
    edges = np.concatenate([[0], np.cumsum(np.maximum(0, lengths - window + 1))])
    out = np.zeros(edges[-1], PLACE)
    for j, live, have, lo, _ in index.matching(sequences):
        long = have >= window
        out[edges[live[long]] + lengths[live[long]] - 1 - j] = place[first[np.searchsorted(starts, lo[long])]]
    return [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def repeated(docs: DataFrame, window: int = 20, gram: int = 6, group_limit: int = 8192):
    unit = Unit(True, window, gram)

    def index(_: Unit):
        def run(table: pa.Table) -> pa.Table:
            payload = earliest_places(table, window)
            return pa.table([table["anchor"], table["c1"], pa.array(payload, pa.binary())], schema=ANSWER_ARROW)

        return run

    def read(payloads: pa.Array, rows: np.ndarray, ord: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
        first = np.frombuffer(b"".join(payloads.to_pylist()), PLACE)
        same = first["doc"] == doc_id
        return (first["doc"] < doc_id) | (same & ((first["ord"] < ord) | ((first["ord"] == ord) & (first["start"] < start))))

    return unit, repeated_windows(docs, unit, index, ANSWER, None, read, lone=True, group_limit=group_limit)


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 6, group_limit: int = 8192) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every document after its repeated words are gone."""
    unit, found = repeated(docs, window, gram, group_limit)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def out(ids: list, texts: list, flags: list) -> pa.Table:
        rows = []
        for i, text, f in zip(ids, texts, flags):
            words = unit.parts(text)
            gone = mask_of(len(words), f, window) if len(f) else None
            kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((i, len(words), 0 if gone is None else int(gone.sum()), kept, hashlib.sha256(kept).hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return covered(found, unit, out, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
