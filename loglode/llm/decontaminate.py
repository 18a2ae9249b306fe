"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Test items are the queries and documents are the domains.  Of a document only the shingles that occur in some item
matter to containment, so its domain is cut to those; domains are then partitioned by size (powers of two).  In a
partition with domains of at most u shingles, an item of q shingles contained to a share of `threshold` has a Jaccard
similarity of at least t*q / (u + q - t*q) with its domain; that decides how many minima must be compared for a miss
to be rarer than `miss`.  Where that would be over `most_minima`, as for tiny items in large domains, minima tell
nothing apart, and every item that shares enough shingle hashes with the domain is a candidate.  Candidates are
verified by exact containment of word shingles.

Documents are scanned where they lie, in one pass without a shuffle for each block of items; a block (of `block`
items or `block_bytes` bytes of text, about) is all that is on the driver or sent to executors at a time: of several
blocks each is answered into a table before the next one is fetched.

Words are runs of word characters in lower case.  An item of fewer than `shingle` words is one shingle of all its
words; one without words, or null, matches nothing.  Null and empty documents match nothing.  Rows that share a doc_id
or an item_id are reported one by one; null ids are reported as null.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, gram_hashes, memory, mix, slices, written

WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class StringHashes(Memo):
    """Hashes of words, remembered for frequent ones."""

    def __init__(self, limit: int = 300_000):
        super().__init__(lambda word: xxhash.xxh3_64_intdigest(word), limit)

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class SizeClass:
    """Items of about one size: their minima under one hash function after another, and their shingles."""

    def __init__(self, members: list[int], hashes: list[np.ndarray], most: int):
        self.members, self.most = np.array(members, np.int32), most
        self.values, self.order = np.zeros((0, len(members)), np.uint64), np.zeros((0, len(members)), np.int32)
        self.need = np.array([len(h) for h in hashes])
        self.flat, self.begin = np.concatenate(hashes), np.cumsum(self.need) - self.need
        shingles, owner = self.flat, np.repeat(np.arange(len(hashes)), self.need)
        by = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[by], owner[by].astype(np.int32)

    def minima(self, count: int) -> None:
        """At least `count` rows of the items' minima in order; in all no more than `most`."""
        have = len(self.values)
        if have < count:
            more = SEEDS[have : min(self.most, max(count, 2 * have))]
            table = np.stack([np.minimum.reduceat(mix(self.flat ^ s), self.begin) for s in more])
            order = np.argsort(table, axis=1)
            self.values = np.concatenate([self.values, np.take_along_axis(table, order, axis=1)])
            self.order = np.concatenate([self.order, order.astype(np.int32)])

    def meeting(self, domain: np.ndarray, count: int) -> np.ndarray:
        """Items that share one of the first `count` minima with the domain."""
        self.minima(count)
        found = []
        for f in range(count):
            low = mix(domain ^ SEEDS[f]).min()
            a, b = np.searchsorted(self.values[f], low), np.searchsorted(self.values[f], low, side="right")
            if b > a:
                found.append(self.order[f, a:b])
        return self.members[np.unique(np.concatenate(found))] if found else self.members[:0]

    def sharing(self, domain: np.ndarray, threshold: float) -> np.ndarray:
        """Items that share as many shingle hashes with the domain as containment takes."""
        a, b = np.searchsorted(self.shingles, domain), np.searchsorted(self.shingles, domain, side="right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.members))
        return self.members[(shared > 0) & (shared >= threshold * self.need)]


SEEDS = mix(np.arange(1, 1025, dtype=np.uint64))


class Ensemble:
    """Items of one block: their shingles, by shingle length, and their size classes."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float, miss: float, most_minima: int = 64):
        self.threshold, self.miss, self.most, self.items, self.words = threshold, miss, min(most_minima, len(SEEDS)), [], StringHashes()
        classes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        hashes = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                size = min(shingle, len(words))
                grams = frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
                hashes.append(np.unique(gram_hashes(self.words.array(words), size)))
                classes[size][len(hashes[-1]).bit_length()].append(len(self.items))
                self.items.append((item_id, grams))
        self.classes = {size: {bits: SizeClass(which, [hashes[i] for i in which], self.most) for bits, which in by.items()} for size, by in classes.items()}
        self.universe = {size: np.unique(np.concatenate([c.shingles for c in by.values()])) for size, by in self.classes.items()}

    def candidates(self, size: int, domain: np.ndarray) -> list[int]:
        """Items whose minima meet those of the domain (sorted distinct shingle hashes) in its size partition."""
        found: set[int] = set()
        upper = (1 << len(domain).bit_length()) - 1
        for bits, some in self.classes[size].items():
            q = 1 << (bits - 1)  # the smallest size in the class
            if upper < self.threshold * q:
                continue
            similarity = min(1.0, self.threshold * q / (upper + q - self.threshold * q))
            count = 1 if similarity == 1 else math.ceil(math.log(self.miss) / math.log(1 - similarity))
            found.update((some.meeting(domain, count) if count <= self.most else some.sharing(domain, self.threshold)).tolist())
        return sorted(found)

    def matches(self, text: str | None) -> Iterator[tuple]:
        words = words_of(text)
        if not words:
            return
        h = self.words.array(words)
        for size, universe in self.universe.items():
            g = gram_hashes(h, size)
            at = np.minimum(np.searchsorted(universe, g), len(universe) - 1)
            places = np.flatnonzero(universe[at] == g)
            if not len(places):
                continue
            candidates = self.candidates(size, np.unique(g[places]))
            if candidates:
                mine = {tuple(words[i : i + size]) for i in places.tolist()}
                for c in candidates:
                    item_id, grams = self.items[c]
                    shared = len(grams & mine)
                    if shared >= self.threshold * len(grams):
                        yield item_id, len(grams), shared, shared / len(grams)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, block: int = 20_000, block_bytes: int = 1 << 24, miss: float = 1e-9) -> DataFrame:
    """A row (doc_id, item_id, n_shingles, n_shared, containment) for each document that holds a test item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // block_bytes))
    out = None
    for i in range(blocks):
        some = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()]
        found = rows.mapInArrow(_scan(some, shingle, threshold, miss), SCHEMA)
        if blocks > 1:  # answered now, so that the driver lets go of this block before it fetches the next
            found = written(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(items: list[tuple], shingle: int, threshold: float, miss: float):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.float64()]
    key = ("items", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ensemble = memory(key, lambda: Ensemble(items, shingle, threshold, miss))
        for t in batches:
            for a, b in slices(t["text"]):
                out = [(d, *m) for d, text in zip(t["doc_id"][a:b].to_pylist(), t["text"][a:b].to_pylist()) for m in ensemble.matches(text)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    return run


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
