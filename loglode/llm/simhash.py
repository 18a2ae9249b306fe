"""Operator 8: SimHash near-duplicates found with tables of distances to reference fingerprints (pivots).

Every distinct 64-bit fingerprint is described by its Hamming distances to many references.  Two fingerprints that
differ in at most `bits` bits have distances that differ by at most `bits` in every coordinate, so a pair with a
larger coordinate difference is discarded and only survivors are compared bit by bit.

To look only at pairs that can pass, references are also measured within bits+1 disjoint groups of bit positions:
with `bits` differing bits at least one group is untouched, so all its distances are equal, and fingerprints are dealt
by that tuple of distances.  A tuple shared by more than `group_limit` fingerprints is dealt again by the groups of its
remaining bit positions, which loses no pair.  A dealt group emits a spanning forest of its links, never all pairs.

Null and empty texts have no words and the fingerprint zero.  A null doc_id is kept and is never a component's id
unless all ids of the component are null.  Rows that share a doc_id are separate rows with that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, written
from .components import components

REFERENCES = mix(np.arange(1, 25, dtype=np.uint64))  # 24 reference fingerprints


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values (seed 42)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = words_per_shingle
    shingles = [b" ".join(words)] if len(words) < n else list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        ones += np.unpackbits(h[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, b in slices(t["text"]):
                fp = np.array([fingerprint(x) for x in t["text"][a:b].to_pylist()], np.uint64).view(np.int64)
                yield pa.record_batch([t["doc_id"][a:b], pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(positions: list[int], parts: int) -> list[list[int]]:
    return [positions[i::parts] for i in range(parts)]


def _dealt(rows: DataFrame, key, groups: list[list[int]]) -> DataFrame:
    """A row for each group of bit positions, keyed by the distances to all references within the group."""
    options = []
    for g in groups:
        mask = sum(1 << b for b in g)
        near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(r)))).bitwiseAND(F.lit(_signed(mask)))) for r in REFERENCES]
        options.append(F.xxhash64(key, F.lit(groups.index(g)), *near))
    return rows.select("fp", F.posexplode(F.array(*options)).alias("group", "key"))


def _forest(fp: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one dealt group: breadth first over what is left, pruned by the pivot table."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    left, queue, out = np.ones(len(fp), bool), [], []
    for seed in range(len(fp)):
        if not left[seed]:
            continue
        left[seed] = False
        queue.append(seed)
        while queue:
            x = queue.pop()
            a = np.searchsorted(table[:, 0], table[x, 0] - bits)
            b = np.searchsorted(table[:, 0], table[x, 0] + bits, side="right")
            near = a + np.flatnonzero(left[a:b])
            for c in range(1, table.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(table[near, c] - table[x, c]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= bits]
            if len(near):
                left[near] = False
                queue.extend(near.tolist())
                out.append((np.full(len(near), fp[x]), fp[near]))
    return out


def links_of(keys: np.ndarray, fp: np.ndarray, bits: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys: every link of a small group, a spanning forest of a larger one."""
    order = np.argsort(keys, kind="stable")
    keys, fp = keys[order], fp[order]
    table = np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    out = []
    for s in range(1, min(small, int(size.max(initial=0)))):
        i = np.flatnonzero((keys[:-s] == keys[s:]) & (size[:-s] <= small))
        for c in range(table.shape[1]):
            if not len(i):
                break
            i = i[np.abs(table[i, c] - table[i + s, c]) <= bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= bits]
        out.append((fp[i], fp[i + s]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > small:
            out += _forest(fp[a:b], table[a:b], bits)
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (fp[:0], fp[:0])


def links(distinct: DataFrame, bits: int = 2, group_limit: int = 20_000, rows_per_shard: int = 50_000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at `bits` or fewer differing bits."""

    def find(t: pa.Table) -> pa.Table:
        a, b = links_of(t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), bits)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    shards = max(1, -(-(bits + 1) * distinct.count() // rows_per_shard))
    todo, out, key = [(distinct, F.lit(0), list(range(64)))], None, None
    for depth in range(5):
        nxt = []
        for rows, key, positions in todo:
            groups = _split(positions, bits + 1)
            dealt = _dealt(rows, key, groups)
            if depth < 4:
                sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("key")
                if not sizes.isEmpty():
                    hot = written(dealt.join(sizes, "key", "left_semi"), "hot")
                    dealt = dealt.join(sizes, "key", "left_anti")
                    nxt += [(hot.where(F.col("group") == i), F.col("key"), [p for p in positions if p not in g]) for i, g in enumerate(groups)]
            found = dealt.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(find, "a long, b long")
            out = found if out is None else out.unionByName(found)
        todo = nxt
    return out


def simhash_components(docs: DataFrame, bits: int = 2, group_limit: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), n_linked (rows in it)."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "distinct")
    labels = components(links(distinct.select("fp"), bits, group_limit)).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = labelled.groupBy("label").agg(F.min("low").alias("component_id"), F.sum("copies").alias("n_linked"))
    by_fp = labelled.join(ids, "label").select("fp", "component_id", "n_linked")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
