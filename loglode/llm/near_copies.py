"""Near copies by five-word shingles: pairs whose Jaccard similarity is `threshold` or more, verified on the shingles.

Candidates share a band of minima under universal hash functions (multiply, add, take the least).  With 24 bands of 4
minima a pair at similarity 0.8 shares none with a chance of 3e-6 (at 0.85: 2e-8), and less above.  In a band's bucket
every member is first compared with the member that has most company in all its buckets, the seed; what these links
join is one component, and only pairs across components are left.
Buckets of up to `whole` members compare all of those.  Members of larger buckets are dealt again by their rarest
shared shingles (a prefix filter within segments of set sizes), which misses no pair at all: texts of the same
boilerplate meet only where their own parts do.  Both ways compare every pair, so `whole` changes the cost alone.

Of candidates, one byte of each minimum is compared first, inside the join that meets them: fewer equal bytes than a
pair at the threshold has, but for a chance of 1e-9, rule it out.  What remains is verified by shingles, as 64-bit hashes, in Spark.

Words are lower-case runs without white space, as for fingerprints.  A text of fewer words than a shingle is one
shingle; null and empty texts have none and are no one's near copy.  Null doc_ids link but are never a component's id
unless all ids of the component are null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, gram_hashes, mix, slices, word_hashes, written
from .components import components

BANDS, ROWS, MINIMA = 24, 4, 128  # bands are cut from the first 96 minima; all are compared
FACTORS = mix(np.arange(101, 101 + MINIMA, dtype=np.uint64)) | np.uint64(1)
TERMS = mix(np.arange(301, 301 + MINIMA, dtype=np.uint64))
BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_hashes(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words = word_hashes([(x or "").encode().lower() for x in texts])
    return [np.unique(gram_hashes(w, min(size, len(w)))) if len(w) else np.empty(0, np.uint64) for w in words]


def lowest(h: np.ndarray) -> np.ndarray:
    """The minima of the shingles h under all hash functions."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 512):
        low = np.minimum(low, (h[None, a : a + 512] * FACTORS[:, None] + TERMS[:, None]).min(axis=1))
    return low


def bands(h: np.ndarray) -> np.ndarray:
    """One key for each band of minima of the shingles h."""
    return _bands(lowest(h))


def _bands(low: np.ndarray) -> np.ndarray:
    out = BAND.copy()
    for column in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        out = mix(out ^ column)
    return out


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def planes(low: np.ndarray) -> np.ndarray:
    """One byte of each minimum, bit by bit: 64-bit words 2k and 2k + 1 hold bit k of all minima."""
    bits = np.zeros((8, 128), np.uint8)
    bits[:, : len(low)] = np.unpackbits(mix(low).astype(np.uint8)[:, None], axis=1).T
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _keys(hashes: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in hashes], np.uint64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def minima(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, bands, planes) of documents that have shingles; key stands for the set of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, b in slices(t["text"]):
                h = shingle_hashes(t["text"][a:b].to_pylist())
                low = [lowest(x) for x in h]
                columns = [t["doc_id"][a:b], _keys(h), pa.array([len(x) for x in h], pa.int64()), _lists([_bands(x) for x in low]), _lists([planes(x) for x in low])]
                out = pa.record_batch(columns, names=["doc_id", "key", "n", "bands", "planes"])
                yield out.filter(pa.array([len(x) > 0 for x in h], pa.bool_()))

    return _ids(docs).mapInArrow(run, "doc_id long, key long, n long, bands array<long>, planes array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, n, shingles)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, b in slices(t["text"]):
                h = shingle_hashes(t["text"][a:b].to_pylist())
                yield pa.record_batch([_keys(h), pa.array([len(x) for x in h], pa.int64()), _lists(h)], names=["key", "n", "shingles"])

    return _ids(docs).mapInArrow(run, "key long, n long, shingles array<long>")


def _enough(shared: Column, n_a: Column, n_b: Column, threshold: float) -> Column:
    return shared * (1 + threshold) >= threshold * (n_a + n_b) - 1e-9


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether n and planes of the sides a and b (prefixes of the columns' names) allow for the threshold."""
    count = MINIMA
    least = count * threshold - 6.5 * (count * threshold * (1 - threshold)) ** 0.5
    n_a, n_b, p_a, p_b = (F.col(f"{x}{c}") for c in ("n", "planes") for x in (a, b))
    differ = [functools.reduce(Column.bitwiseOR, [F.get(p_a, F.lit(2 * k + w)).bitwiseXOR(F.get(p_b, F.lit(2 * k + w))) for k in range(8)]) for w in (0, 1)]
    return _enough(F.least(n_a, n_b), n_a, n_b, threshold) & (F.bit_count(differ[0]) + F.bit_count(differ[1]) <= count - least)


def likely(pairs: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose sizes and bytes of minima allow for the threshold."""
    side = lambda c: keys.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("planes").alias(f"{c}_planes"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_alike("a_", "b_", threshold)).select("a", "b")


def verified(pairs: DataFrame, numbered: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys that are as similar as threshold; numbered has the texts, by doc_id."""
    pairs = written(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    one = written(keys.join(needed, "key", "left_semi").select("doc_id"), "needed")
    sets = written(shingle_sets(numbered.join(one, "doc_id", "left_semi")), "shingles")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    out = written(both.where(_enough(shared, F.col("n_a"), F.col("n_b"), threshold)).select("a", "b"), "links")
    for x in (pairs, one, sets):
        delete(x)
    return out


def _emitted(sets: DataFrame, hot: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """(lo, hi, h, seg, key, label, n, planes): the shingles under which each key of hot (key, label, n, planes) must
    meet every key as similar as threshold, by segments of set sizes.

    Shingles that no other key has cannot meet and are left out; the others are ordered from rare to frequent.  Two
    sets that share s shingles or more share one of the first len - s + 1 of each (prefix filter); s follows from the
    own size and the least size in the other's segment, so boilerplate that is too short to link two texts lies
    behind both prefixes and brings nobody together.
    """
    each = sets.select("key", F.explode("shingles").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = each.join(often, "h").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    seg = lambda n: F.floor(F.log(n) / math.log(ratio) + 1e-9)
    x = rare.join(hot, "key").withColumn("seg", seg(F.col("n").cast("double"))).withColumn("m", F.size("shared"))
    low, high = seg(F.greatest(F.lit(1.0), F.ceil(F.col("n") * threshold - 1e-6).cast("double"))), seg(F.floor(F.col("n") / threshold + 1e-6).cast("double"))
    x = x.withColumn("other", F.explode(F.sequence(low, high)))
    least = F.greatest(F.ceil(F.pow(F.lit(ratio), "other") * (1 - 1e-9) - 1e-6), F.ceil(F.col("n") * threshold - 1e-6))
    first = F.col("m") - F.ceil((F.col("n") + least) * (threshold / (1 + threshold)) - 1e-6) + 1
    x = x.withColumn("first", first.cast("int")).where("first > 0")
    x = x.select(F.least("seg", "other").alias("lo"), F.greatest("seg", "other").alias("hi"), "seg", "key", "label", "n", "planes", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("s"))
    return x.select("lo", "hi", F.col("s.h").alias("h"), "seg", "key", "label", "n", "planes")


def prefix_pairs(sets: DataFrame, hot: DataFrame, threshold: float, ratio: float = 1.05) -> DataFrame:
    """Pairs (a, b) of keys of hot with different labels that may be as similar as threshold; none that is, is missing.

    In a group of keys that meet, those of the most frequent label are compared with the others only, so a crowd of one
    label costs in proportion to its members.
    """
    group = ["lo", "hi", "h"]
    rows = written(_emitted(sets, hot, threshold, ratio), "prefixes")
    sums = rows.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("c"))
    most = written(sums.groupBy(*group).agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("top")).where("labels > 1").select(*group, F.col("top.label").alias("top")), "groups")
    rows = rows.join(most, group)
    side = lambda p, d: d.select([F.col(c).alias(f"{p}_{c}") for c in [*group, "seg", "key", "label", "n", "planes", "top"]])
    a, b = side("a", rows.where("label <> top")), side("b", rows)
    on = F.expr("a_lo = b_lo AND a_hi = b_hi AND a_h = b_h AND a_label <> b_label AND (a_lo = a_hi OR a_seg <> b_seg) AND (b_label = b_top OR a_key < b_key)")
    found = a.join(b, on & _alike("a_", "b_", threshold)).select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))
    return written(found.distinct(), "candidates")


def _mixed(m: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components of links, with their label."""
    labels = written(components(links).withColumnRenamed("node", "key"), "labels")
    x = m.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = x.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("band")
    return written(x.join(several, "band", "left_semi"), "mixed")


def near_copy_links(numbered: DataFrame, keys: DataFrame, threshold: float = 0.8, whole: int = 128) -> DataFrame:
    """Links (a, b) that connect the near copies among keys (key, doc_id, n, bands, planes)."""
    ordered = lambda p: (F.least("key", f"{p}.key").alias("a"), F.greatest("key", f"{p}.key").alias("b"))
    members = keys.select("key", F.explode("bands").alias("band"))
    sizes = written(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    m = written(members.join(sizes, "band"), "members")
    seeds = m.join(m.groupBy("key").agg(F.sum("size").alias("w")), "key").groupBy("band").agg(F.max(F.struct("w", "key")).alias("seed"))
    pairs = m.join(seeds, "band").where("key <> seed.key").select(*ordered("seed"))
    links = verified(likely(pairs, keys, threshold), numbered, keys, threshold)
    x = _mixed(m, links)
    few = x.where(F.col("size") <= whole).select("band", "key", "label").join(keys.select("key", "n", "planes"), "key")
    on = F.expr("p.band = q.band AND p.key < q.key AND p.label <> q.label") & _alike("p.", "q.", threshold)
    more = few.alias("p").join(few.alias("q"), on).select(F.col("p.key").alias("a"), F.col("q.key").alias("b"))
    hot = written(x.where(F.col("size") > whole).select("key", "label").distinct().join(keys.select("key", "doc_id", "n", "planes"), "key"), "hot")
    if not hot.isEmpty():
        sets = written(shingle_sets(numbered.join(hot.select("doc_id"), "doc_id", "left_semi")), "shingles")
        more = more.unionByName(prefix_pairs(sets, hot.drop("doc_id"), threshold))
    return links.unionByName(verified(more, numbered, keys, threshold))


def near_copy_components(docs: DataFrame, threshold: float = 0.8, kept: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (smallest doc_id reachable over near copies) of each
    document that has words.

    kept: with it, docs is a table whose doc_ids are all different, and only those in kept (column row) count.
    """
    numbered = docs if kept is not None else written(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").cast("long").alias("own"), "text"), "numbered", "zstd")
    labelled = _labelled_rows(numbered, threshold, kept)
    if kept is None:
        labelled = labelled.join(numbered.select("doc_id", "own"), "doc_id").select(F.col("own").alias("doc_id"), "n_shingles", "label")
    return _named(written(labelled, "labelled"))


def _labelled_rows(numbered: DataFrame, threshold: float, kept: DataFrame | None = None) -> DataFrame:
    rows = minima(numbered)
    rows = written(rows.join(kept, rows["doc_id"] == kept["row"], "left_semi") if kept is not None else rows, "minima")
    keys = written(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bands", "planes")]), "keys")
    whole, rows = rows, written(rows.select("doc_id", "key", "n"), "rows")
    delete(whole)  # keys has the bands and planes
    labels = components(near_copy_links(numbered, keys, threshold)).withColumnRenamed("node", "key")
    return rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(labels, "key", "left").select("doc_id", "n_shingles", F.coalesce("label", "key").alias("label"))


def _named(labelled: DataFrame) -> DataFrame:
    ids = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(ids, "label").select("doc_id", "n_shingles", "component_id")
