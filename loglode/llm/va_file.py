"""Operator 12: centroid clustering over a VA-file.

Each vector is kept as a cell number of few bits per dimension beside the full vector.  Per round, tables of the least
and the greatest squared difference between a cell and a centroid's component give, by look-up and addition, an interval
of the distance from the vector to each centroid.  Where one interval lies below all others the vector is assigned
without being read; only where intervals overlap is the full vector fetched, by a join of two tables that are bucketed
alike, and measured against the centroids that are left.  Sums of clusters are kept from round to round and changed by
the vectors that moved.

Vectors are arrays of whole numbers: components times `scale`, rounded down, within +-2^27 (larger ones count as that).
Null vectors, other lengths, and vectors with null or non-finite components are left out.  A null vec_id is a row of
its own whose hash is that of the empty number; rows that share a vec_id are separate rows.  Fewer vectors than
centroids make one centroid each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, delete, written

MOST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of usable vectors."""
    x = F.col("embedding").cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), e * scale))).cast("int"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fits, F.lit(False)))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:vec_id, in that order; vectors of one hash in order of their
    components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([x.v for x in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


@dataclass
class Cells:
    """Per dimension, the cells' first and last values; edges[d] are the first values of all cells but the lowest."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def numbers(self, v: np.ndarray) -> np.ndarray:
        """The cell of each component, two to a byte."""
        c = np.stack([np.searchsorted(e, v[:, d], side="right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)
        c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
        return c[:, 0::2] << 4 | c[:, 1::2]

    def intervals(self, packed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance between each packed vector and each centroid."""
        q = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - q, q - self.high[:, :, None]
        least = np.maximum(0, np.maximum(below, above)) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lo, hi = (np.zeros((len(packed), len(centroids)), np.int64) for _ in range(2))
        for d in range(len(self.edges)):
            cell = packed[:, d // 2] >> 4 if d % 2 == 0 else packed[:, d // 2] & 15
            lo += least[d, cell]
            hi += most[d, cell]
        return lo, hi


def fit_cells(rows: DataFrame, dims: int, bits: int = 4) -> Cells:
    """Cells that hold about equally many values each, from approximate quantiles; any edges give right results."""
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    one = rows.agg(*[F.percentile_approx(F.get("v", F.lit(d)), parts, 1000).alias(f"q{d}") for d in range(dims)], *[f(F.get("v", F.lit(d))).alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    edges = np.array([one[f"q{d}"] for d in range(dims)], np.int64)
    low = np.concatenate([np.array([[one[f"l{d}"]] for d in range(dims)]), edges], axis=1)
    high = np.concatenate([edges - 1, np.array([[one[f"h{d}"]] for d in range(dims)])], axis=1)
    return Cells(edges, low, high)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _described(rows: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """rows with `cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            packed = cells.numbers(_matrix(t["v"], dims))
            yield pa.record_batch([*t.columns, pa.array([x.tobytes() for x in packed], pa.binary())], names=[*t.schema.names, "cells"])

    return rows.mapInArrow(run, "row long, vec_id long, v array<int>, cells binary")


def _narrowed(state: DataFrame, cells: Cells, centroids: np.ndarray, width: int) -> DataFrame:
    """(row, cells, was, cluster, left): the centroid whose interval lies below all others, else null and those left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a in range(0, t.num_rows, 4096):
                part = t.slice(a, 4096)
                lo, hi = cells.intervals(_bytes(part["cells"], width), centroids)
                open_ = lo <= hi.min(axis=1)[:, None]
                n = open_.sum(axis=1)
                cluster = pa.array(open_.argmax(axis=1).astype(np.int32), mask=n > 1)
                n[n == 1] = 0
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                which = np.nonzero(open_[n > 0])[1].astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(ends), pa.array(which))
                yield pa.record_batch([part["row"], part["cells"], part["cluster"], cluster, left], names=["row", "cells", "was", "cluster", "left"])

    return state.mapInArrow(run, "row long, cells binary, was int, cluster int, left array<int>")


def _measured(near: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(row, cells, was, cluster) of vectors with several centroids left: the nearest, the smaller number if tied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v, left = _matrix(t["v"], dims), t["left"]
            sizes, which = np.diff(left.offsets.to_numpy()), left.flatten().to_numpy()
            cluster = np.empty(t.num_rows, np.int32)
            for a in range(0, t.num_rows, 4096):
                at = np.repeat(np.arange(a, min(a + 4096, t.num_rows)), sizes[a : a + 4096])
                w = which[sizes[:a].sum() :][: len(at)]
                d = ((v[at] - centroids[w]) ** 2).sum(axis=1)
                first = np.concatenate([[0], np.cumsum(sizes[a : a + 4096])[:-1]])
                least = np.repeat(np.minimum.reduceat(d, first), sizes[a : a + 4096])
                cluster[a : a + 4096] = np.minimum.reduceat(np.where(d == least, w, len(centroids)), first)
            yield pa.record_batch([t["row"], t["cells"], t["was"], pa.array(cluster)], names=["row", "cells", "was", "cluster"])

    return near.mapInArrow(run, "row long, cells binary, was int, cluster int")


def _changes(moved: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much sums and counts of clusters change, from (was, cluster, v) of the vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dims + 1), np.int64)
        for t in batches:
            v = np.pad(_matrix(t["v"], dims), ((0, 0), (0, 1)), constant_values=1)
            np.add.at(total, t["cluster"].to_numpy(), v)
            np.subtract.at(total, t["was"].fill_null(k).to_numpy(), v)
        at = np.flatnonzero(total[:k].any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(x) for x in total[at].T)], names=["cluster", *names])

    names = [f"x{d}" for d in range(dims + 1)]
    parts = moved.select("was", "cluster", "v").mapInArrow(run, ", ".join(f"{n} long" for n in ["cluster", *names]))
    out = np.zeros((k, dims + 1), np.int64)
    for x in parts.groupBy("cluster").agg(*[F.sum(n).alias(n) for n in names]).collect():  # at most k rows
        out[x.cluster] = [x[n] for n in names]
    return out[:, :dims], out[:, dims]


@dataclass
class Clustering:
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray
    fetched: list[int]  # per round, how many vectors the intervals did not decide


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", bits: int = 4) -> Clustering:
    """Lloyd's rounds over vec_id and embedding, exact in whole numbers, then one more assignment."""
    rows = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids, [])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"), "vectors")
    cells, width = fit_cells(rows, dims, bits), -(-dims // 2)
    file = bucketed(_described(rows, cells, dims), "row", "vafile")
    delete(rows)
    full = file.select("row", "v")
    state = file.select("row", "cells", F.lit(None).cast("int").alias("cluster"))
    sums, counts, fetched = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), []
    for turn in range(rounds + 1):
        near = written(_narrowed(state, cells, centroids, width), "near")
        open_ = near.where("cluster IS NULL").drop("cluster").join(full, "row")
        new = bucketed(near.where("cluster IS NOT NULL").drop("left").unionByName(_measured(open_, centroids, dims)), "row", "state")
        fetched.append(near.where("cluster IS NULL").count())
        delete(near)
        if turn:
            delete(state)
        state = new
        if turn < rounds:
            more = _changes(new.where("NOT cluster <=> was").join(full, "row"), k, dims)
            sums, counts = sums + more[0], counts + more[1]
            centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    return Clustering(_distances(state.select("row", "cluster").join(file.select("row", "vec_id", "v"), "row"), centroids, dims), centroids, fetched)


def _distances(rows: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            d = ((_matrix(t["v"], dims) - centroids[t["cluster"].to_numpy()]) ** 2).sum(axis=1)
            yield pa.record_batch([t["vec_id"], t["cluster"], pa.array(d)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def op12_va_file_clusters(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = written(found.assigned, "assigned")
    inertia = {x.cluster: x.d for x in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a centroid
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    named = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
