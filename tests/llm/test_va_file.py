"""Operator 12 against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loglode.llm import va_file


def kept(rows, dims, scale=256):
    usable = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    return [(i, [max(-va_file.MOST, min(va_file.MOST, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v in rows if usable(v)]


def brute(rows, k, rounds, dims):
    rows = kept(rows, dims)
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in rows), key=str), centroids


def vectors(seed, n, dims):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(middles)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * (dims - 1)), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, [None] * dims)]
    return rows + [(None, [0.25] * dims), (3, rows[3][1]), (3, rows[4][1]), (n + 6, [0.0] * dims), (n + 7, [-0.001] * dims), (n + 8, [1e30] * dims), (n + 9, [-1e30] * dims)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, b"x") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster int, cells binary").repartition(3)


@pytest.mark.parametrize("n, k, dims", [(200, 9, 8), (60, 12, 7), (3, 40, 4)])
def test_equals_plain_rounds(spark, n, k, dims):
    rows = vectors(n, n, dims)
    found = va_file.cluster(frame(spark, rows), k=k, dims=dims)
    want, centroids = brute(rows, k, 5, dims)
    assert found.centroids.tolist() == centroids
    assert sorted(map(tuple, found.assigned.collect()), key=str) == want


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * 2) for i in range(30)]
    found = va_file.cluster(frame(spark, rows), k=8, dims=2)
    want, centroids = brute(rows, 8, 5, 2)
    assert found.centroids.tolist() == centroids and sorted(map(tuple, found.assigned.collect()), key=str) == want


def test_empty_table(spark):
    assert va_file.cluster(frame(spark, vectors(1, 2, 4)).where("false"), dims=4).assigned.collect() == []


def test_intervals_hold_and_decide(spark):
    r = np.random.default_rng(1)
    middles = r.normal(size=(5, 16)) * 300
    v = np.floor(middles[r.integers(5, size=400)] + r.normal(size=(400, 16)) * 20).astype(int)
    df = spark.createDataFrame([(x.tolist(),) for x in v], "v array<int>")
    cells = va_file.fit_cells(df, 16)
    lo, hi = cells.intervals(cells.numbers(v), middles.astype(int))
    d = ((v[:, None] - middles.astype(int)[None]) ** 2).sum(axis=2)
    assert (lo <= d).all() and (d <= hi).all()
    assert ((lo <= hi.min(axis=1)[:, None]).sum(axis=1) == 1).mean() > 0.9  # most need no full vector


def test_query(spark, sf_dir):
    got = va_file.op12_va_file_clusters(spark, sf_dir).collect()
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = brute(rows, 40, 5, 64)
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in got), key=str) == want
    assert {x.inertia for x in got} == {sum(x[2] for x in want)}
    for x in got:
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster)
