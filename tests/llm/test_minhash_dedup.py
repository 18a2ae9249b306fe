"""Operator 11 against brute force, and links inside large buckets of texts with the same boilerplate."""

import random

import pytest

from loglode.llm import minhash_dedup, near_copies

from .test_near_copies import grams, near_rows
from .test_operators import frame


def brute(rows, hundredths=85):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_equals_brute_force(spark):
    rows = near_rows() + [(3000, " \t\n"), (3001, "ABC d"), (3002, "abc D"), (3003, "Éa b c d e f g"), (3004, "éa b c d e f g"), (None, None)]
    got = minhash_dedup.minhash_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert minhash_dedup.minhash_components(frame(spark, near_rows()[:1]).where("false")).collect() == []


def boilerplate(common, own, pairs=300, seed=5):
    """Pairs at Jaccard 0.806 of each other, at common / (common + 2 own) to all others."""
    r, rows = random.Random(seed), []
    word = lambda: f"w{r.randrange(10**9)}"
    shared = [word() for _ in range(common + 4)]
    n = common + own
    alike = round(2 * n * 0.806 / 1.806)  # shingles that the two of a pair share
    for i in range(pairs):
        mine = [word() for _ in range(alike - common)]
        for k in range(2):
            rows.append((2 * i + k, " ".join(shared + mine + [word() for _ in range(n - alike)])))
    return rows


@pytest.mark.parametrize("common, own", [(1723, 277), (1642, 358)])
def test_no_pair_is_lost_in_a_crowd(spark, common, own):
    rows = boilerplate(common, own)
    a, b, c = (grams(rows[k][1]) for k in (0, 1, 2))
    assert 0.8 <= len(a & b) / len(a | b) < 0.81 and len(a & c) / len(a | c) == pytest.approx(common / (common + 2 * own))
    got = {x.doc_id: x.component_id for x in near_copies.near_copy_components(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_prefixes_miss_no_pair(spark):
    """Sets of many sizes over few shingles, which meet by prefixes alone."""
    r = random.Random(8)
    sets = [sorted(r.sample(range(60), r.randrange(1, 50))) for _ in range(250)]
    sets += [sorted(set(s) ^ {r.randrange(60)}) for s in sets]
    data = [(k, len(s), s, k % 7) for k, s in enumerate(sets) if s]
    df = spark.createDataFrame(data, "key long, n long, shingles array<long>, label long")
    lows = {k: near_copies.planes(near_copies.lowest(near_copies.mix(near_copies.np.array(s, "u8")))) for k, _, s, _ in data}
    planes = spark.createDataFrame([(k, p.view("i8").tolist()) for k, p in lows.items()], "key long, planes array<long>")
    got = {(x.a, x.b) for x in near_copies.prefix_pairs(df.select("key", "shingles"), df.drop("shingles").join(planes, "key"), 0.8).collect()}
    by = {k: (set(s), label) for k, _, s, label in data}
    for a in by:
        for b in by:
            (x, p), (y, q) = by[a], by[b]
            if a < b and p != q and 1.8 * len(x & y) >= 0.8 * (len(x) + len(y)) - 1e-9:
                assert (a, b) in got
