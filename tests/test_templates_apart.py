"""A leaf walked in shards gives the clusters of one walk, also where a late pattern changes an early one's turn."""

import random

from loglode.operators import templates as T


def test_shards_of_a_leaf_equal_one_walk(spark):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        kind = r.choice("aaab") if i < 900 else r.choice("aabc")
        words = [kind + str(j) for j in range(6)]
        for j in r.sample(range(6), r.choice([0, 1, 1, 2] if i < 1200 else [1, 2, 3])):
            words[j] = r.choice(["<*>", "a1", "b2", f"v{r.randrange(40)}"])
        rows.append((i * 7919 % 100_003, "leaf", words, f"{i % 3}", i, " ".join(words)))
    ordered = sorted(rows, key=lambda x: x[3:])
    for similarity in (0.55, 0.35):
        clusters, found = T.greedy_clusters([x[2] for x in ordered], similarity)
        first = {}
        for x, c in zip(ordered, clusters):
            first.setdefault(c, x[0])
        want = sorted((x[0], first[c], " ".join(found[c])) for x, c in zip(ordered, clusters))
        frame = spark.createDataFrame(rows, "id long, leaf string, tokens array<string>, sample_file string, sample_line long, pattern string")
        apart, rest = T._walked_apart(frame, similarity, 300, 5000)
        assert rest.isEmpty() and sorted(map(tuple, apart.collect())) == want and len(first) > 1
