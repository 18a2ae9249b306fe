"""Template merging in parts against a plain walk, and one leaf of very many patterns."""

import random

import pytest
from pyspark.sql import functions as F

from loglode.operators import templates

from .test_operators import lines_of, plain_templates


def texts(seed, n):
    """Patterns of few leaves: families that differ in a few places, some with numbers, some mostly variable."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        family = r.randrange(12)
        words = [f"f{chr(97 + family)}w{chr(97 + i)}" for i in range(r.choice([5, 6]))]
        for i in r.sample(range(len(words)), r.randrange(4)):
            words[i] = r.choice(["", "x", "y", "z"]) + (r.choice("abcdefgh") if r.random() < 0.7 else str(r.randrange(10**6)))
        words = [str(r.randrange(100)) if r.random() < (0.6 if family == 0 else 0.05) else w for w in words]
        out.append(" ".join(["disk", "unit", "at", *words]))
    return out


@pytest.mark.parametrize("seed, similarity", [(1, 0.55), (2, 0.8), (3, 0.35)])
def test_parts_equal_a_plain_walk(spark, seed, similarity):
    masked = templates.masked_patterns(lines_of(spark, "\n".join(texts(seed, 500))))
    rows = [(x.pattern, x["count"]) for x in masked.orderBy("sample_file", "sample_line").collect()]
    want = plain_templates(rows, similarity)
    for limit in (10_000, 1):
        got = templates.merge_templates(masked, similarity, leaf_limit=limit).collect()
        assert sorted((x.pattern, x["count"]) for x in got) == want and len(want) < len(rows)


def test_parts_are_independent_and_many(spark):
    r = random.Random(9)
    rows = [(k, "leaf", [f"{k % 40}{chr(97 + i)}" if r.random() < 0.8 else f"{k}{i}" for i in range(8)]) for k in range(400)]
    part = {x.id: x.part for x in templates.leaf_parts(spark.createDataFrame(rows, "id long, leaf string, tokens array<string>"), pair_limit=4).collect()}
    for a, _, x in rows:
        for b, _, y in rows[:a]:
            if sum(p == q for p, q in zip(x, y)) / 8 >= 0.55:
                assert part[a] == part[b]
    assert len(set(part.values())) >= 40


def test_a_leaf_of_200000_patterns(spark):
    """40,000 families of five patterns in one leaf: many parts, one cluster a family."""
    n, spelt = 200_000, lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    one = spelt(F.expr("id % 40000"))
    tokens = F.array(F.lit("job"), F.lit("was"), F.lit("run"), F.concat(F.lit("p"), one), F.concat(F.lit("q"), one), F.concat(F.lit("r"), one), F.concat(F.lit("s"), spelt(F.col("id"))), F.concat(F.lit("t"), one), F.concat(F.lit("u"), one))
    masked = spark.range(0, n, 1, 8).select(
        F.array_join(tokens, " ").alias("pattern"), F.lit(1).cast("long").alias("count"), F.lit("INFO").alias("level"), F.lit(1).alias("priority"), F.lit("s").alias("sample"), F.lit("f").alias("sample_file"),
        F.col("id").alias("sample_line"), F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), F.lit("f").alias("last_file"), F.col("id").alias("last_line"), F.array(F.lit("f")).alias("files"),
    )
    got = templates.merge_templates(masked)
    assert got.agg(F.count(F.lit(1)), F.sum("count"), F.min("count"), F.max("count"), F.count_if(F.col("pattern").rlike(r"<\*> t[a-j]+ u[a-j]+$"))).first()[:] == (40_000, n, 5, 5, 40_000)


def test_equal_places_and_empty_table(spark):
    masked = templates.masked_patterns(lines_of(spark, "a b c d\na b c e"))
    tied = masked.withColumn("sample_line", F.lit(1).cast("long"))
    assert [x.pattern for x in templates.merge_templates(tied).collect()] == ["a b c <*>"]
    assert templates.merge_templates(masked.where("false")).collect() == []
