"""Operator 7: quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics come from whole texts.  A document fails the base rule with fewer than 50 words or with over half of
its words in repeated 3-word windows.  The others are described by four transformed statistics (log of the mean word
length; arcsine square roots of the shares of symbols, duplicate lines and repeated words).  For each language and
source the minimum covariance determinant is approached by concentration steps: from medians and absolute deviations,
then again and again from the mean and covariance of the `share` of documents nearest so far.  Documents beyond the
chi-square `tail` of the Mahalanobis distance are rejected.

A language and source with fewer than `least` documents is pooled with the other small sources of its language, and
small languages with each other; a pool below ten documents rejects nothing.  A variance floor keeps a statistic that
is constant in a group from rejecting everything that differs.  Quantiles are approximate (`percentile_approx`, error
below 1/10,000 of the group's rows), so every group is aggregated in bounded memory and combined before the shuffle.

Null and empty texts have no words and fail the base rule.  Null languages and sources are groups of their own.  Rows
that share a doc_id are rows of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, written

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FLOOR = 0.05
SALTS = 16  # a group's rows meet its parameters under so many keys, so a group with a third of all rows is no single task
X = ("x1", "x2", "x3", "x4")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", "[ \\t-\\r]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0).alias("lines"),
        F.length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "doc_id", "lang", "source", "words", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
    )
    # A window is one long: its hash above, its place in the lowest bits; sorting brings equal windows together.
    grams = "sort_array(transform(sequence(0, size(words) - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | i))"
    d = d.withColumn("grams", F.when(F.col("n_words") >= 3, F.expr(grams)).otherwise(F.array().cast("array<bigint>")))
    place = "cast({} & (shiftleft(1L, bits) - 1) as int)"
    same = "(shiftright({0}, bits) = shiftright({1}, bits) AND get(words, {2}) = get(words, {3}) AND get(words, {2} + 1) = get(words, {3} + 1) AND get(words, {2} + 2) = get(words, {3} + 2))"
    with_ = lambda other: f"coalesce({same.format('x', other, place.format('x'), place.format(other))}, false)"
    again = f"filter(grams, (x, i) -> {with_('get(grams, i - 1)')} OR {with_('get(grams, i + 1)')})"
    d = d.withColumn("again", F.expr(f"sort_array(transform({again}, x -> {place.format('x')}))"))
    covered = "aggregate(again, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.e, p), 'e', p + 3), a -> a.n)"
    d = d.withColumn("n_repeat_words", F.expr(covered))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", failed.alias("base_failed"))


def _chi2(x: float, half: int) -> float:
    """Distribution function of chi-square with 2*half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))


def _chi2_quantile(p: float, half: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, half) < p else (lo, mid)
    return hi


def _share_root(part: Column, whole: Column) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))


def _salted(rows: DataFrame, *key: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))


def _grouped(stats: DataFrame, least: int) -> DataFrame:
    """stats with `g`, the group whose estimate applies (language and source, else small sources of the language, else
    the rest), and `g_rows`, its number of rows."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = _salted(stats.withColumn("l", name("lang")).withColumn("s", name("source")), "doc_id", "n_words")
    sizes = written(rows.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small = sizes.where(F.col("n") < least).groupBy("l").agg(F.sum("n").alias("pool"))
    sizes = sizes.join(small, "l", "left")
    pooled = F.when(F.col("pool") >= least, F.concat(F.lit("pool "), F.col("l"))).otherwise(F.lit("rest"))
    sizes = sizes.select("l", "s", "n", F.when(F.col("n") >= least, F.concat_ws(" ", F.lit("group"), "l", "s")).otherwise(pooled).alias("g"))
    sizes = sizes.withColumn("g_rows", F.sum("n").over(Window.partitionBy("g"))).drop("n")
    return _join(rows, written(sizes, "groups"), "l", "s").drop("l", "s", "salt")


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """Means and the Cholesky factor of the (floored) covariance of each group, entry by entry."""
    out = moments
    for i in range(4):
        for j in range(i + 1):
            inner = F.col(f"c{j}{i}") * scale + (FLOOR**2 if i == j else 0.0)
            for k in range(j):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(FLOOR**4))) if i == j else inner / F.col(f"l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i in range(4) for j in range(i + 1)])


def _join(rows: DataFrame, parameters: DataFrame, *key: str) -> DataFrame:
    """rows (with the key and a salt) beside the parameters of their group."""
    return rows.join(parameters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"])


def _distance(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution."""
    out = _join(rows, factor, "g")
    for i in range(4):
        inner = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            inner = inner - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", inner / F.col(f"l{i}{i}"))
    return out.select(*rows.columns, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 4)), F.col("z0") * F.col("z0")).alias("d2"))


def mcd_distances(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """rows (g, x1..x4 and others) with d2, the robust squared distance within g."""
    rows = written(_salted(rows, *rows.columns), "rows")
    median = [F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(X)]
    centre = written(rows.groupBy("g").agg(*median), "centre")
    away = _join(rows, centre, "g").select("g", *[F.abs(F.col(x) - F.col(f"m{i}")).alias(x) for i, x in enumerate(X)])
    spread = away.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"c{i}{i}") for i, x in enumerate(X)])
    spread = spread.select("g", *[(F.pow(F.col(f"c{i}{i}") * 1.4826, F.lit(2))).alias(f"c{i}{i}") for i in range(4)])
    start = centre.join(spread, "g").withColumns({f"c{j}{i}": F.lit(0.0) for i in range(4) for j in range(i)})
    factor = written(_factor(start, 1.0), "factor")
    reach = _chi2_quantile(share, 2)
    consistent = share / _chi2(reach, 3)
    for _ in range(steps):
        # Parameters are written, so that Spark knows how small they are before it plans the join.
        far = written(_distance(rows.select("g", "salt", *X), factor), "distances")
        near = written(far.groupBy("g").agg(F.percentile_approx("d2", share, 10_000).alias("q")), "nearest")
        core = _join(far, near, "g").where(F.col("d2") <= F.col("q"))
        means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
        covs = [F.covar_pop(X[j], X[i]).alias(f"c{j}{i}") for i in range(4) for j in range(i + 1)]
        factor = written(_factor(core.groupBy("g").agg(*means, *covs), consistent), "factor")
        delete(far)
    return _distance(rows, factor).drop("salt")


def quality_rules(docs: DataFrame, share: float = 0.75, steps: int = 3, tail: float = 1e-4, least: int = 50) -> DataFrame:
    """Base statistics of every document with base_failed, d2 (null where no estimate applies), kept, and estimate (whose)."""
    stats = written(base_statistics(docs), "statistics")
    passed = stats.where(~F.col("base_failed")).withColumns({
        "x1": F.log(F.col("word_chars") / F.col("n_words")),
        "x2": _share_root(F.col("n_symbols"), F.col("word_chars")),
        "x3": _share_root(F.col("n_dup_lines"), F.col("n_lines")),
        "x4": _share_root(F.col("n_repeat_words"), F.col("n_words")),
    })
    rows = written(_grouped(passed, least), "grouped")
    judged = mcd_distances(rows.where("g_rows >= 10"), share, steps)
    alone = rows.where("g_rows < 10").withColumn("d2", F.lit(None).cast("double"))
    cut = _chi2_quantile(1 - tail, 2)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = judged.unionByName(alone).select(*names, "d2", (F.col("d2").isNull() | (F.col("d2") <= cut)).alias("kept"), F.col("g").alias("estimate"))
    bad = stats.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"), F.lit(None).cast("string").alias("estimate"))
    return good.unionByName(bad)


def op7_mcd_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("d2")
