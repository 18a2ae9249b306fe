"""Running counts, sums and last values over keys of any size, in two levels.

Rows are dealt by ranges of (key, order), so one huge file or node is many partitions.  Each partition has one partial
result a key; these few rows are run over, and what came before is joined back to the rows of each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

PART = "_part"


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], counts: Sequence[str] = (), sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, parts: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """rows with new columns, over the rows of the same key in order (ascending, nulls first):

    counts: how many rows come before; sums: name -> column whose values before are added up (0 where none);
    lasts: name -> column whose last value up to and with this row is taken that is not null.
    within: columns by which counts and sums are kept apart inside a key, from the same ranges; lasts are the key's.
    Nulls in a key make a key of their own.  Rows that are equal in key and order lie in one partition, in any order.
    Runs when it is called.  parts: how many ranges; Spark's own choice by default.
    """
    sums, lasts = sums or {}, lasts or {}
    dealt = rows.repartitionByRange(*([parts] if parts else []), *key, *order).withColumn(PART, F.spark_partition_id())
    dealt = written(dealt, "ranges")
    value = lambda name: F.coalesce(F.sum(name), F.lit(0))
    adds = [F.count(F.lit(1)).alias("_n"), *[value(c).alias(f"_s_{n}") for n, c in sums.items()]]
    place = F.struct(*order)
    keeps = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_l_{n}") for n, c in lasts.items()]
    before = lambda keys: Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  # a row a range

    def offsets(keys: Sequence[str], aggs: list, over) -> DataFrame:
        """What came before each range: key columns as _k0, _k1, ..., the range as _p."""
        partial = dealt.groupBy(*keys, PART).agg(*aggs)
        return written(partial.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(PART).alias("_p"), *over(before(keys))), "offsets")

    added = lambda w: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ["_n", *[f"_s_{n}" for n in sums]]]
    kept = lambda w: [F.last(f"_l_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in lasts]
    if not within:
        found = [(key, offsets(key, [*adds, *keeps], lambda w: [*added(w), *kept(w)]))]
    else:
        found = [([*key, *within], offsets([*key, *within], adds, added))] if counts or sums else []
        found += [(key, offsets(key, keeps, kept))] if lasts else []
    inside = Window.partitionBy(PART, *key).orderBy(*order)  # no more than one range
    apart = Window.partitionBy(PART, *key, *within).orderBy(*order)
    earlier, so_far = apart.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select(
        "*", *[F.count(F.lit(1)).over(earlier).alias(f"_c_{n}") for n in counts], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(so_far).alias(f"_j_{n}") for n, c in lasts.items()],
    )
    for keys, offset in found:
        same = F.col(PART) == F.col("_p")
        for i, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(offset, same).drop("_p", *[f"_k{i}" for i in range(len(keys))])
    return out.select(
        *rows.columns, *[(F.col("_n") + F.col(f"_c_{n}")).alias(n) for n in counts], *[(F.col(f"_s_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_j_{n}", f"_l_{n}").alias(n) for n in lasts],
    )
