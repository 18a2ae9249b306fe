"""Operator 3: packing into optimal length buckets.

The histogram of token counts of the whole corpus (rounded up to `multiple`) goes through dynamic programming that
chooses at most `buckets` boundaries with the least padding.  Inside each bucket, batches form that hold as many rows
as the token budget allows at the bucket's length.  A bucket is dealt over shards by a hash of doc_id, so that a
bucket with a third of all rows is no single task; each shard closes its own batches.

Null and empty texts have one token, the end id.  A document longer than the budget is a batch of its own and is
never cut.  Rows that share a doc_id are packed as rows of their own; a null doc_id is packed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, tokenizer_path


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) with the end id counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for t in batches:
            n = [c + 1 for _, c, _ in pieces.encode_all(t["text"], ids=False)]
            yield pa.record_batch([t["doc_id"], pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def rounded(n, multiple: int = 8):
    """Lengths up to 65,536 round up to `multiple`, longer ones to 1,024: this bounds the histogram."""
    step = F.when(n <= 65_536, F.lit(multiple)).otherwise(F.lit(1_024))
    return (F.ceil(n / step) * step).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds (a subset of the ascending lengths) with the least padding, by dynamic programming.

    The best last cut never moves left as lengths are added, so each layer is solved by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i])
            at = int(np.argmin(cost))
            new[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        cuts.append(cut)
        best = new
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(counts: DataFrame, budget: int = 32_768, buckets: int = 16, multiple: int = 8, rows_per_shard: int = 8_192) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch_id, slot, batch_rows of every row of counts (doc_id, n_tokens)."""
    sized = counts.withColumn("size", rounded(F.col("n_tokens"), multiple))
    histogram = sorted((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, n = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    bounds = optimal_bounds(lengths, n, buckets)
    inside = np.diff(np.concatenate([[0], np.searchsorted(lengths, bounds, side="right")])) if bounds else []
    ends = np.cumsum(inside)
    shards = [max(1, -(-int(n[e - w : e].sum()) // rows_per_shard)) for e, w in zip(ends, inside)]
    bucket = shard_of = F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("size") <= bounds[i], F.lit(i)).otherwise(bucket)
        shard_of = F.when(F.col("size") <= bounds[i], F.lit(shards[i])).otherwise(shard_of)
    padded = F.lit(None).cast("long") if not bounds else F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    rows = sized.select("doc_id", "n_tokens", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens"), shard_of).alias("shard"))
    rows = rows.withColumn("padded_to", padded).withColumn("capacity", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_to"))).cast("int"))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("bucket", "shard")))
    number = F.floor(F.col("at") / F.col("capacity"))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "padded_to",
        F.concat_ws("-", F.col("bucket").cast("string"), F.col("shard").cast("string"), number.cast("string")).alias("batch_id"),
        F.pmod("at", "capacity").alias("slot"),
        F.least(F.col("capacity"), F.col("total") - number * F.col("capacity")).cast("long").alias("batch_rows"),
    )


def op3_length_buckets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(token_counts(docs, tokenizer_path()), "counts"))
