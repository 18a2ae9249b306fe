"""Operator 11: MinHash near-duplicates with universal hash minima, bands, verified links, and alternating stars.

The search is near_copies.py's: a document's set of five-word shingles is described by 128 minima, documents that share
a band of four are candidates, bytes of all minima rule out most of them, full sets confirm the rest, and
components.py joins the links.  Copies with equal sets are one member of the search.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing.  A null doc_id links
but is never a component's id unless all ids of the component are null, and then counts as kept.  Rows that share a
doc_id are separate rows with that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES
from .near_copies import near_copy_components

SPACE = "".join(chr(i) for i in range(256) if SPACES[i])


def minhash_components(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (is it that document?)."""
    found = near_copy_components(docs, threshold)
    blank = docs.where(F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE)) == "")
    alone = blank.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
