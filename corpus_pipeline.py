"""The training-data pipeline: toxicity, SimHash near-duplicates, suffix-array repeats, decontamination, packing.

Each stage works on all its predecessor kept, written as Parquet and reread; all but the last return the columns of
`documents`; other columns are left out.  Nulls, empty and repeated texts and empty tables go through every stage: a
text without words is not toxic, is a SimHash copy of others like it, has no repeats or test items, and packs as one
token.
"""

from __future__ import annotations

import functools
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.llm.common import bucketed, delete_path, recorded_scratch, scratch_path, written
from loglode.llm.decontaminate import contaminated
from loglode.llm.near_copies import near_copy_components
from loglode.llm.packing import pack, token_counts
from loglode.llm.simhash import simhash_components
from loglode.llm.suffix_dedup import suffix_dedup
from loglode.llm.tokens import tokenizer_path
from loglode.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


class _Chain(threading.local):
    """The stages called last in this thread, one after another: what they left in the shared folder, and when the last returned."""

    at, left, returned_ms = -1, (), 0


_chain = _Chain()


def _follows(spark: SparkSession, docs: DataFrame, at: int) -> bool:
    """Is docs what the stage before `at` returned in this thread, written by the caller since?  Its files are younger."""
    files = docs.inputFiles() if at and _chain.at == at - 1 else []
    if not files:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() >= _chain.returned_ms


def stage(at: int):
    """The stage at that place of STAGES.  When the written result of the stage before comes in, that stage's scratch
    tables go; tables of other runs, threads and results are never touched."""

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if _follows(spark, docs, at):
                for path in _chain.left:
                    delete_path(spark, path)
            with recorded_scratch() as left:
                out = f(spark, docs, sf_dir)
            _chain.at, _chain.left, _chain.returned_ms = at, tuple(left), int(time.time() * 1000)
            return out

        return run_stage

    return wrap


def numbered_rows(docs: DataFrame) -> DataFrame:
    """COLUMNS and `row`, a number for each row, bucketed by it in the shared folder: joins by row leave the texts where
    they lie."""
    return bucketed(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "row", "numbered")


@stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=["lang", "source", "n_chars"]).where("NOT toxic").select(COLUMNS)


@stage(1)
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document stays, then of each component of near copies: the one with the smallest
    doc_id (rows without one come last), or any one of those that share it.

    Two bits of 64 reach little beyond almost equal texts, and at the dozen or more bits of similarity 0.8 the pivot
    table tells nothing apart; so what SimHash leaves is searched by minima of five-word shingles.
    """
    numbered = numbered_rows(docs)
    rows = numbered.select(F.col("row").alias("doc_id"), "text")
    kept = _first_of_each(simhash_components(rows), numbered)
    near = written(near_copy_components(rows, kept=kept), "near")
    gone = near.select(F.col("doc_id").alias("row")).join(_first_of_each(near, numbered), "row", "left_anti")
    return numbered.join(kept, "row", "left_semi").join(gone, "row", "left_anti").select(COLUMNS)


def _first_of_each(components: DataFrame, numbered: DataFrame) -> DataFrame:
    """The row of each component that stays."""
    ids = components.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc_id"), "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return written(first.select("first.row"), "first")


@stage(2)
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 250 bytes that start elsewhere too are cut out; a character that is cut in two goes whole.

    250 bytes are less than 50 words of any usual text, so a passage of over 50 words that repeats is found.
    """
    cut = suffix_dedup(docs, window=250, gram=200).where("n_removed > 0").select("doc_id", "text_sha256", "kept_text").dropDuplicates(["doc_id", "text_sha256"])
    cut = cut.withColumnsRenamed({"doc_id": "cut_id"})
    rows = docs.select(COLUMNS).withColumn("sha", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    joined = rows.join(cut, (F.col("sha") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    length = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return joined.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", length.alias("n_chars"))


@stage(3)
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and rows that share their doc_id (or have none, as they) with them."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("found")).distinct()
    return docs.select(COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("found")), "left_anti").select(COLUMNS)


@stage(4)
def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches inside optimal length buckets."""
    return pack(written(token_counts(docs, tokenizer_path()), "counts"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: Classifiers, MinHash and the columnwise index are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what earlier stages kept is removed as soon as the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := f"{scratch_path(spark, 'stage')}-kept")
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                delete_path(spark, before)
            before = path
    return docs
