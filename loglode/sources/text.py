"""Lines of text files with their numbers, without a shuffle of the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import line as L


def _relative(path, roots: list[str]):
    out = path
    for root in roots:
        prefix = root.rstrip("/") + "/"
        out = F.when(F.contains(path, F.lit(prefix)), F.substring_index(path, prefix, -1)).otherwise(out)
    return out


def read_log_lines(spark: SparkSession, paths: str | list[str], archive_id: str = "", log_files_only: bool = False) -> DataFrame:
    """archive_id, file_path (relative to its root), line_no (from 1) and content of every line below paths.

    .gz and .bz2 files are read as the logs they hold.  A line's number is its place in its split plus the number of
    lines in the file's earlier splits.  Only counts per split are aggregated; they are broadcast back while they are
    few, else joined by split, which has no hot key.  Both passes see the same splits, so keep files and spark.sql.files.maxPartitionBytes fixed; write the result once.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("recursiveFileLookup", "true").text(roots)
    raw = raw.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("fp"), F.col("_metadata.file_block_start").alias("bs"), F.monotonically_increasing_id().alias("mid"))
    blocks = raw.groupBy("fp", "bs").agg(F.min("mid").alias("m0"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fp").orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("fp", "bs", "m0", before.alias("base"))
    out = raw.join(blocks, ["fp", "bs"])
    path = F.url_decode(F.replace("fp", F.lit("+"), F.lit("%2B")))
    out = out.select(F.lit(archive_id).alias("archive_id"), _relative(path, roots).alias("file_path"), (F.col("base") + F.col("mid") - F.col("m0") + 1).alias("line_no"), "content")
    return out.where(L.is_log_file(F.col("file_path"))) if log_files_only else out


def read_lines(lines: DataFrame, file_path: str, start: int = 1, limit: int = 500) -> DataFrame:
    """A page of one file: line_no, content, and on every row has_more and total_lines. At most 5,000 lines."""
    start, limit = max(1, start), min(limit if limit > 0 else 500, 5000)
    file = lines.where(F.col("file_path") == file_path)
    total = file.agg(F.coalesce(F.max("line_no"), F.lit(0)).cast("long").alias("total_lines"))
    part = file.where(F.col("line_no").between(start, start + limit - 1)).crossJoin(F.broadcast(total))
    return part.select("line_no", "content", (F.col("total_lines") >= start + limit).alias("has_more"), "total_lines")
