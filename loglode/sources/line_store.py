"""A stored table of lines, sorted so that a page reads the row groups it lies in and nothing else.

Lines go to range partitions of (archive, file, line), so one huge file is many tasks and many output files; within each
they are sorted and written in small row groups, whose statistics Spark's reader prunes by.  Beside them stands the number
of lines of each file, so a page never counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _manifest, enter_run

PLACE = ["archive_id", "file_path", "line_no"]
COUNTS = "archive_id string, file_path string, total_lines bigint"


def write_lines(lines: DataFrame, path: str, parts: int | None = None, group_bytes: int = 8 << 20, page_rows: int = 2000) -> str:
    """Lines of one or more archives, which replace those archives' earlier ones at one instant; gives the run's name.

    lines is read twice, once for a sample of its ranges; give a written table if it is dear.  Lines with a null archive,
    file or number are kept in the table but belong to no page.  parts is the number of ranges, Spark's own if not given.
    A failed run leaves the store as it was: only the manifest's entry, which comes last, makes a run count.
    """
    spark, run = lines.sparkSession, uuid.uuid4().hex
    rows = lines.select(*PLACE, "content")
    rows = rows.repartitionByRange(*([parts] if parts else []), *PLACE).sortWithinPartitions(*PLACE)
    here = f"{path}/runs/{run}"
    rows.write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).parquet(f"{here}/lines")
    back = spark.read.schema(rows.schema).parquet(f"{here}/lines")
    counts = back.groupBy("archive_id", "file_path").agg(F.coalesce(F.max("line_no"), F.lit(0)).cast("bigint").alias("total_lines"))
    counts.repartitionByRange("archive_id", "file_path").sortWithinPartitions("archive_id", "file_path").write.parquet(f"{here}/counts")
    enter_run(spark, path, run, spark.read.schema(COUNTS).parquet(f"{here}/counts").select("archive_id"))
    return run


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of all archives, each of the run that holds it now."""
    now = _manifest(spark, path).select("archive_id", "run")
    runs = [r["run"] for r in now.select("run").distinct().collect()]  # a name a run that still counts
    if not runs:
        raise KeyError("the store is empty")
    rows = spark.read.parquet(*[f"{path}/runs/{r}/{kind}" for r in runs])
    if len(runs) == 1:
        return rows
    rows = rows.withColumn("run", F.regexp_extract("_metadata.file_path", "/runs/([0-9a-f]{32})/", 1))
    on = rows["archive_id"].eqNullSafe(now["archive_id"]) & (rows["run"] == now["run"])
    return rows.join(now, on, "left_semi").drop("run")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines (LINES), as any operator takes them."""
    return _table(spark, path, "lines")


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """archive_id, file_path, total_lines (the greatest number) of every file."""
    return _table(spark, path, "counts")


def read_stored(spark: SparkSession, path: str, archive_id: str, file_path: str, start: int = 1, limit: int = 500) -> DataFrame:
    """A page as text.read_lines gives it, sorted; an archive that the store does not hold is a KeyError.

    Both tables are asked for by equality and range, which prunes row groups and pages before anything is decoded.
    A file that the archive does not have gives no rows.
    """
    row = _manifest(spark, path).where(F.col("archive_id") == archive_id).first()
    if row is None:
        raise KeyError(archive_id)
    start, limit = max(1, start), min(limit if limit > 0 else 500, 5000)
    mine = (F.col("archive_id") == archive_id) & (F.col("file_path") == file_path)
    here = f"{path}/runs/{row['run']}"
    total = next((r["total_lines"] for r in spark.read.parquet(f"{here}/counts").where(mine).take(1)), 0)
    part = spark.read.parquet(f"{here}/lines").where(mine & F.col("line_no").between(start, start + limit - 1))
    return part.orderBy("line_no").select("line_no", "content", F.lit(total >= start + limit).alias("has_more"), F.lit(total).cast("bigint").alias("total_lines"))
