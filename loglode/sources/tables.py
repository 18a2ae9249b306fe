"""Rule tables as data, and the two stores of a report."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PREPROCESS_RULES, RULES, PreprocessRule, Rule


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Fault rules of a JSON or Parquet table, which is small by nature, in order of id."""
    names = [c.split()[0] for c in RULES.split(", ")]
    rows = _read(spark, path, RULES).orderBy("id").collect()
    return [Rule(**{n: r[n] if r[n] is not None else (True if n in ("is_regex", "enabled") else "") for n in names}) for r in rows]


def load_preprocess_rules(spark: SparkSession, path: str) -> list[PreprocessRule]:
    """Mask and level rules in order of (ord, created_at)."""
    rows = _read(spark, path, PREPROCESS_RULES).orderBy("ord", "created_at").collect()
    return [PreprocessRule(r["type"] or "mask", r["pattern"] or "", r["replacement"] or "", r["enabled"] is not False, i, r["id"] or "") for i, r in enumerate(rows)]


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Glossary, workflow and noise rows: kind, name, step, patterns."""
    return _read(spark, path, "kind string, name string, step int, patterns array<string>")


MANIFEST = "archive_id string, run string, seq bigint"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The run that holds each archive now; a store that nobody has written to has none."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows.groupBy("archive_id").agg(F.max(F.struct("seq", "run")).alias("last")).select("archive_id", "last.run", "last.seq")


def enter_run(spark: SparkSession, path: str, run: str, archives: DataFrame) -> None:
    """One more manifest file, which Spark's commit renames into place: from now on the run holds these archives."""
    seq = (_manifest(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    archives.distinct().select("archive_id", F.lit(run).alias("run"), F.lit(seq).cast("bigint").alias("seq")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_report(events: DataFrame, reports: DataFrame, path: str) -> str:
    """Events and reports of a run, which replace those of its own archives at one instant; gives the run's name.

    Both tables go to a folder of the run, then one file joins the manifest, which Spark's commit renames into place:
    a run that fails before leaves what readers see as it was, and no reader meets new events beside an old report.
    An archive with a report and no events has none afterwards.  Of two runs at once the later entry counts, at equal
    numbers the greater name.
    """
    spark = events.sparkSession
    run = uuid.uuid4().hex
    for df, name in ((events, "events"), (reports, "reports")):
        df.sortWithinPartitions("archive_id").write.parquet(f"{path}/runs/{run}/{name}")
    read = [spark.read.schema(df.schema).parquet(f"{path}/runs/{run}/{name}") for df, name in ((events, "events"), (reports, "reports"))]
    enter_run(spark, path, run, read[0].select("archive_id").union(read[1].select("archive_id")))
    return run


def read_report(spark: SparkSession, path: str, archive_id: str) -> tuple[DataFrame, DataFrame]:
    """(events, reports) of one archive, both of the same run; an archive that was never written is a KeyError."""
    row = _manifest(spark, path).where(F.col("archive_id") == archive_id).first()
    if row is None:
        raise KeyError(archive_id)
    mine = F.col("archive_id") == archive_id
    return tuple(spark.read.parquet(f"{path}/runs/{row['run']}/{name}").where(mine) for name in ("events", "reports"))


def current_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, reports) of all archives, each of its last run."""
    now = _manifest(spark, path).select("archive_id", "run")
    runs = [r["run"] for r in now.select("run").distinct().collect()]  # a name a run that still counts
    if not runs:
        raise KeyError("the store is empty")
    name = F.regexp_extract("_metadata.file_path", "/runs/([0-9a-f]{32})/", 1)
    both = ("events", "reports")
    tables = [spark.read.parquet(*[f"{path}/runs/{r}/{kind}" for r in runs]).withColumn("run", name) for kind in both]
    return tuple(t.join(now, ["archive_id", "run"], "left_semi").drop("run") for t in tables)
