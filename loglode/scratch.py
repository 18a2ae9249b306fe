"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=None)
def _own(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-loglode-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; local mode (tests) may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _own(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs one task."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/loglode-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
