"""File catalogs: sizes, trees, sub-archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import line as L


def file_catalog(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per file line_count, with size and mod_time where sizes (archive_id, file_path, size, mod_time) gives them."""
    out = lines.groupBy("archive_id", "file_path").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.octet_length("content") + 1).alias("text_bytes"))
    return out if sizes is None else out.join(sizes, ["archive_id", "file_path"], "left")


def file_sizes(spark: SparkSession, path: str, archive_id: str = "") -> DataFrame:
    """archive_id, file_path, size, mod_time of all files below path, from metadata alone."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.substring_index("path", path.rstrip("/") + "/", -1)
    return raw.select(F.lit(archive_id).alias("archive_id"), rel.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))


def archive_totals(files: DataFrame) -> DataFrame:
    """Files and lines per archive. An unterminated last line counts, directories do not."""
    return files.groupBy("archive_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("total_lines"))


def list_children(files: DataFrame, directory: str = "") -> DataFrame:
    """Direct children: name, is_directory, size, child_count; dot names hidden; directories first, then by name."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("file_path"), len(prefix) + 1, 1 << 30)
    rows = files.where(F.col("file_path").startswith(prefix)).select(rest.alias("rest"), "size")
    rows = rows.select(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"), F.contains("rest", F.lit("/")).alias("deep"), F.split_part("rest", F.lit("/"), F.lit(2)).alias("next"), "size")
    rows = rows.where((F.col("name") != "") & ~F.col("name").startswith("."))
    per_child = rows.groupBy("name", "next").agg(F.bool_or("deep").alias("deep"), F.sum("size").alias("size"))
    out = per_child.groupBy("name").agg(F.bool_or("deep").alias("is_directory"), F.sum("size").alias("size"), F.count_if(F.col("deep") & ~F.col("next").startswith(".")).alias("child_count"))
    return out.orderBy(F.desc("is_directory"), "name")


def detect_sub_archives(files: DataFrame) -> DataFrame:
    """Top-level folders with total_files, total_size and has_nested, by name.

    Where the only top folder holds two folders or more, those are taken instead.
    """
    part = F.split("file_path", "/")
    rows = files.select(part.alias("p"), "size").where((F.size("p") > 1) & ~F.get("p", F.lit(0)).startswith("."))
    seconds = rows.where((F.size("p") > 2) & ~F.get("p", F.lit(1)).startswith(".")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b")).distinct()
    tops = rows.select(F.get("p", F.lit(0)).alias("a")).distinct()
    wrap = tops.agg(F.count(F.lit(1)).alias("n_top")).crossJoin(seconds.agg(F.count(F.lit(1)).alias("n_sub"))).select((F.expr("n_top = 1 AND n_sub >= 2")).alias("down"))
    rows = rows.crossJoin(F.broadcast(wrap))
    rows = rows.where(~F.col("down") | ((F.size("p") > 2) & ~F.coalesce(F.get("p", F.lit(1)), F.lit("")).startswith(".")))
    name = F.when(F.col("down"), F.get("p", F.lit(1))).otherwise(F.get("p", F.lit(0)))
    path = F.when(F.col("down"), F.concat_ws("/", F.get("p", F.lit(0)), F.get("p", F.lit(1)))).otherwise(F.get("p", F.lit(0)))
    nested = F.size("p") > F.when(F.col("down"), 3).otherwise(2)
    return rows.groupBy(name.alias("name"), path.alias("path")).agg(F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_size"), F.bool_or(nested).alias("has_nested")).orderBy("name")


def filter_tree(files: DataFrame, query: str) -> DataFrame:
    """(path, is_directory): entries whose path holds the query, with all folders above them."""
    parts = F.split("file_path", "/")
    every = files.select("file_path").distinct().select("file_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), F.size(parts).alias("all"))
    nodes = every.select(F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.col("n")), "/").alias("path"), (F.col("n") < F.col("all")).alias("is_directory"))
    nodes = nodes.groupBy("path").agg(F.bool_or("is_directory").alias("is_directory"))
    hits = nodes.where(F.lower("path").contains(query.lower()))
    p = F.split("path", "/")
    above = hits.select(F.explode(F.sequence(F.lit(1), F.size(p))).alias("n"), p.alias("p"), "is_directory")
    found = above.select(F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("path"), ((F.col("n") < F.size("p")) | F.col("is_directory")).alias("is_directory"))
    return found.groupBy("path").agg(F.bool_or("is_directory").alias("is_directory"))


def consolidate_rotated(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Parts of rotated logs as one file prefix/prefix, in time order, with new line numbers.

    names: (archive_id, file_path, original) where original is the name before decompression.  In folders that hold a
    .gz or .bz2 file, files that share the text before the first dot of their name, with at least one compressed
    among them, are one log.  Parts go by the time of the first of their first five lines that has one, else by
    number.  Only part counts pass through windows; lines keep their place and add an offset.
    """
    folder = F.when(F.contains("file_path", F.lit("/")), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    base = F.substring_index("file_path", "/", -1)
    n = names.withColumn("folder", folder).withColumn("prefix", L.prefix_before_dot(base)).withColumn("packed", F.lower("original").rlike(r"\.(gz|bz2)$"))
    logs = n.groupBy("archive_id", "folder", "prefix").agg(F.bool_or("packed").alias("rotated"))
    n = n.join(logs, ["archive_id", "folder", "prefix"])
    scored = lines.where("line_no <= 5").withColumn("score", L.start_score(F.col("content"))).where("score IS NOT NULL")
    scored = scored.groupBy("archive_id", "file_path").agg(F.min_by("score", "line_no").alias("score"))
    counts = lines.groupBy("archive_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(counts, ["archive_id", "file_path"]).join(scored, ["archive_id", "file_path"], "left")
    n = n.withColumn("score", F.coalesce("score", L.fallback_score(F.col("file_path"))))
    w = Window.partitionBy("archive_id", "folder", "prefix").orderBy("score", "file_path").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("base", F.when(F.col("rotated"), F.coalesce(F.sum("n").over(w), F.lit(0))).otherwise(0))
    merged = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), "prefix", F.lit("/"), "prefix")
    target = n.select("archive_id", "file_path", F.when(F.col("rotated"), merged).otherwise(F.col("file_path")).alias("target"), "base")
    out = lines.join(target, ["archive_id", "file_path"])
    return out.select("archive_id", F.col("target").alias("file_path"), (F.col("line_no") + F.col("base")).alias("line_no"), "content")
