"""Comparison of two scopes: files, severities, new fatal events and new templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import line as L
from ..schema import PreprocessRule
from .templates import masked_patterns, merge_templates


def scoped_files(files: DataFrame, sub: str = "") -> DataFrame:
    """Distinct paths under a sub-tree, relative to it."""
    return files.where(L.in_scope(F.col("file_path"), sub)).select(L.normalize_path(F.col("file_path"), sub).alias("path")).distinct()


def changed_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, path): 'added' paths are in b only, 'removed' ones in a only."""
    added = b.join(a, "path", "left_anti").select(F.lit("added").alias("change"), "path")
    return added.unionByName(a.join(b, "path", "left_anti").select(F.lit("removed").alias("change"), "path"))


def severity_by_side(events_a: DataFrame, events_b: DataFrame) -> DataFrame:
    """(severity, a, b, delta) over both sides."""
    count = lambda e, n: e.groupBy("severity").agg(F.count(F.lit(1)).alias(n))
    both = count(events_a, "a").join(count(events_b, "b"), "severity", "full_outer").na.fill(0, ["a", "b"])
    return both.select("severity", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def new_fatal_events(events_a: DataFrame, events_b: DataFrame, sub_a: str = "", sub_b: str = "") -> DataFrame:
    """FATAL and CRITICAL events of b whose (rule, relative path) a does not have."""
    known = events_a.select("rule_name", L.normalize_path(F.col("file_path"), sub_a).alias("norm_path")).distinct()
    b = events_b.where(F.col("severity").isin("FATAL", "CRITICAL")).withColumn("norm_path", L.normalize_path(F.col("file_path"), sub_b))
    return b.join(known, ["rule_name", "norm_path"], "left_anti")


def new_templates(patterns_a: DataFrame, patterns_b: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent patterns of b that a lacks and that are severe or seen twice."""
    fresh = patterns_b.join(patterns_a.select("pattern"), "pattern", "left_anti")
    return fresh.where(F.col("level").isin("ERROR", "FATAL") | (F.col("count") >= 2)).orderBy(F.desc("count"), "pattern").limit(limit)


def scope_type(archive_a: str, sub_a: str, archive_b: str, sub_b: str) -> str:
    if (archive_a, sub_a) == (archive_b, sub_b):
        raise ValueError("the two scopes are the same")
    return "intra_archive" if archive_a == archive_b else "inter_archive"


def summary(files: DataFrame, severities: DataFrame, fatal: DataFrame, fresh: DataFrame, kind: str) -> DataFrame:
    """One row: counts of all parts and a sentence."""
    one = files.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    one = one.crossJoin(severities.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("events_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("events_b")))
    one = one.crossJoin(fatal.agg(F.count(F.lit(1)).alias("new_fatal"))).crossJoin(fresh.agg(F.count(F.lit(1)).alias("new_templates")))
    text = F.format_string("%s: %d files added, %d removed; %d new fatal events; %d new templates.", F.lit(kind), "added", "removed", "new_fatal", "new_templates")
    return one.select("added", "removed", "events_a", "events_b", "new_fatal", "new_templates", F.lit(kind).alias("scope_type"), text.alias("summary_text"))


def diff(lines_a: DataFrame, events_a: DataFrame, lines_b: DataFrame, events_b: DataFrame, sub_a: str = "", sub_b: str = "", rules: Sequence[PreprocessRule] = (), kind: str = "inter_archive", head: int | None = None, merged: bool = False) -> dict[str, DataFrame]:
    """All parts of a comparison; head looks for new templates in that many lines of each file only.

    merged: templates are merged ones on both sides, else masked patterns; merging runs when this is called, all else is lazy.
    """
    scope = lambda df, sub: df.where(L.in_scope(F.col("file_path"), sub))
    lines = [(scope(x, s) if head is None else scope(x, s).where(F.col("line_no") <= head)) for x, s in ((lines_a, sub_a), (lines_b, sub_b))]
    files = changed_files(scoped_files(lines_a, sub_a), scoped_files(lines_b, sub_b))
    ea, eb = scope(events_a, sub_a), scope(events_b, sub_b)
    severities, fatal = severity_by_side(ea, eb), new_fatal_events(ea, eb, sub_a, sub_b)
    mined = [merge_templates(masked_patterns(x, rules)) if merged else masked_patterns(x, rules) for x in lines]
    fresh = new_templates(*mined)
    return {"files": files, "severities": severities, "new_fatal": fatal, "new_templates": fresh, "summary": summary(files, severities, fatal, fresh, kind)}
