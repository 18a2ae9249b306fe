"""Rule diagnosis: every enabled rule on every line in one narrow pass, then small summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import line as L
from ..schema import Rule
from ..scratch import written
from .gram_index import FOLD, cover_of, text_plan, texts_of

FEW, MOST = 16, 500  # strings for which one automaton is cheaper than each rule's regex


def rule_test(content: Column, rule: Rule) -> Column:
    """The rule's pattern as a constant expression; literals fold ASCII case; a bad regex is taken literally."""
    if rule.is_regex:
        try:
            re.compile(rule.pattern)
            return content.rlike(rule.pattern)
        except re.error:
            pass
    return L.contains_fold(content, rule.pattern)


def rule_scopes(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(archive_id, file_path, allowed): numbers of the rules whose path pattern takes the file in."""
    allowed = [F.when(L.match_file_path(r.file_path_pattern, F.col("file_path")), F.lit(i)) for i, r in enumerate(rules)]
    return files.select("archive_id", "file_path").distinct().withColumn("allowed", F.array_compact(F.array(*allowed)))


def _guard(content: Column, rules: Sequence[Rule]) -> Column:
    """One regex of all patterns: it cannot change results, only skip lines that no rule matches."""
    parts = []
    for r in rules:
        try:
            re.compile(r.pattern)
            parts.append(f"(?:{r.pattern})" if r.is_regex else f"(?i:{L._quoted(r.pattern)})")
        except re.error:
            parts.append(f"(?i:{L._quoted(r.pattern)})")
    return content.rlike("|".join(parts))


def certain_strings(rules: Sequence[Rule]) -> list[str]:
    """Strings, A-Z lower-cased, of which every line has one that some rule matches; none if a rule is certain of nothing."""
    ways = []
    for r in rules:
        try:
            re.compile(r.pattern)
            plan = text_plan(r.pattern) if r.is_regex else texts_of({r.pattern.translate(FOLD)})
        except re.error:
            plan = texts_of({r.pattern.translate(FOLD)})
        ways.append(cover_of(plan))
    return sorted(set().union(*ways)) if all(ways) else []


def _with_any(rows: DataFrame, strings: Sequence[str]) -> DataFrame:
    """Rows whose content has one of strings, without regard to case: one automaton, one step a byte however many there are."""
    pattern = "|".join(map(re.escape, strings))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.match_substring_regex(b.column("content"), pattern, ignore_case=True))

    return rows.mapInArrow(keep, rows.schema)


def scan_rules(lines: DataFrame, rules: Sequence[Rule], guard: bool = False) -> DataFrame:
    """One event per (line, rule): constant patterns in one pass over lines, never a product with a rule table.

    The path scope is part of each test: the path is constant over a file's lines and its regex is cheap.  Where the rules
    stand for many strings (FEW to MOST), lines without any of them are left out before the tests, which changes no result.
    """
    rules = [r for r in rules if r.enabled and r.pattern]
    text = F.trim("content")
    rows = lines.select("archive_id", "file_path", "line_no", "content").where(text != "")
    strings = certain_strings(rules)
    if FEW <= len(strings) <= MOST:
        rows = _with_any(rows, strings)
    if not rules:
        rows = rows.where(F.lit(False))
    elif guard:
        rows = rows.where(_guard(text, rules))
    tests = [F.when(L.match_file_path(r.file_path_pattern, F.col("file_path")) & rule_test(text, r), F.lit(i)) for i, r in enumerate(rules)] or [F.lit(None).cast("int")]
    hits = rows.withColumn("rule_no", F.explode(F.array_compact(F.array(*tests))))
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules] or [F.lit("")]), F.col("rule_no") + 1)
    key = F.concat_ws("_", F.lit("evt"), F.col("archive_id"), F.substring(F.md5("file_path"), 1, 8), F.col("line_no").cast("string"), of("id"))
    return hits.select(
        key.alias("id"), "archive_id", of("id").alias("rule_id"), of("name").alias("rule_name"), of("severity").alias("severity"),
        of("storage_type").alias("storage_type"), "file_path", "line_no", L.truncate_content(text).alias("matched_content"),
        of("suggestion").alias("suggestion"), L.extract_timestamp(text).alias("ts"),
    )


def cap_events(events: DataFrame, n: int = 500) -> DataFrame:
    """The first n events of each archive in (file, line, rule) order."""
    rank = F.row_number().over(Window.partitionBy("archive_id").orderBy("file_path", "line_no", "rule_id"))
    return events.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def severity_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("archive_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def storage_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("archive_id", "storage_type").agg(F.count(F.lit(1)).alias("n"))


def health_score(fatal: Column, critical: Column, warning: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 25 * fatal - 10 * critical - 3 * warning).cast("int")


def report_text(has_files: Column, total: Column, fatal: Column, critical: Column, warning: Column) -> Column:
    found = F.format_string("Found %d events: %d fatal, %d critical, %d warnings.", total, fatal, critical, warning)
    return F.when(~has_files, "No text log files to scan.").when(total == 0, "No known fault was found.").otherwise(found)


def report(archives: DataFrame, events: DataFrame) -> DataFrame:
    """One row per archive(archive_id, n_files): counts, health score and text; clean archives score 100."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = events.groupBy("archive_id").agg(F.count(F.lit(1)).alias("total_events"), n("FATAL").alias("fatal"), n("CRITICAL").alias("critical"), n("WARNING").alias("warning"), n("INFO").alias("info"))
    out = archives.join(counts, "archive_id", "left").na.fill(0, ["total_events", "fatal", "critical", "warning", "info"])
    levels = [F.struct(F.lit(s.upper()).alias("key"), F.col(s).alias("value")) for s in ("fatal", "critical", "warning", "info")]
    summary = F.map_from_entries(F.filter(F.array(*levels), lambda x: x["value"] > 0))
    return out.select(
        "archive_id", F.lit("completed").alias("status"), "total_events", "fatal", "critical", "warning", summary.alias("severity_summary"),
        health_score(F.col("fatal"), F.col("critical"), F.col("warning")).alias("health_score"),
        report_text(F.col("n_files") > 0, F.col("total_events"), F.col("fatal"), F.col("critical"), F.col("warning")).alias("summary_text"),
    )


def diagnose(lines: DataFrame, rules: Sequence[Rule], once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, report) of all archives; only text log files are scanned.

    once: the events are written first, and whatever is made of them later reads that table instead of the lines.
    """
    files = lines.select("archive_id", "file_path").distinct()
    text = L.is_log_file(F.col("file_path"))
    archives = files.groupBy("archive_id").agg(F.count_if(text).alias("n_files"))
    events = scan_rules(lines.where(text), rules)
    events = written(events, "events") if once else events
    return events, report(archives, events)
