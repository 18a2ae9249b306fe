"""Evidence for root-cause work: noise, glossary, workflow stage, ranking, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import line as L
from ..functions.default_rules import GLOSSARY, NOISE_RULES, WORKFLOWS


def suppress_noise(events: DataFrame, noise: Sequence[tuple[str, str, str]] = NOISE_RULES) -> DataFrame:
    """events with ignored_by and ignored_reason of the first noise rule found; both null for clean events."""
    first = lambda at: F.coalesce(*[F.when(F.col("matched_content").rlike(n[2]), F.lit(n[at])) for n in noise], F.lit(None).cast("string"))
    return events.withColumn("ignored_by", first(0)).withColumn("ignored_reason", first(1))


def match_glossary(events: DataFrame, glossary: Sequence[tuple[str, list[str]]] = GLOSSARY, report: DataFrame | None = None) -> DataFrame:
    """(archive_id, term): terms that a clean event names, in its rule, content or suggestion, or the report's summary."""
    texts = events.select("archive_id", F.concat_ws(" ", "rule_name", "matched_content", "suggestion").alias("text"))
    if report is not None:
        texts = texts.unionByName(report.select("archive_id", F.col("summary_text").alias("text")))
    text = F.upper("text")
    tests = []
    for term, patterns in glossary:
        found = text.contains(term.upper())
        for p in patterns:
            found = found | text.contains(p.upper())
        tests.append(F.when(found, F.lit(term)))
    return texts.select("archive_id", F.explode(F.array_compact(F.array(*tests))).alias("term")).distinct()


def project_workflow(events: DataFrame, workflows: Sequence[tuple[str, list[tuple[str, str]]]] = WORKFLOWS) -> DataFrame:
    """(archive_id, workflow, step, stage): the first stage, in workflow order, that an event names or matches."""
    text = F.concat_ws(" ", "rule_name", "matched_content")
    hits = []
    for w, (name, stages) in enumerate(workflows):
        for i, (stage, pattern) in enumerate(stages):
            named = L.contains_fold(text, stage) | L.contains_fold(text, stage.replace("_", " "))
            hits.append(F.when(named | text.rlike(pattern), F.struct(F.lit(w).alias("w"), F.lit(i + 1).alias("step"), F.lit(name).alias("workflow"), F.lit(stage).alias("stage"))))
    first = events.select("archive_id", F.array_min(F.array_compact(F.array(*hits))).alias("hit")).where("hit IS NOT NULL")
    return first.groupBy("archive_id").agg(F.min("hit").alias("hit")).select("archive_id", "hit.workflow", "hit.step", "hit.stage")


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "FATAL", 4).when(severity == "CRITICAL", 3).when(severity == "ERROR", 2).when(severity == "WARNING", 1).otherwise(0)


def rank_evidence(events: DataFrame, n: int = 15) -> DataFrame:
    """The n weightiest events of each archive with rank and omitted, the number of the rest."""
    mine = Window.partitionBy("archive_id")
    rank = F.row_number().over(mine.orderBy(F.desc(severity_weight(F.col("severity"))), "file_path", "line_no", "rule_id"))
    rows = events.withColumn("rank", rank).where(F.col("rank") <= n)
    total = events.groupBy("archive_id").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(total, "archive_id").withColumn("omitted", F.greatest(F.lit(0), F.col("total") - n)).drop("total")


def evidence_document(report: DataFrame, events: DataFrame, terms: DataFrame, stages: DataFrame, n: int = 15, n_ignored: int = 5) -> DataFrame:
    """(archive_id, document): overview, terms, stage, ignored lines and ranked events as one text."""
    clean = rank_evidence(events.where("ignored_by IS NULL"), n)
    line = F.format_string("%d. [%s] %s %s:%d %s", "rank", "severity", "rule_name", "file_path", "line_no", "matched_content")
    joined = lambda c, key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c.alias("s")))), lambda x: x["s"]), "\n")
    top = clean.groupBy("archive_id").agg(joined(line, "rank").alias("top"), F.max("omitted").alias("omitted"))
    order = Window.partitionBy("archive_id").orderBy("file_path", "line_no", "rule_id")
    noise = events.where("ignored_by IS NOT NULL").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_ignored)
    noise = noise.groupBy("archive_id").agg(joined(F.format_string("- %s (%s)", "matched_content", "ignored_reason"), "r").alias("noise"))
    words = terms.groupBy("archive_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))
    out = report.join(top, "archive_id", "left").join(noise, "archive_id", "left").join(words, "archive_id", "left").join(stages, "archive_id", "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head + "\n"), F.col(c)))
    stage = F.when(F.col("stage").isNotNull(), F.format_string("# Stage\n%s step %d: %s", "workflow", "step", "stage"))
    text = F.concat_ws("\n\n", F.concat(F.lit("# Overview\n"), F.col("summary_text")), part("# Terms", "terms"), stage, part("# Ignored", "noise"), part("# Events", "top"), F.when(F.col("omitted") > 0, F.format_string("(%d more)", "omitted")))
    return out.select("archive_id", text.alias("document"))


def root_cause_row(ranked: DataFrame, stages: DataFrame) -> DataFrame:
    """(archive_id, root_cause, chain, est_tokens): the top event, and the chain through the broken stage."""
    cause = F.concat(F.col("rule_name"), F.lit(" ("), F.col("matched_content"), F.lit(")"))
    top = ranked.groupBy("archive_id").agg(F.min_by(F.struct("rule_name", cause.alias("cause")), "rank").alias("t"), F.sum(F.octet_length("matched_content")).alias("bytes"))
    out = top.join(stages, "archive_id", "left")
    chain = F.when(F.col("stage").isNotNull(), F.concat_ws(" -> ", "stage", "t.rule_name", F.lit("timeout"))).otherwise(F.col("t.rule_name"))
    return out.select("archive_id", F.col("t.cause").alias("root_cause"), chain.alias("chain"), F.expr("bytes div 4").alias("est_tokens"))


def noise_from_marked(marked: DataFrame, noise: DataFrame, masked: bool = True) -> DataFrame:
    """New noise rows (pattern, storage_type) from events marked as noise, without patterns that exist.

    The masked line is the pattern, so that the rule also meets the line at another time; masked=False keeps the text.
    """
    text = F.trim("matched_content")
    pattern = L.preprocess(text)["cleaned"] if masked else text
    rows = marked.select(pattern.alias("pattern"), F.coalesce(F.nullif("storage_type", F.lit("")), F.lit("ALL")).alias("storage_type")).where("pattern <> ''")
    return rows.groupBy("pattern").agg(F.min("storage_type").alias("storage_type")).join(noise.select("pattern"), "pattern", "left_anti")
