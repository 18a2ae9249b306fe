"""Search over lines: filters, hits with context, summaries, histogram, facets, traces, and the chunk token index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import line as L
from ..schema import SearchQuery
from ..scratch import written


def keyword_filter(content: Column, q: SearchQuery) -> Column:
    """Literal, whole-word or regex test; an empty keyword matches every line."""
    if not q.keyword:
        return F.lit(True)
    if q.regex:
        pattern = f"{L.LEFT}(?:{q.keyword}){L.RIGHT}" if q.whole_word else q.keyword
        return content.rlike(pattern if q.case_sensitive else f"(?i){pattern}")
    if q.whole_word:
        return L.contains_word(content, q.keyword, q.case_sensitive)
    return content.contains(q.keyword) if q.case_sensitive else L.contains_fold(content, q.keyword)


def level_filter(level: Column, wanted: str) -> Column:
    """ERROR takes in CRITICAL and FATAL, WARN everything from WARN up; '' and ALL switch the test off."""
    wanted = wanted.upper()
    if wanted in ("", "ALL"):
        return F.lit(True)
    up = {"ERROR": ["ERROR", "CRITICAL", "FATAL"], "WARN": ["WARN", "ERROR", "CRITICAL", "FATAL"]}
    return level.isin(up.get(wanted, [wanted]))


def matching(lines: DataFrame, q: SearchQuery) -> DataFrame:
    """The lines that pass all filters, with level and ts. Narrow: no shuffle."""
    out = lines
    if q.path:
        out = out.where(F.lower("file_path").contains(q.path.lower()))
    out = out.where(keyword_filter(F.col("content"), q))
    out = out.withColumn("level", L.detect_level(F.col("content"))).withColumn("ts", L.extract_timestamp(F.col("content")))
    out = out.where(level_filter(F.col("level"), q.level))
    time = L.parse_log_time(F.col("ts"))
    if q.start_time:
        out = out.where(time >= F.lit(q.start_time).cast("timestamp"))
    if q.end_time:
        out = out.where(time <= F.lit(q.end_time).cast("timestamp"))
    if q.max_per_file is not None:
        rank = F.row_number().over(Window.partitionBy("archive_id", "file_path").orderBy("line_no"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= q.max_per_file).drop("rank")
    if q.max_total is not None:
        out = out.orderBy("archive_id", "file_path", "line_no").limit(q.max_total)
    return out


def with_context(lines: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """hits with up to k lines before and after, by an equi-join on (file, line), so a huge file stays parallel."""
    k = 2 if k < 0 else min(k, 10)
    none = F.array().cast("array<string>")
    if k == 0:
        return hits.withColumn("context_before", none).withColumn("context_after", none)
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-k, k + 1) if o]))
    wanted = hits.select("archive_id", "file_path", F.col("line_no").alias("hit_no"), offsets.alias("off"))
    wanted = wanted.withColumn("line_no", F.col("hit_no") + F.col("off"))
    near = wanted.join(lines.select("archive_id", "file_path", "line_no", "content"), ["archive_id", "file_path", "line_no"])
    side = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("off", "content")))), lambda x: x["content"])
    near = near.groupBy("archive_id", "file_path", "hit_no").agg(side(F.col("off") < 0).alias("context_before"), side(F.col("off") > 0).alias("context_after"))
    near = near.withColumnRenamed("hit_no", "line_no")
    out = hits.join(near, ["archive_id", "file_path", "line_no"], "left")
    return out.withColumn("context_before", F.coalesce("context_before", none)).withColumn("context_after", F.coalesce("context_after", none))


def file_summaries(hits: DataFrame) -> DataFrame:
    """Hits per file and the highest level, most hits first."""
    top = F.max(L.level_priority(F.col("level")))
    name = F.when(top == 4, "CRITICAL").when(top == 3, "ERROR").when(top == 2, "WARN").otherwise("INFO")
    return hits.groupBy("file_path").agg(F.count(F.lit(1)).alias("hits"), name.alias("max_level")).orderBy(F.desc("hits"), "file_path")


def histogram(hits: DataFrame, buckets: int = 20) -> DataFrame:
    """Equal time buckets between the first and last parsed time; a span of a second or less is one bucket."""
    timed = hits.select(F.unix_micros(L.parse_log_time(F.col("ts"))).alias("us"), L.level_priority(F.col("level")).alias("p"), "level").where("us IS NOT NULL")
    ends = timed.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).where("lo IS NOT NULL")
    short = F.col("hi") - F.col("lo") <= 1_000_000
    ends = ends.withColumn("step", F.when(short, F.lit(1_000_000)).otherwise(F.greatest(F.lit(1_000_000), F.expr(f"(hi - lo) div {buckets}"))))
    ends = ends.withColumn("last", F.when(short, F.lit(0)).otherwise(F.lit(buckets - 1)))
    at = F.least(F.col("last"), F.expr("(us - lo) div step"))
    counted = timed.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("p") == 1).alias("info"), F.count_if(F.col("p") == 2).alias("warn"),
        F.count_if(F.col("p") == 3).alias("error"), F.count_if(F.col("p") == 4).alias("fatal"),
    )
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bucket"), "lo", "step")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "info", "warn", "error", "fatal")]
    label = F.date_format(F.timestamp_micros(F.col("lo") + F.col("bucket") * F.col("step")), "yyyy-MM-dd HH:mm:ss")
    return grid.join(counted, "bucket", "left").select("bucket", label.alias("bucket_ts"), *counts)


def facets(hits: DataFrame) -> DataFrame:
    """Long table (facet, value, n) of hits by level and by file."""
    by = lambda c: hits.groupBy(F.lit(c).alias("facet"), F.col("level" if c == "level" else "file_path").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by("level").unionByName(by("file"))


def traces(hits: DataFrame, limit: int = 20) -> DataFrame:
    """The first distinct trace ids in hit order; hits may bring their ids in a column _trace_id."""
    trace = F.col("_trace_id") if "_trace_id" in hits.columns else L.extract_trace_id(F.col("content"))
    found = hits.select(trace.alias("trace_id"), "file_path", "line_no").where("trace_id IS NOT NULL")
    first = found.groupBy("trace_id").agg(F.min(F.struct("file_path", "line_no")).alias("first"))
    return first.orderBy("first").limit(limit).select("trace_id", "first.file_path", "first.line_no")


def trace_lines(lines: DataFrame, trace_id: str) -> DataFrame:
    """All lines that hold one trace id."""
    return lines.where(F.col("content").contains(trace_id))


def trace_timeline(lines: DataFrame) -> DataFrame:
    """Per trace id: lines, first and last time text, highest level priority."""
    t = lines.select(L.extract_trace_id(F.col("content")).alias("trace_id"), L.extract_timestamp(F.col("content")).alias("ts"), L.level_priority(L.detect_level(F.col("content"))).alias("p"))
    return t.where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("p").alias("max_priority"))


def page(hits: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A slice of the hits in (archive, file, line) order."""
    number, size = max(1, number), size if size > 0 else 50
    return hits.orderBy("archive_id", "file_path", "line_no").offset((number - 1) * size).limit(size)


def file_view(lines: DataFrame, file_path: str, q: SearchQuery) -> DataFrame:
    """Only the matching lines of one file."""
    return lines.where((F.col("file_path") == file_path) & keyword_filter(F.col("content"), q)).select("file_path", "line_no", "content")


def chunk_token_index(lines: DataFrame, chunk_lines: int = 15_000) -> DataFrame:
    """(file_path, chunk, token): which chunks of a file hold a token."""
    chunk = F.floor((F.col("line_no") - 1) / chunk_lines).cast("int")
    return lines.select("file_path", chunk.alias("chunk"), F.explode(L.index_tokens(F.col("content"))).alias("token")).distinct()


def keyword_tokens(keyword: str) -> list[str]:
    import re

    return sorted({t for t in re.findall("[a-z0-9_-]+", keyword.lower()) if 2 <= len(t) <= 64 and not re.fullmatch("[0-9]{5,}", t)})


def prune_chunks(index: DataFrame, keyword: str) -> DataFrame | None:
    """(file_path, chunk) that hold all indexed tokens of a keyword; None where no token can prune.

    Exact for keywords that stand as whole tokens; a keyword inside a longer token is not found this way.
    """
    tokens = keyword_tokens(keyword)
    if not tokens:
        return None
    hit = index.where(F.col("token").isin(tokens)).groupBy("file_path", "chunk").agg(F.count_distinct("token").alias("n"))
    return hit.where(F.col("n") == len(tokens)).drop("n")


def search_indexed(lines: DataFrame, index: DataFrame, keyword: str, chunk_lines: int = 15_000) -> DataFrame:
    """Whole-word search that reads only the chunks the index leaves."""
    chunks = prune_chunks(index, keyword)
    out = lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / chunk_lines).cast("int"))
    if chunks is not None:
        out = out.join(chunks, ["file_path", "chunk"], "left_semi")
    return out.where(L.contains_word(F.col("content"), keyword)).drop("chunk")


@dataclass
class SearchResult:
    hits: DataFrame
    file_summaries: DataFrame
    histogram: DataFrame
    facets: DataFrame
    traces: DataFrame


def search(lines: DataFrame, q: SearchQuery, once: bool = False) -> SearchResult:
    """All parts of an answer, each lazy.

    once: the hits are written to the shared folder first, so that the lines are filtered in one reading and every part
    but the context reads its few columns of that table (levels, times and trace ids are found once, too); worth it
    where several parts are read.  The context of a page's hits is looked up among the lines either way.
    """
    found = matching(lines, q)
    if once:
        found = written(found.withColumn("_trace_id", L.extract_trace_id(F.col("content"))), "hits")
    shown = with_context(lines, page(found.drop("_trace_id"), q.page, q.page_size), q.context)
    return SearchResult(shown, file_summaries(found), histogram(found), facets(found), traces(found))
