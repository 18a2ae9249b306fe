"""Queries of the sources and scalar line functions, each with its SQL."""

from __future__ import annotations

import io
import posixpath
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import line as L
from ..schema import PreprocessRule
from ..scratch import shared_folder
from ..sources import archives, catalog, line_store, text
from .views import Views, with_views

RULES = [PreprocessRule("mask", "t-[0-9]+", "<user>", True, 1), PreprocessRule("mask", "(", "x", True, 2), PreprocessRule("level_mapping", "value=9", "debug", True, 3), PreprocessRule("level_mapping", "purchase", " critical ", True, 4)]
LONG = 40  # characters kept by the truncation query


def per_line(expr, name: str, view: str = "event_lines"):
    return lambda spark, d: getattr(Views(spark, d), view)().select("file_path", "line_no", expr(F.col("content")).alias(name))


def per_line_sql(expr: str, name: str, view: str = "event_lines") -> str:
    return with_views(f"SELECT file_path, line_no, {expr} AS {name} FROM {view}", view)


LEVEL = """CASE WHEN contains(content, 'FATAL') OR contains(content, 'fatal') OR contains(content, 'EMERG') THEN 'FATAL'
  WHEN contains(content, 'CRIT') OR contains(content, 'critical') THEN 'CRITICAL'
  WHEN contains(content, 'ERR') OR contains(content, 'error') OR contains(content, 'Error') THEN 'ERROR'
  WHEN contains(content, 'WARN') OR contains(content, 'warning') OR contains(content, 'Warn') THEN 'WARN'
  WHEN contains(content, 'DEBUG') OR contains(content, 'debug') OR contains(content, 'Debug') THEN 'DEBUG'
  WHEN contains(content, 'TRACE') OR contains(content, 'trace') THEN 'TRACE' ELSE 'INFO' END"""
PRIORITY = f"CASE WHEN ({LEVEL}) IN ('FATAL', 'CRITICAL') THEN 4 WHEN ({LEVEL}) = 'ERROR' THEN 3 WHEN ({LEVEL}) IN ('WARN', 'WARNING') THEN 2 ELSE 1 END"
TS = rf"""coalesce(nullif(regexp_extract(content, '{L.ISO_AT_START}'), ''), nullif(regexp_extract(content, '{L.ISO}'), ''), nullif(regexp_extract(content, '{L.SYSLOG}'), ''), '')"""
STRIPPED = f"trim(regexp_replace(trim(content), '{L.LEADING_TIME}', ''))"
WORD = rf"upper(regexp_extract({STRIPPED}, '(?i)\b({L.LEVEL_WORDS})\b', 1))"
TEMPLATE_LEVEL = f"""CASE WHEN {WORD} IN ('WARN', 'WARNING', 'WRN') THEN 'WARN' WHEN {WORD} IN ('ERROR', 'ERR') THEN 'ERROR'
  WHEN {WORD} IN ('FATAL', 'FTL', 'CRIT', 'CRITICAL') THEN 'FATAL' WHEN {WORD} IN ('DEBUG', 'DBG') THEN 'DEBUG' WHEN {WORD} IN ('TRACE', 'TRC') THEN 'TRACE' ELSE 'INFO' END"""


def masked_sql(s: str) -> str:
    quoted = L.QUOTED.replace("'", "''")
    for pattern, to in ((rf"\b{L.IPV4}\b", "<*>"), (rf"\b{L.UUID}\b", "<*>"), (rf"\b{L.HEX}\b", "<*>"), (quoted, '"<*>"'), (r"\b[0-9]+\b", "<*>")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return s


MASKED = masked_sql(STRIPPED)
CLEANED = f"regexp_replace({MASKED}, 't-[0-9]+', '<user>', 'g')"
RULED_LEVEL = f"CASE WHEN regexp_matches(content, 'purchase') OR regexp_matches({CLEANED}, 'purchase') THEN 'CRITICAL' WHEN regexp_matches(content, 'value=9') OR regexp_matches({CLEANED}, 'value=9') THEN 'DEBUG' ELSE {TEMPLATE_LEVEL} END"
TRACE_ID = rf"nullif(regexp_extract(content, '(?i)\b{L.TRACE}', 1), '')"
TOKENS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
INDEXED = "list_filter(regexp_extract_all(lower(content), '[a-z0-9_-]+'), lambda t: length(t) BETWEEN 2 AND 64 AND NOT regexp_full_match(t, '[0-9]{5,}'))"


def trace_text(spark, d):
    """Trace ids of event lines and of JSON lines made from their properties."""
    v = Views(spark, d)
    e = v.table("events").select("event_id", F.concat(F.lit('{"traceId" : "e-'), F.col("event_id").cast("string"), F.lit('", "props": '), F.col("event_type"), F.lit("}")).alias("content"))
    return e.select("event_id", L.extract_trace_id(F.col("content")).alias("trace_id"))


def tokens_query(spark, d):
    t = Views(spark, d).doc_lines()
    return t.select("file_path", "line_no", F.size(L.tokenize(F.col("content"))).cast("long").alias("n_tokens"), L.template_id(L.tokenize(F.col("content"))).alias("id"), F.md5(F.array_join(L.tokenize(F.col("content")), " ")).alias("digest"))


def similarity_query(spark, d):
    """Each line of a node's log against the one before it."""
    t = Views(spark, d).event_lines().select("file_path", "line_no", L.tokenize(F.col("content")).alias("a"))
    u = t.select("file_path", (F.col("line_no") + 1).alias("line_no"), F.col("a").alias("b"))
    return t.join(u, ["file_path", "line_no"]).select("file_path", "line_no", F.round(L.seq_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def scope_query(spark, d):
    files = Views(spark, d).files().select("file_path").distinct()
    patterns = ["part-1?.log", "node-2/*/*/part-7.log", "R/F/*", "N/O/part-3.log, *.txt", ""]
    return files.select("file_path", *[L.match_file_path(p, F.col("file_path")).alias(f"p{i}") for i, p in enumerate(patterns)])


SCOPE_SQL = with_views(
    """SELECT DISTINCT file_path, regexp_matches(file_path, '/part-1.\\.log$') AS p0,
  regexp_full_match(file_path, 'node-2/[^/]*/[^/]*/part-7\\.log') AS p1, regexp_full_match(lower(file_path), '[^/]*/?r/f/[^/]*') AS p2,
  ends_with(lower(file_path), '/n/o/part-3.log') AS p3, true AS p4 FROM files""",
    "files",
)


def scores_query(spark, d):
    """Scores of event lines, of syslog and uptime forms of the same times, and of numbered names."""
    v = Views(spark, d)
    e = v.table("events").select("event_id", "ts")
    syslog = F.concat(F.lit("<34>"), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host x"))
    uptime = F.format_string("[ %d.500000] up", "event_id")
    name = F.concat(F.lit("dmesg."), F.when(F.col("event_id") % 3 == 0, "log").otherwise(F.col("event_id").cast("string")))
    return e.select("event_id", L.start_score(F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss.SSSSSS")).alias("iso"), L.start_score(syslog).alias("syslog"), L.start_score(uptime).alias("uptime"), L.fallback_score(name).alias("fallback"))


SCORES_SQL = """SELECT event_id, epoch_us(ts) / 1e6 AS iso,
  CAST(month(ts) * 31 * 86400 + day(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS syslog,
  CAST(event_id + 0.5 AS DOUBLE) AS uptime, CASE WHEN event_id % 3 = 0 THEN 1000.0 ELSE -CAST(event_id AS DOUBLE) END AS fallback FROM events"""


def tags_query(spark, d):
    o = Views(spark, d).table("orders")
    listed = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("， "), F.col("o_orderstatus"), F.lit(" ;;"), F.col("o_orderstatus"), F.lit("；x"))
    given = F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", " ", "'), F.col("o_orderstatus"), F.lit('"]'))
    return o.select("o_orderkey", F.array_join(L.parse_tags(F.when(F.col("o_orderkey") % 2 == 0, listed).otherwise(given)), "|").alias("tags"))


TAGS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus || '|x' ELSE o_orderpriority || '|' || o_orderstatus END AS tags FROM orders"""


def words_query(spark, d):
    t = Views(spark, d).doc_lines()
    return t.select("file_path", "line_no", L.contains_word(F.col("content"), "the").alias("word"), L.contains_word(F.col("content"), "The", True).alias("word_cs"), L.contains_fold(F.col("content"), "THE").alias("fold"), L.contains_fold(F.col("content"), "le.").alias("dot"))


WORDS_SQL = with_views(
    r"""SELECT file_path, line_no, regexp_matches(content, '(?i)\bthe\b') AS word, regexp_matches(content, '\bThe\b') AS word_cs,
  regexp_matches(content, '(?i)[t][h][e]') AS fold, contains(translate(content, 'LE', 'le'), 'le.') AS dot FROM doc_lines""",
    "doc_lines",
)


def index_tokens_query(spark, d):
    t = Views(spark, d).doc_lines()
    tokens = L.index_tokens(F.translate(F.col("content"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return t.select("file_path", "line_no", F.size(tokens).cast("long").alias("n"), F.coalesce(F.array_max(tokens), F.lit("")).alias("last"))


ASCII_LOW = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
INDEX_TOKENS_SQL = with_views(
    f"""SELECT file_path, line_no, CAST(coalesce(len(list_distinct(t)), 0) AS BIGINT) AS n, coalesce(list_max(t), '') AS last
FROM (SELECT file_path, line_no, {INDEXED.replace("lower(content)", ASCII_LOW)} AS t FROM doc_lines)""",
    "doc_lines",
)


def paths_query(spark, d):
    f = Views(spark, d).files().select("file_path").distinct()
    p = F.col("file_path")
    return f.select("file_path", L.normalize_path(p, "node-1/R").alias("relative"), L.in_scope(p, "node-1/R").alias("inside"), L.prefix_before_dot(F.substring_index(p, "/", -1)).alias("prefix"), L.is_log_file(p).alias("is_log"))


PATHS_SQL = with_views(
    """SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, 'node-1/R/') THEN substr(file_path, 10) ELSE regexp_extract(file_path, '[^/]*$') END AS relative,
  starts_with(file_path, 'node-1/R/') AS inside, split_part(regexp_extract(file_path, '[^/]*$'), '.', 1) AS prefix, ends_with(file_path, '.log') AS is_log FROM files""",
    "files",
)


def formats_query(spark, d):
    p = Views(spark, d).table("part")
    suffix = F.element_at(F.array(*map(F.lit, [".tar.gz", ".TGZ", ".zip", ".7z", ".tar.bz2", ".tar", ".gz", ".bz2", ".log", ".csv", ".dat", ".trace.bin", ""])), (F.col("p_partkey") % 13 + 1).cast("int"))
    name = F.concat(F.lit("dir.d/a-"), F.col("p_partkey").cast("string"), suffix)
    return p.select("p_partkey", L.archive_format(name).alias("format"), L.is_log_file(name).alias("is_log"))


FORMATS_SQL = """SELECT p_partkey, ['tar.gz', 'tgz', 'zip', '7z', 'tar.bz2', 'tar', 'gz', 'bz2', 'log', 'log', 'log', 'log', 'log'][p_partkey % 13 + 1] AS format,
  (p_partkey % 13) IN (8, 9, 11, 12) AS is_log FROM part"""


def rotated(spark, d):
    """Event lines as three parts per node, one of them compressed, put together again."""
    v = Views(spark, d)
    part = F.floor((F.col("line_no") - 1) / 200)
    name = F.concat(F.split_part("file_path", F.lit("."), F.lit(1)), F.lit(".part"), (100 - part).cast("string"))
    e = v.event_lines().select("archive_id", name.alias("file_path"), ((F.col("line_no") - 1) % 200 + 1).alias("line_no"), "content")
    names = e.select("archive_id", "file_path").distinct().withColumn("original", F.when(F.col("file_path").endswith("100"), F.concat("file_path", F.lit(".gz"))).otherwise(F.col("file_path")))
    return catalog.consolidate_rotated(e, names)


ROTATED_SQL = with_views("""SELECT archive_id, regexp_replace(file_path, '^app/(.*)\\.log$', 'app/\\1/\\1') AS file_path, line_no, content FROM event_lines""", "event_lines")

def write_package(folder: str):
    """Writes lines of one file as a zip inside a tar.gz and gives its path; a task that runs again writes the same."""

    def run(key, lines):
        archive_id, file_path, part = key
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(file_path), "".join(f"{x}\n" for x in lines.sort_values("line_no")["content"]))
        with tarfile.open(fileobj=outer, mode="w:gz") as t:
            info = tarfile.TarInfo("logs.zip")
            info.size = inner.tell()
            t.addfile(info, io.BytesIO(inner.getvalue()))
        name = f"{archive_id}-{posixpath.basename(file_path)}-{part}.tar.gz"
        archives.put(f"{folder}/{name}", outer.getvalue())
        return pd.DataFrame({"path": [name]})

    return run


def packed_archives(spark, d):
    """Event lines as packages of 500 lines in the shared folder, read from there."""
    folder = f"{shared_folder(spark).rstrip('/')}/packages-{uuid.uuid4().hex}"
    e = Views(spark, d).event_lines().select("archive_id", "file_path", "line_no", "content", F.expr("(line_no - 1) div 500").alias("part"))
    e.groupBy("archive_id", "file_path", "part").applyInPandas(write_package(folder), "path string").agg(F.count("path")).collect()
    read = archives.read_archives(spark, folder)
    return read.select(F.regexp_extract("archive_path", "[^/]*$", 0).alias("package"), "file_path", "depth", "line_no", "content", "error")


PACKED_SQL = with_views("""SELECT archive_id || '-' || split_part(file_path, '/', 2) || '-' || ((line_no - 1) // 500)::VARCHAR || '.tar.gz' AS package, 'logs/' || file_path AS file_path, 2 AS depth,
  row_number() OVER (PARTITION BY archive_id, file_path, (line_no - 1) // 500 ORDER BY line_no) AS line_no, content, CAST(NULL AS VARCHAR) AS error FROM event_lines""", "event_lines")

def line_store_ends(spark, d):
    """All document lines go into a line store; how many lines each file has there, and its last one."""
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    line_store.write_lines(Views(spark, d).doc_lines(), path)
    key = ["archive_id", "file_path"]
    ends = line_store.stored_lines(spark, path).groupBy(*key).agg(F.count(F.lit(1)).alias("n_lines"), F.max_by("content", F.struct("line_no", "content")).alias("last_line"))
    return line_store.stored_counts(spark, path).join(ends, key)


QUERIES = {
    "s04_read_archives": (packed_archives, PACKED_SQL),
    "s02_s05_formats": (formats_query, FORMATS_SQL),
    "s06_file_catalog": (lambda s, d: catalog.file_catalog(Views(s, d).doc_lines()).select("archive_id", "file_path", "line_count", "text_bytes"), with_views("SELECT archive_id, file_path, count(*) AS line_count, CAST(sum(strlen(content) + 1) AS BIGINT) AS text_bytes FROM doc_lines GROUP BY 1, 2", "doc_lines")),
    "s07_archive_totals": (lambda s, d: catalog.archive_totals(Views(s, d).files()), with_views("SELECT archive_id, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS total_lines FROM files GROUP BY 1", "files")),
    "s08_list_children": (lambda s, d: catalog.list_children(Views(s, d).files(), "node-1"), with_views("""SELECT name, bool_or(deep) AS is_directory, CAST(sum(size) AS BIGINT) AS size, count(DISTINCT next) AS child_count
FROM (SELECT split_part(file_path, '/', 2) AS name, split_part(file_path, '/', 3) AS next, split_part(file_path, '/', 3) <> '' AS deep, size FROM files WHERE starts_with(file_path, 'node-1/')) GROUP BY 1""", "files")),
    "s09_sub_archives": (lambda s, d: catalog.detect_sub_archives(Views(s, d).files()), with_views("SELECT split_part(file_path, '/', 1) AS name, split_part(file_path, '/', 1) AS path, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, true AS has_nested FROM files GROUP BY 1, 2", "files")),
    "s10_consolidate_rotated": (rotated, ROTATED_SQL),
    "s11_line_store": (
        line_store_ends,
        with_views("SELECT archive_id, file_path, max(line_no) AS total_lines, count(*) AS n_lines, (max(struct_pack(n := line_no, c := content))).c AS last_line FROM doc_lines GROUP BY 1, 2", "doc_lines"),
    ),
    "s11_read_lines": (lambda s, d: text.read_lines(Views(s, d).event_lines(), "app/node-3.log", 20, 50), with_views("""SELECT line_no, content, (SELECT max(line_no) FROM event_lines WHERE file_path = 'app/node-3.log') >= 70 AS has_more, (SELECT max(line_no) FROM event_lines WHERE file_path = 'app/node-3.log') AS total_lines
FROM event_lines WHERE file_path = 'app/node-3.log' AND line_no BETWEEN 20 AND 69""", "event_lines")),
    "s14_filter_tree": (lambda s, d: catalog.filter_tree(Views(s, d).files(), "F/PART-1"), with_views("""SELECT DISTINCT path, is_directory FROM (
  SELECT unnest([file_path, split_part(file_path, '/', 1), split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2), split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) || '/' || split_part(file_path, '/', 3)]) AS path,
    unnest([false, true, true, true]) AS is_directory FROM files WHERE contains(lower(file_path), 'f/part-1'))""", "files")),
    "f01_detect_level": (per_line(lambda C: L.detect_level(C), "level"), per_line_sql(LEVEL, "level")),
    "f02_template_level": (per_line(lambda C: L.template_level(C), "level"), per_line_sql(TEMPLATE_LEVEL, "level")),
    "f03_level_priority": (per_line(lambda C: L.level_priority(L.detect_level(C)), "priority"), per_line_sql(PRIORITY, "priority")),
    "f04_extract_timestamp": (per_line(lambda C: L.extract_timestamp(C), "ts"), per_line_sql(TS, "ts")),
    "f05_parse_log_time": (per_line(lambda C: F.unix_micros(L.parse_log_time(L.extract_timestamp(C))), "us"), per_line_sql(f"epoch_us(try_cast({TS} AS TIMESTAMP))", "us")),
    "f06_strip_timestamp": (per_line(lambda C: L.strip_timestamp(C), "rest"), per_line_sql(STRIPPED, "rest")),
    "f07_mask_variables": (per_line(lambda C: L.mask_variables(L.strip_timestamp(C)), "masked"), per_line_sql(MASKED, "masked")),
    "f07_mask_pages": (per_line(lambda C: L.mask_variables(C), "masked", "page_lines"), per_line_sql(masked_sql("content"), "masked", "page_lines")),
    "f08_mask_rules": (per_line(lambda C: L.apply_mask_rules(L.mask_variables(L.strip_timestamp(C)), RULES), "cleaned"), per_line_sql(CLEANED, "cleaned")),
    "f09_level_rules": (per_line(lambda C: L.apply_level_rules(L.template_level(C), C, L.apply_mask_rules(L.mask_variables(L.strip_timestamp(C)), RULES), RULES), "level"), per_line_sql(RULED_LEVEL, "level")),
    "f10_preprocess": (lambda s, d: Views(s, d).event_lines().select("file_path", "line_no", L.preprocess(F.col("content"), RULES).alias("p")).select("file_path", "line_no", "p.cleaned", "p.level", "p.ts"), with_views(f"SELECT file_path, line_no, {CLEANED} AS cleaned, {RULED_LEVEL} AS level, trim(regexp_extract(trim(content), '{L.LEADING_TIME}', 1), '[]') AS ts FROM event_lines", "event_lines")),
    "f11_trace_id": (per_line(lambda C: L.extract_trace_id(C), "trace_id"), per_line_sql(TRACE_ID, "trace_id")),
    "f11_trace_id_json": (trace_text, "SELECT event_id, 'e-' || event_id::VARCHAR AS trace_id FROM events"),
    "f12_f13_tokens": (tokens_query, with_views(f"""SELECT file_path, line_no, CAST(len(t) AS BIGINT) AS n_tokens, 'tpl_' || substr(md5(coalesce(array_to_string(t, ' '), '')), 1, 6) AS id, md5(coalesce(array_to_string(t, ' '), '')) AS digest
FROM (SELECT file_path, line_no, {TOKENS.format("content")} AS t FROM doc_lines)""", "doc_lines")),
    "f14_similarity": (similarity_query, with_views(f"""SELECT a.file_path, a.line_no, CASE WHEN len(a.t) = len(b.t) THEN round(list_sum(list_transform(list_zip(a.t, b.t), lambda x: CASE WHEN x[1] = x[2] THEN 1 ELSE 0 END)) / len(a.t), 6) ELSE 0.0 END AS similarity
FROM (SELECT *, {TOKENS.format("content")} AS t FROM event_lines) a JOIN (SELECT *, {TOKENS.format("content")} AS t FROM event_lines) b ON a.file_path = b.file_path AND a.line_no = b.line_no + 1""", "event_lines")),
    "f15_file_scope": (scope_query, SCOPE_SQL),
    "f16_start_score": (scores_query, SCORES_SQL),
    "f17_truncate": (per_line(lambda C: L.truncate_content(C, LONG), "cut", "doc_lines"), per_line_sql(f"CASE WHEN length(content) > {LONG} THEN substr(content, 1, {LONG}) || '...' ELSE content END", "cut", "doc_lines")),
    "f18_parse_tags": (tags_query, TAGS_SQL),
    "f19_f20_words": (words_query, WORDS_SQL),
    "f21_f23_paths": (paths_query, PATHS_SQL),
    "f22_index_tokens": (index_tokens_query, INDEX_TOKENS_SQL),
}
