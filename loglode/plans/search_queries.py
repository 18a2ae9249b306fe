"""Queries of search, diagnosis, templates and diff, each with its SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.default_rules import DEFAULT_RULES
from ..operators import diagnose as D
from ..operators import diff as X
from ..operators import gram_index as G
from ..operators import rule_index
from ..operators import search as S
from ..operators import templates as T
from ..schema import SearchQuery
from ..scratch import shared_folder
from ..sources import tables
from .line_queries import LEVEL, MASKED, PRIORITY, STRIPPED, TEMPLATE_LEVEL, TRACE_ID, TS
from .views import RULES_SMALL, Views, with_views

ERRORS = SearchQuery(keyword="value=1", level="ERROR")
PLACE = ["archive_id", "file_path", "line_no"]


def _hits(spark, d, q=ERRORS):
    return S.matching(Views(spark, d).event_lines(), q)


def simple(q: SearchQuery, view: str = "event_lines"):
    return lambda s, d: S.matching(getattr(Views(s, d), view)(), q).select(*PLACE, "content")


def simple_sql(test: str, view: str = "event_lines") -> str:
    return with_views(f"SELECT archive_id, file_path, line_no, content FROM {view} WHERE {test}", view)


HITS = f"""hits AS (SELECT *, {LEVEL} AS level, {PRIORITY} AS p, {TS} AS ts FROM event_lines
  WHERE contains(content, 'value=1') AND ({LEVEL}) IN ('ERROR', 'CRITICAL', 'FATAL'))"""
HISTOGRAM_SQL = with_views(
    """SELECT g.bucket, strftime(make_timestamp(lo + g.bucket * step), '%Y-%m-%d %H:%M:%S') AS bucket_ts,
  coalesce(total, 0) AS total, coalesce(info, 0) AS info, coalesce(warn, 0) AS warn, coalesce(error, 0) AS error, coalesce(fatal, 0) AS fatal
FROM grid g LEFT JOIN counted c USING (bucket)""",
    "event_lines",
    more=HITS
    + """,
timed AS (SELECT epoch_us(try_cast(ts AS TIMESTAMP)) AS us, p FROM hits),
ends AS (SELECT min(us) AS lo, max(us) AS hi, CASE WHEN max(us) - min(us) <= 1000000 THEN 1000000 ELSE greatest(1000000, (max(us) - min(us)) // 20) END AS step,
  CASE WHEN max(us) - min(us) <= 1000000 THEN 0 ELSE 19 END AS last FROM timed),
counted AS (SELECT CAST(least(last, (us - lo) // step) AS INT) AS bucket, count(*) AS total, count(*) FILTER (p = 1) AS info, count(*) FILTER (p = 2) AS warn,
  count(*) FILTER (p = 3) AS error, count(*) FILTER (p = 4) AS fatal FROM timed, ends GROUP BY 1),
grid AS (SELECT CAST(unnest(range(0, last + 1)) AS INT) AS bucket, lo, step FROM ends)""",
)

CONTEXT_SQL = with_views(
    """SELECT h.archive_id, h.file_path, h.line_no, any_value(h.level) AS level, any_value(h.ts) AS ts,
  coalesce(string_agg(l.content, chr(10) ORDER BY l.line_no) FILTER (l.line_no < h.line_no), '') AS before,
  coalesce(string_agg(l.content, chr(10) ORDER BY l.line_no) FILTER (l.line_no > h.line_no), '') AS after
FROM hits h LEFT JOIN event_lines l ON l.archive_id = h.archive_id AND l.file_path = h.file_path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2
GROUP BY 1, 2, 3""",
    "event_lines",
    more=HITS,
)


def context(spark, d):
    lines = Views(spark, d).event_lines()
    out = S.with_context(lines, S.matching(lines, ERRORS), 2)
    return out.select(*PLACE, "level", "ts", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


def indexed(spark, d):
    lines = Views(spark, d).event_lines()
    return S.search_indexed(lines, S.chunk_token_index(lines, 100), "t-17", 100).select(*PLACE)


def pruned(spark, d):
    return S.prune_chunks(S.chunk_token_index(Views(spark, d).event_lines(), 100), "t-17 signup")


GRAM_REGEX = SearchQuery(keyword=r"trace_id=t-(17|4\d) (signup|purch\w+) value=1\d*\.", regex=True)
GRAM_WORD = SearchQuery(keyword="t-17 PURCH")


def gram_index(spark, d, chunk_lines=20):
    lines = Views(spark, d).event_lines()
    return lines, G.chunk_gram_index(lines, chunk_lines)


def gram_search(q):
    def run(spark, d):
        lines, index = gram_index(spark, d)
        return G.search_by_grams(lines, index, q, 20).select(*PLACE)

    return run


def gram_test(plan) -> str:
    """A plan as a test of a chunk's lines."""
    if isinstance(plan, str):
        return f"bool_or(contains(lower(content), '{plan}'))"
    return "(" + f" {plan[0].upper()} ".join(map(gram_test, plan[1])) + ")"


GRAM_CHUNKS = "SELECT archive_id, file_path, CAST((line_no - 1) // 20 AS INT) AS chunk, {} FROM event_lines GROUP BY 1, 2, 3"
TOKEN_SQL = "unnest(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9_-]+'), lambda t: length(t) BETWEEN 2 AND 64 AND NOT regexp_full_match(t, '[0-9]{5,}')))) AS token"

# ---- diagnosis ----
OF = [("r1", "errors", "Ceph", "CRITICAL", r"regexp_matches(content, '\[ERROR\].*value=1')", "look at the node"),
      ("r2", "purchases", "HDFS", "FATAL", r"regexp_matches(content, '\[FATAL\] trace_id=t-[0-9]+ purchase value=[0-9]{3}')", "check the order"),
      ("r3", "signups", "MinIO", "WARNING", "regexp_matches(content, '(?i)signup value=9')", "none"),
      ("r4", "views on node 3", "Generic", "INFO", "file_path = 'app/node-3.log' AND regexp_matches(content, '(?i)VIEW value=[0-4]')", ""),
      ("r5", "app clicks", "Generic", "WARNING", "regexp_matches(content, 'click value=[0-9][.]')", "")]
FOUND = "found AS (" + " UNION ALL ".join(
    f"SELECT archive_id, file_path, line_no, content, '{i}' AS rule_id, '{n}' AS rule_name, '{t}' AS storage_type, '{s}' AS severity, '{g}' AS suggestion FROM event_lines WHERE {test}" for i, n, t, s, test, g in OF
) + ")"
EVENT_COLUMNS = f"""'evt_' || archive_id || '_' || substr(md5(file_path), 1, 8) || '_' || line_no::VARCHAR || '_' || rule_id AS id, archive_id, rule_id, rule_name, severity, storage_type, file_path, line_no,
  trim(content) AS matched_content, suggestion, {TS} AS ts"""
WEIGHT = "CASE severity WHEN 'FATAL' THEN 4 WHEN 'CRITICAL' THEN 3 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"


def events(spark, d, guard=False):
    return D.scan_rules(Views(spark, d).event_lines(), RULES_SMALL, guard)


def diagnosed(sql: str, more: str = "") -> str:
    return with_views(sql, "event_lines", more=FOUND + (", " + more if more else ""))


def rule_table(spark, d):
    """Rules of every benchmark sentence: literals at even places, regexes with free blanks at odd ones."""
    items = Views(spark, d).table("benchmark").select("item_id", F.posexplode(F.split("text", "[.?!\n]")).alias("at", "said"))
    said, odd = F.trim("said"), F.col("at") % 2 == 1
    pattern = F.when(odd, F.regexp_replace(F.regexp_replace(said, "[^A-Za-z ]", "."), " +", " +")).otherwise(said)
    none = F.lit("")
    return items.where(F.length(said) >= 8).select(
        F.format_string("b%d-%d", "item_id", "at").alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.lit("Generic").alias("storage_type"), F.lit("INFO").alias("severity"), pattern.alias("pattern"),
        odd.alias("is_regex"), none.alias("file_path_pattern"), none.alias("description"), none.alias("suggestion"), F.lit(True).alias("enabled"),
    )


def many_rules(spark, d):
    return rule_index.scan_rule_table(Views(spark, d).doc_lines(), rule_table(spark, d)).select("archive_id", "file_path", "line_no", "rule_id", "rule_name")


MANY_RULES_SQL = with_views(
    r"""SELECT archive_id, file_path, line_no, 'b' || item_id::VARCHAR || '-' || (i - 1)::VARCHAR AS rule_id, 'item ' || item_id::VARCHAR AS rule_name
FROM doc_lines JOIN said ON CASE WHEN i % 2 = 0 THEN regexp_matches(content, regexp_replace(regexp_replace(s, '[^A-Za-z ]', '.', 'g'), ' +', ' +', 'g')) ELSE contains(lower(content), lower(s)) END""",
    "doc_lines",
    more=r"""said AS (SELECT item_id, i, trim(s) AS s FROM (SELECT item_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT item_id, string_split_regex(text, '[.?!
]') AS p FROM benchmark)) WHERE length(trim(s)) >= 8)""",
)


REPORT_SQL = diagnosed("""SELECT archive_id, 'completed' AS status, total AS total_events, fatal, critical, warning, CAST(greatest(0, 100 - 25 * fatal - 10 * critical - 3 * warning) AS INT) AS health_score,
  CASE WHEN total = 0 THEN 'No known fault was found.' ELSE printf('Found %d events: %d fatal, %d critical, %d warnings.', total, fatal, critical, warning) END AS summary_text
FROM (SELECT a.archive_id, count(rule_id) AS total, count(*) FILTER (severity = 'FATAL') AS fatal, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning
  FROM (SELECT DISTINCT archive_id FROM event_lines) a LEFT JOIN found USING (archive_id) GROUP BY 1)""")  # fmt: skip


def report_store(spark, d):
    """Both archives' reports are stored, then archive 0's again with its fatal events alone; what the store holds then."""
    e, r = D.diagnose(Views(spark, d).event_lines(), RULES_SMALL)
    path = f"{shared_folder(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    tables.write_report(e, r, path)
    tables.write_report(e.where("archive_id = '0' AND severity = 'FATAL'"), r.where("archive_id = '0'"), path)
    events, reports = tables.current_reports(spark, path)
    return events.join(reports.select("archive_id", "health_score"), "archive_id").select(*PLACE, "rule_id", "severity", "health_score")


def scopes(spark, d):
    s = D.rule_scopes(Views(spark, d).event_lines(), RULES_SMALL)
    return s.select("archive_id", "file_path", F.array_join("allowed", ",").alias("allowed"))


def default_rules(spark, d):
    """The default rules over all views, whole."""
    v = Views(spark, d)
    lines = v.event_lines().unionByName(v.doc_lines()).unionByName(v.chat_lines()).unionByName(v.page_lines()).unionByName(v.fault_lines())
    return D.scan_rules(lines, DEFAULT_RULES).select("archive_id", "file_path", "line_no", "rule_id", "severity")


DEFAULT_RULES_SQL = with_views(
    " UNION ALL ".join(f"SELECT archive_id, file_path, line_no, '{r.id}' AS rule_id, '{r.severity}' AS severity FROM lines_ WHERE regexp_matches(content, '{r.pattern}')" for r in DEFAULT_RULES),
    "event_lines", "doc_lines", "chat_lines", "page_lines", "fault_lines",
    more="lines_ AS (" + " UNION ALL ".join(f"SELECT archive_id, file_path, line_no, trim(content) AS content FROM {x}_lines" for x in ("event", "doc", "chat", "page", "fault")) + ")",
)


# ---- templates ----
MASKED_AGG = f"""masked AS (
  SELECT *, {MASKED} AS pattern, {TEMPLATE_LEVEL} AS level, trim(regexp_extract(trim(content), '^\\S+ \\S+'), '[]') AS seen FROM event_lines),
patterns AS (
  SELECT pattern, count(*) AS count, max(CASE level WHEN 'FATAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) AS priority,
    arg_max(level, CASE level WHEN 'FATAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) AS level, arg_min(content, (file_path, line_no)) AS sample,
    arg_min(seen, (file_path, line_no)) AS first_seen, arg_max(seen, (file_path, line_no)) AS last_seen, count(DISTINCT file_path) AS n_files FROM masked GROUP BY 1)"""


def masked(spark, d):
    p = T.masked_patterns(Views(spark, d).event_lines())
    return p.select("pattern", "count", "priority", "level", "sample", "first_seen", "last_seen", F.size("files").cast("long").alias("n_files"))


def templates_sql(where: str = "true", fallback: bool = False) -> str:
    """service_lines' templates by a walk over each leaf, one pattern a step; `leaf` as the operator defines it."""
    leaf = "len(tokens)::VARCHAR || chr(1) || array_to_string(list_transform(tokens[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), chr(1))"
    wild = "regexp_replace(leaf, '\x01[^\x01]*$', chr(1) || '<*>')"
    moved = f"CASE WHEN count(*) OVER (PARTITION BY leaf) = 1 AND {wild} IN (SELECT leaf FROM cut0) THEN {wild} ELSE leaf END" if fallback else "leaf"
    agree = "list_sum(list_transform(list_zip(c, p.tokens), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))"
    return MASKED_AGG.replace("event_lines", f"(SELECT * FROM service_lines WHERE {where})") + f""",
cut0 AS (SELECT *, {leaf} AS leaf FROM (SELECT *, string_split(pattern, ' ') AS tokens FROM patterns)),
firsts AS (SELECT pattern, min((file_path, line_no)) AS place, max((file_path, line_no)) AS upto, list(DISTINCT file_path) AS files FROM masked GROUP BY 1),
cut AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY place) AS rn FROM (SELECT cut0.* EXCLUDE (leaf), {moved} AS leaf, place, upto, files FROM cut0 JOIN firsts USING (pattern))),
walk AS (
  SELECT DISTINCT leaf, 0::BIGINT AS rn, CAST([] AS VARCHAR[][]) AS clusters, 0::BIGINT AS chosen FROM cut
  UNION ALL
  SELECT leaf, rn, CASE WHEN best >= 0.55 THEN list_transform(clusters, lambda c, i: CASE WHEN i = nearest THEN list_transform(list_zip(c, tokens), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END) ELSE c END)
      ELSE list_append(clusters, tokens) END, CASE WHEN best >= 0.55 THEN nearest ELSE len(clusters) + 1 END
  FROM (SELECT *, coalesce(list_max(scores), 0) / len(tokens) AS best, list_position(scores, list_max(scores)) AS nearest
    FROM (SELECT p.leaf, p.rn, p.tokens, w.clusters, list_transform(w.clusters, lambda c: {agree}) AS scores FROM walk w JOIN cut p ON p.leaf = w.leaf AND p.rn = w.rn + 1))),
final AS (SELECT leaf, arg_max(clusters, rn) AS clusters FROM walk GROUP BY 1),
templates AS (
  SELECT array_to_string(any_value(f.clusters)[w.chosen], ' ') AS pattern, CAST(sum(p.count) AS BIGINT) AS count, arg_min(p.level, (-p.priority, p.place)) AS level, arg_min(p.sample, p.place) AS sample,
    arg_min(p.first_seen, p.place) AS first_seen, arg_max(p.last_seen, p.upto) AS last_seen, array_to_string(list_sort(list_distinct(flatten(list(p.files)))), ',') AS files
  FROM walk w JOIN cut p USING (leaf, rn) JOIN final f USING (leaf) GROUP BY w.leaf, w.chosen)"""


def shown_templates(t):
    return t.select("pattern", "count", "level", "sample", "first_seen", "last_seen", F.array_join("files", ",").alias("files"))


def with_walk(body: str, *args, **kw) -> str:
    return with_views(body, "service_lines", more=templates_sql(*args, **kw)).replace("WITH spelt", "WITH RECURSIVE spelt", 1)


def merged_sides(spark, d):
    lines = Views(spark, d).service_lines()
    return lines.where("archive_id = '0'"), lines.where("archive_id = '1'")


def new_merged(spark, d):
    a, b = merged_sides(spark, d)
    none = D.scan_rules(a.where("false"), RULES_SMALL)
    return X.diff(a, none, b, none, merged=True)["new_templates"].select("pattern", "count", "level")


def matched(spark, d):
    """Side b's patterns by the templates of side a that they belong to."""
    a, b = merged_sides(spark, d)
    out = T.match_templates(T.masked_patterns(b), T.merge_templates(T.masked_patterns(a)))
    return out.groupBy(F.coalesce("template", F.lit("(new)")).alias("template")).agg(F.count(F.lit(1)).alias("patterns"), F.sum("count").alias("lines"))


def two_walks(body: str) -> str:
    """Templates of side a as templates_a, of side b as templates_b (patterns as patterns_b)."""
    names = "masked patterns cut0 firsts cut walk final templates".split()
    side = lambda k, n: re.sub(rf"\b({'|'.join(names)})\b", rf"\1_{n}", templates_sql(f"archive_id = '{k}'"))
    return with_views(body, "service_lines", more=side(0, "a") + ", " + side(1, "b")).replace("WITH spelt", "WITH RECURSIVE spelt", 1)


MATCHED_SQL = two_walks("""SELECT coalesce(template, '(new)') AS template, count(*) AS patterns, CAST(sum(count) AS BIGINT) AS lines
FROM (SELECT b.pattern, any_value(b.count) AS count, arg_min(t.pattern, (-t.same, t.pattern)) FILTER (t.same >= 0.55 * len(b.tokens)) AS template
  FROM cut_b b LEFT JOIN (SELECT c.pattern AS mine, l.pattern, list_sum(list_transform(list_zip(c.tokens, l.tokens), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) AS same
    FROM cut_b c JOIN (SELECT DISTINCT leaf, w.chosen, array_to_string(f.clusters[w.chosen], ' ') AS pattern, f.clusters[w.chosen] AS tokens FROM walk_a w JOIN final_a f USING (leaf) WHERE rn > 0) l ON c.leaf = l.leaf) t ON t.mine = b.pattern GROUP BY 1)
GROUP BY 1""")


def sides(spark, d):
    lines = Views(spark, d).event_lines()
    return lines.where("archive_id = '0'"), lines.where("archive_id = '1'")


def diff_parts(spark, d):
    a, b = sides(spark, d)
    return X.diff(a, D.scan_rules(a, RULES_SMALL), b, D.scan_rules(b, RULES_SMALL), kind="inter_archive", head=None)


def doc_sides(spark, d):
    """Masked lines of documents: the even ones against the odd ones."""
    lines = Views(spark, d).doc_lines()
    odd = F.substring_index("file_path", "/", -1).cast("long") % 2
    return T.masked_patterns(lines.where(odd == 0)), T.masked_patterns(lines.where(odd == 1))


def new_templates(spark, d):
    return X.new_templates(*doc_sides(spark, d)).select("pattern", "count", "level")


def files_of(spark, d):
    """Two sub-trees, without the files whose sizes divide by three on one side and by four on the other."""
    f = Views(spark, d).files()
    return X.scoped_files(f.where("size % 3 > 0"), "node-0/R"), X.scoped_files(f.where("size % 4 > 0"), "node-1/N")


NEW_FATAL = """a AS (SELECT * FROM found WHERE archive_id = '0'), b AS (SELECT * FROM found WHERE archive_id = '1'),
fresh AS (SELECT * FROM b WHERE severity IN ('FATAL', 'CRITICAL') AND NOT EXISTS (SELECT 1 FROM a WHERE a.rule_name = b.rule_name AND a.file_path = b.file_path))"""
DOC_MASKED = MASKED.replace(STRIPPED, "trim(content)")
NEW_TEMPLATES_SQL = with_views(
    f"""SELECT pattern, n AS count, level FROM (SELECT pattern, count(*) AS n, 'INFO' AS level FROM m WHERE k = 1 GROUP BY 1)
WHERE n >= 2 AND pattern NOT IN (SELECT pattern FROM m WHERE k = 0) ORDER BY n DESC, encode(pattern) LIMIT 15""",
    "doc_lines",
    more=f"m AS (SELECT {DOC_MASKED} AS pattern, CAST(regexp_extract(file_path, '[^/]*$') AS BIGINT) % 2 AS k FROM doc_lines WHERE trim(content) <> '')",
)

QUERIES = {
    "q01_keyword": (simple(SearchQuery(keyword="CLICK Value=2")), simple_sql("contains(lower(content), 'click value=2')")),
    "q02_regex": (simple(SearchQuery(keyword=r"foo|(signup|view) value=\d\d\.", regex=True)), simple_sql(r"regexp_matches(content, '(?i)foo|(signup|view) value=\d\d\.')")),
    "q02_regex_word": (simple(SearchQuery(keyword="th[ea]", regex=True, whole_word=True), "page_lines"), simple_sql(r"regexp_matches(content, '(?i)\b(?:th[ea])\b')", "page_lines")),
    "q03_whole_word": (simple(SearchQuery(keyword="of", whole_word=True), "chat_lines"), simple_sql(r"regexp_matches(content, '(?i)\bof\b')", "chat_lines")),
    "q04_level": (simple(SearchQuery(level="WARN")), simple_sql(f"({LEVEL}) IN ('WARN', 'ERROR', 'CRITICAL', 'FATAL')")),
    "q05_path": (simple(SearchQuery(path="Node-5")), simple_sql("contains(file_path, 'node-5')")),
    "q06_time_range": (simple(SearchQuery(start_time="2024-01-05 00:00:00", end_time="2024-01-07 12:00:00")), simple_sql(f"try_cast({TS} AS TIMESTAMP) BETWEEN '2024-01-05 00:00:00' AND '2024-01-07 12:00:00'")),
    "q07_q08_context": (context, CONTEXT_SQL),
    "q09_file_summaries": (lambda s, d: S.file_summaries(_hits(s, d)), with_views("SELECT file_path, count(*) AS hits, CASE max(p) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 2 THEN 'WARN' ELSE 'INFO' END AS max_level FROM hits GROUP BY 1", "event_lines", more=HITS)),
    "q10_histogram": (lambda s, d: S.histogram(_hits(s, d)), HISTOGRAM_SQL),
    "q11_facets": (lambda s, d: S.facets(_hits(s, d)), with_views("SELECT 'level' AS facet, level AS value, count(*) AS n FROM hits GROUP BY 2 UNION ALL SELECT 'file', file_path, count(*) FROM hits GROUP BY 2", "event_lines", more=HITS)),
    "q12_traces": (lambda s, d: S.traces(_hits(s, d)), with_views(f"SELECT trace_id, f.file_path, f.line_no FROM (SELECT {TRACE_ID} AS trace_id, min((file_path, line_no)) AS k, arg_min({{'file_path': file_path, 'line_no': line_no}}, (file_path, line_no)) AS f FROM hits GROUP BY 1) WHERE trace_id IS NOT NULL ORDER BY k LIMIT 20", "event_lines", more=HITS)),
    "q13_trace_lines": (lambda s, d: S.trace_lines(Views(s, d).event_lines(), "t-14").select(*PLACE), with_views("SELECT archive_id, file_path, line_no FROM event_lines WHERE contains(content, 't-14')", "event_lines")),
    "q13_trace_timeline": (lambda s, d: S.trace_timeline(Views(s, d).event_lines()), with_views(f"SELECT {TRACE_ID} AS trace_id, count(*) AS n, min({TS}) AS first_ts, max({TS}) AS last_ts, max({PRIORITY}) AS max_priority FROM event_lines GROUP BY 1", "event_lines")),
    "q14_page": (lambda s, d: S.page(_hits(s, d), 3, 25).select(*PLACE), with_views("SELECT archive_id, file_path, line_no FROM hits ORDER BY 1, 2, 3 LIMIT 25 OFFSET 50", "event_lines", more=HITS)),
    "q15_caps": (lambda s, d: _hits(s, d, SearchQuery(keyword="value=1", max_per_file=20, max_total=130)).select(*PLACE), with_views("SELECT archive_id, file_path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, file_path ORDER BY line_no) AS r FROM event_lines WHERE contains(content, 'value=1')) WHERE r <= 20 ORDER BY 1, 2, 3 LIMIT 130", "event_lines")),
    "q16_file_view": (lambda s, d: S.file_view(Views(s, d).event_lines(), "app/node-2.log", SearchQuery(keyword="Error", case_sensitive=False)), with_views("SELECT file_path, line_no, content FROM event_lines WHERE file_path = 'app/node-2.log' AND contains(lower(content), 'error')", "event_lines")),
    "q17_token_index": (lambda s, d: S.chunk_token_index(Views(s, d).event_lines(), 1000).groupBy("file_path", "chunk").agg(F.count(F.lit(1)).alias("n_tokens")), with_views(f"SELECT file_path, chunk, count(DISTINCT token) AS n_tokens FROM (SELECT file_path, CAST((line_no - 1) // 1000 AS INT) AS chunk, {TOKEN_SQL} FROM event_lines) GROUP BY 1, 2", "event_lines")),
    "q17_pruned_chunks": (pruned, with_views(f"SELECT file_path, chunk FROM (SELECT file_path, CAST((line_no - 1) // 100 AS INT) AS chunk, {TOKEN_SQL} FROM event_lines) WHERE token IN ('t-17', 'signup') GROUP BY 1, 2 HAVING count(DISTINCT token) = 2", "event_lines")),
    "q17_indexed_search": (indexed, with_views(r"SELECT archive_id, file_path, line_no FROM event_lines WHERE regexp_matches(content, '\bt-17\b')", "event_lines")),
    "q17_gram_index": (lambda s, d: gram_index(s, d)[1].select("archive_id", "file_path", "chunk", F.size("grams").cast("long").alias("n_grams")), with_views("SELECT archive_id, file_path, chunk, count(DISTINCT substr(content, i, 3)) AS n_grams FROM (SELECT archive_id, file_path, CAST((line_no - 1) // 20 AS INT) AS chunk, lower(content) AS content, unnest(range(1, length(content) - 1)) AS i FROM event_lines) GROUP BY 1, 2, 3", "event_lines")),
    "q17_gram_chunks": (lambda s, d: G.chunks_left(gram_index(s, d)[1], GRAM_REGEX), with_views(f"SELECT archive_id, file_path, chunk FROM ({GRAM_CHUNKS.format(gram_test(G.query_plan(GRAM_REGEX)) + ' AS pass')}) WHERE pass", "event_lines")),
    "q17_gram_share": (lambda s, d: G.chunks_read(gram_index(s, d)[1], GRAM_WORD), with_views(f"SELECT count(*) AS chunks, count(*) FILTER (pass) AS read FROM ({GRAM_CHUNKS.format(gram_test(G.query_plan(GRAM_WORD)) + ' AS pass')})", "event_lines")),
    "q17_gram_regex_search": (gram_search(GRAM_REGEX), simple_sql(f"regexp_matches(content, '(?i){GRAM_REGEX.keyword}')").replace(", content FROM", " FROM")),
    "q17_gram_keyword_search": (gram_search(GRAM_WORD), simple_sql("contains(lower(content), 't-17 purch')").replace(", content FROM", " FROM")),
    "r01_r04_events": (events, diagnosed(f"SELECT {EVENT_COLUMNS} FROM found")),
    "r02_scopes": (scopes, with_views("SELECT DISTINCT archive_id, file_path, CASE WHEN file_path = 'app/node-3.log' THEN '0,1,2,3,4,5' ELSE '0,1,2,4,5' END AS allowed FROM event_lines", "event_lines")),
    "r03_guarded_events": (lambda s, d: events(s, d, True), diagnosed(f"SELECT {EVENT_COLUMNS} FROM found")),
    "r05_capped_events": (lambda s, d: D.cap_events(events(s, d), 50).select(*PLACE, "rule_id"), diagnosed("SELECT archive_id, file_path, line_no, rule_id FROM found QUALIFY row_number() OVER (PARTITION BY archive_id ORDER BY file_path, line_no, rule_id) <= 50")),
    "r06_severities": (lambda s, d: D.severity_summary(events(s, d)), diagnosed("SELECT archive_id, severity, count(*) AS n FROM found GROUP BY 1, 2")),
    "r06_storages": (lambda s, d: D.storage_summary(events(s, d)), diagnosed("SELECT archive_id, storage_type, count(*) AS n FROM found GROUP BY 1, 2")),
    "s12_report_store": (report_store, diagnosed(f"""SELECT f.archive_id, file_path, line_no, rule_id, severity, health_score FROM found f JOIN scored USING (archive_id)
WHERE archive_id <> '0' OR severity = 'FATAL'""", more="""scored AS (SELECT archive_id, CAST(greatest(0, 100 - 25 * count(*) FILTER (severity = 'FATAL') - 10 * count(*) FILTER (severity = 'CRITICAL') - 3 * count(*) FILTER (severity = 'WARNING')) AS INT) AS health_score
  FROM found GROUP BY 1)""")),
    "r07_r08_r10_report": (lambda s, d: D.diagnose(Views(s, d).event_lines(), RULES_SMALL)[1].drop("severity_summary"), REPORT_SQL),
    "r03_rule_table": (many_rules, MANY_RULES_SQL),
    "r09_default_rules": (default_rules, DEFAULT_RULES_SQL),
    "t01_head": (lambda s, d: T.head_per_file(Views(s, d).doc_lines(), 3), with_views("SELECT * FROM doc_lines WHERE line_no <= 3", "doc_lines")),
    "t02_masked_patterns": (masked, with_views("SELECT pattern, count, priority, level, sample, first_seen, last_seen, n_files FROM patterns", "event_lines", more=MASKED_AGG)),
    "t03_t05_templates": (lambda s, d: T.templates(Views(s, d).event_lines()), None),
    "t04_wildcard_templates": (lambda s, d: T.merge_templates(T.masked_patterns(Views(s, d).chat_lines()), wildcard_fallback=True), None),
    "t03_t05_merged_templates": (lambda s, d: shown_templates(T.templates(Views(s, d).service_lines())), with_walk("SELECT * FROM templates")),
    "t04_merged_wildcards": (lambda s, d: shown_templates(T.merge_templates(T.masked_patterns(Views(s, d).service_lines()), wildcard_fallback=True)), with_walk("SELECT * FROM templates", fallback=True)),
    "t06_top_patterns": (lambda s, d: T.masked_patterns(Views(s, d).event_lines()).orderBy(F.desc("count"), "pattern").limit(20).select("pattern", "count"), with_views("SELECT pattern, count FROM patterns ORDER BY count DESC, encode(pattern) LIMIT 20", "event_lines", more=MASKED_AGG)),
    "t07_frequency_by_level": (lambda s, d: T.pattern_frequency(Views(s, d).event_lines()), with_views("SELECT pattern, level, count(*) AS n FROM masked GROUP BY 1, 2", "event_lines", more=MASKED_AGG)),
    "t07_frequency_by_hour": (lambda s, d: T.pattern_frequency(Views(s, d).event_lines(), by="hour"), with_views("SELECT pattern, strftime(date_trunc('hour', try_cast(seen AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM masked GROUP BY 1, 2", "event_lines", more=MASKED_AGG)),
    "d01_scoped_files": (lambda s, d: X.scoped_files(Views(s, d).files(), "node-2"), with_views("SELECT DISTINCT substr(file_path, 8) AS path FROM files WHERE starts_with(file_path, 'node-2/')", "files")),
    "d02_changed_files": (lambda s, d: X.changed_files(*files_of(s, d)), with_views("SELECT 'added' AS change, path FROM (SELECT path FROM b EXCEPT SELECT path FROM a) UNION ALL SELECT 'removed', path FROM (SELECT path FROM a EXCEPT SELECT path FROM b)", "files", more="a AS (SELECT substr(file_path, 10) AS path FROM files WHERE starts_with(file_path, 'node-0/R/') AND size % 3 > 0), b AS (SELECT substr(file_path, 10) AS path FROM files WHERE starts_with(file_path, 'node-1/N/') AND size % 4 > 0)")),
    "d03_severity_by_side": (lambda s, d: diff_parts(s, d)["severities"], diagnosed("SELECT severity, count(*) FILTER (archive_id = '0') AS a, count(*) FILTER (archive_id = '1') AS b, count(*) FILTER (archive_id = '1') - count(*) FILTER (archive_id = '0') AS delta FROM found GROUP BY 1")),
    "d04_new_fatal": (lambda s, d: diff_parts(s, d)["new_fatal"].select("rule_name", "file_path", "line_no"), diagnosed("SELECT rule_name, file_path, line_no FROM fresh", NEW_FATAL)),
    "d05_new_templates": (new_templates, NEW_TEMPLATES_SQL),
    "d05_merged_templates": (new_merged, two_walks("SELECT pattern, count, level FROM templates_b WHERE (level IN ('ERROR', 'FATAL') OR count >= 2) AND pattern NOT IN (SELECT pattern FROM templates_a) ORDER BY count DESC, encode(pattern) LIMIT 15")),
    "d05_matched_templates": (matched, MATCHED_SQL),
    "d06_summary": (lambda s, d: diff_parts(s, d)["summary"].select("added", "removed", "events_a", "events_b", "new_fatal", "scope_type"), diagnosed("""SELECT (SELECT count(*) FROM (SELECT file_path FROM event_lines WHERE archive_id = '1' EXCEPT SELECT file_path FROM event_lines WHERE archive_id = '0')) AS added,
  (SELECT count(*) FROM (SELECT file_path FROM event_lines WHERE archive_id = '0' EXCEPT SELECT file_path FROM event_lines WHERE archive_id = '1')) AS removed,
  (SELECT count(*) FROM a) AS events_a, (SELECT count(*) FROM b) AS events_b, (SELECT count(*) FROM fresh) AS new_fatal, 'inter_archive' AS scope_type""", NEW_FATAL)),
}
