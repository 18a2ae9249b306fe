"""Queries of time series, capacity, alarms and evidence, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alarms as A
from ..operators import capacity as O
from ..operators import evidence as K
from ..operators import series as C
from ..schema import RetentionConfig
from ..scratch import shared_folder
from ..streaming import alarms as stream
from .line_queries import MASKED, STRIPPED
from .search_queries import WEIGHT, diagnosed, events
from .views import Views, with_views

NOW = "1998-06-01 00:00:00"
RETENTION = RetentionConfig(days=365, exempt_tags=(" case-3 ",))
START, END = "2024-01-05", "2024-01-20"

# ---- series ----
STEPS = """steps AS (
  SELECT m.*, p.value AS prev, abs(m.value - p.value) AS d FROM metrics m JOIN metrics p ON m.series = p.series AND m.idx = p.idx + 1),
stats AS (SELECT series, avg(d) AS mu, CASE WHEN stddev_pop(d) < 1e-6 THEN 1.0 ELSE stddev_pop(d) END AS sd FROM steps GROUP BY 1),
anomalies AS (
  SELECT file_path, series, idx, t, value, CASE WHEN value >= 95 OR d >= 50 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    printf('%s %s %.1f%s (before: %.1f%s, change: %s%.1f)', series, CASE WHEN value < prev THEN 'fell to' ELSE 'rose to' END, floor(value * 10 + 0.5) / 10, unit, floor(prev * 10 + 0.5) / 10, unit, CASE WHEN value < prev THEN '-' ELSE '+' END, floor(d * 10 + 0.5) / 10) AS reason, line_no
  FROM steps JOIN stats USING (series) WHERE value >= 90 OR (d > mu + 3 * sd AND d > 10))"""
TARGET = 100
DOWN = f"""n AS (SELECT max(idx) + 1 AS n FROM metrics),
bounds AS (SELECT b, CAST(floor(b * (n / {TARGET // 2}.0::DOUBLE)) AS BIGINT) AS lo, least(n, CAST(floor((b + 1) * (n / {TARGET // 2}.0::DOUBLE)) AS BIGINT)) AS hi FROM n, range(0, {TARGET // 2}) r(b)),
picks AS (SELECT series, b, arg_min(idx, (value, idx)) AS i, arg_max(idx, (value, -idx)) AS j FROM metrics JOIN bounds ON idx >= lo AND idx < hi GROUP BY 1, 2),
keep AS (SELECT i AS idx FROM picks UNION SELECT j FROM picks UNION SELECT 0 UNION SELECT n - 1 FROM n),
numbered AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new_idx FROM keep)"""


def downsampled(spark, d):
    return C.downsample_minmax(Views(spark, d).metrics(), None, TARGET)


def iostat_lines(spark, d):
    """A device report every 50 events: a time line, a header, and one data line per event."""
    e = Views(spark, d).table("events").select("event_id", "ts", "event_type", "value")
    data = F.concat(F.col("event_type"), F.lit(" 1 2 3 4 5 6 7 8 9 10 "), F.format_string("%.2f", "value"))
    head = F.when(F.col("event_id") % 50 == 0, F.array(F.concat(F.lit("Time: "), F.date_format("ts", "HH:mm:ss")), F.lit("Device r w a b c d e f g h i %util"), data)).otherwise(F.array(data))
    rows = e.select(F.lit("sysstat/iostat.log").alias("file_path"), "event_id", F.posexplode(head).alias("k", "content"))
    return rows.select("file_path", (F.col("event_id") * 3 + F.col("k") + 1).alias("line_no"), "content")


def iostat(spark, d):
    registry = C.ParserRegistry()
    registry.register("iostat", r"(?i).*iostat.*\.log$", C.parse_iostat)
    registry.register("other", "vmstat*.log", C.parse_vmstat)
    return registry.parse(iostat_lines(spark, d).select("file_path", "line_no", "content"))


IOSTAT_SQL = """WITH e AS (SELECT *, max(CASE WHEN event_id % 50 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS tick FROM events)
SELECT 'sysstat/iostat.log' AS file_path, e.event_type AS series, '%' AS unit, row_number() OVER (PARTITION BY e.event_type ORDER BY e.event_id) - 1 AS idx,
  coalesce(strftime(k.ts, '%H:%M:%S'), (e.event_id * 3 + 1)::VARCHAR) AS t, CAST(printf('%.2f', e.value) AS DOUBLE) AS value, e.event_id * 3 + CASE WHEN e.event_id % 50 = 0 THEN 3 ELSE 1 END AS line_no
FROM e LEFT JOIN events k ON k.event_id = e.tick"""


def vmstat(spark, d):
    """Samples with 17 fields, one an order."""
    o = Views(spark, d).table("orders")
    row = F.concat(F.lit("1 0 0 1 2 3 4 5 6 7 8 9 "), F.format_string("%d %d %d %d 0", F.col("o_orderkey") % 97, F.col("o_custkey") % 41, F.lit(5), F.col("o_orderkey") % 13))
    lines = o.select(F.concat(F.lit("vmstat-"), (F.col("o_custkey") % 4).cast("string")).alias("file_path"), F.col("o_orderkey").cast("long").alias("line_no"), row.alias("content"))
    return C.parse_vmstat(lines)


VMSTAT_SQL = """WITH l AS (SELECT 'vmstat-' || (o_custkey % 4)::VARCHAR AS file_path, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS idx, * FROM orders)
SELECT file_path, series, '%' AS unit, idx, idx::VARCHAR AS t, CAST(value AS DOUBLE) AS value, line_no FROM (
  SELECT file_path, idx, CAST(o_orderkey AS BIGINT) AS line_no, unnest(['us', 'sy', 'wa']) AS series, unnest([o_orderkey % 97, o_custkey % 41, o_orderkey % 13]) AS value FROM l)"""


def time_values(spark, d):
    e = Views(spark, d).table("events")
    lines = e.select(F.lit("load.txt").alias("file_path"), (F.col("event_id") + 1).alias("line_no"), F.concat(F.date_format("ts", "HH:mm:ss"), F.format_string("  %.2f", "value")).alias("content"))
    return C.threshold_anomalies(C.parse_time_value(lines), 90, 95)


def marked_lines(spark, d):
    """Anomalies with the event line they stand on (by number), as texts."""
    v = Views(spark, d)
    a = C.detect_anomalies(v.metrics())
    lines = v.table("events").select(F.lit("events").alias("file_path"), F.col("event_id").alias("line_no"), F.col("event_type").alias("content"))
    return C.anomaly_lines(a, lines).select("series", "idx", "line_no", "content")


def lines_by_time(spark, d):
    """Anomalies whose line is not known: the first line of the file that holds their time."""
    v = Views(spark, d)
    a = C.detect_anomalies(v.metrics()).withColumn("line_no", F.lit(None).cast("long"))
    e = v.table("events")
    text = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_type")
    lines = e.select(F.lit("events").alias("file_path"), F.col("event_id").alias("line_no"), text.alias("content"))
    return C.anomaly_lines(a, lines).select("series", "idx", "line_no", "content")


LINES_BY_TIME_SQL = """SELECT series, idx, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || event_type AS content FROM (
  SELECT series, idx, (SELECT min(e.event_id) FROM events e WHERE strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') = a.t) AS line_no FROM anomalies a) JOIN events ON event_id = line_no"""


def own_limits(spark, d):
    """What a chart of the device reports marks: points beyond the parser's own limits."""
    registry = C.ParserRegistry()
    registry.register("iostat", r"(?i).*iostat.*\.log$", C.parse_iostat, limits=C.IOSTAT_LIMITS)
    return C.chart(iostat_lines(spark, d), registry)[1]


OWN_LIMITS_SQL = f"""SELECT file_path, series, idx, t, value, CASE WHEN value >= 95 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  printf('%s is at %.1f%s', series, floor(value * 10 + 0.5) / 10, unit) AS reason, line_no FROM ({IOSTAT_SQL}) WHERE value >= 85"""


def chart_summary(spark, d):
    m = Views(spark, d).metrics()
    return C.chart_summary(m, C.downsample_minmax(m, None, TARGET))


# ---- alarms ----
EPISODES = """rows_ AS (SELECT *, coalesce(count(*) FILTER (action IN ('resolve', 'delete')) OVER (PARTITION BY node_id, alarm_type ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM {source}),
grouped AS (
  SELECT node_id, alarm_type, ep, count(*) FILTER (action = 'report') AS count, arg_max(severity, (ts, seq)) FILTER (action = 'report' AND severity <> '') AS severity,
    arg_max(title, (ts, seq)) FILTER (action = 'report' AND title <> '') AS title, arg_max(message, (ts, seq)) FILTER (action = 'report') AS message,
    min(ts) FILTER (action = 'report') AS first_occur, max(ts) FILTER (action = 'report') AS last_occur, max(ts) FILTER (action = 'resolve') AS resolved_at, bool_or(action = 'ack') AS acked, coalesce(bool_or(action = 'delete'), false) AS deleted
  FROM rows_ GROUP BY 1, 2, 3),
alarms AS (SELECT node_id, alarm_type, row_number() OVER (PARTITION BY node_id, alarm_type ORDER BY ep) AS episode, severity, title, message,
  CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN acked THEN 'acknowledged' ELSE 'active' END AS status, count, epoch_us(first_occur) AS first_us, epoch_us(last_occur) AS last_us, epoch_us(resolved_at) AS resolved_us
  FROM grouped WHERE count > 0 AND NOT deleted)"""
FROM_EVENTS = EPISODES.format(source="alarm_events")


def alarms(spark, d):
    return A.aggregate_alarms(Views(spark, d).alarm_events())


def micros(df):
    names = {"first_occur": "first_us", "last_occur": "last_us", "resolved_at": "resolved_us"}
    return df.select(*[F.unix_micros(c).alias(names[c]) if c in names else F.col(c) for c in df.columns])


def signals(spark, d):
    return A.hysteresis(A.health_signals(Views(spark, d).node_heartbeats())).select("node_id", F.unix_micros("ts").alias("us"), "alarm_type", "signal", "state")


SIGNALS_SQL = with_views(
    """SELECT node_id, epoch_us(ts) AS us, alarm_type, signal, last_value(signal IGNORE NULLS) OVER (PARTITION BY node_id, alarm_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS state FROM (
  SELECT node_id, ts, 'DISK_FULL' AS alarm_type, CASE WHEN disk_free_mb <= 0 THEN NULL WHEN disk_free_mb < 1024 THEN 'report' WHEN disk_free_mb > 2048 THEN 'resolve' END AS signal FROM node_heartbeats
  UNION ALL SELECT node_id, ts, 'HIGH_MEMORY', CASE WHEN mem_used_mb / mem_total_mb > 0.92 THEN 'report' WHEN mem_used_mb / mem_total_mb < 0.80 THEN 'resolve' END FROM node_heartbeats)""",
    "heartbeats",
)
GAP_S = 10_000.0
GAPS = f"""gaps AS (SELECT * FROM (SELECT node_id, ts, lead(ts) OVER (PARTITION BY node_id ORDER BY ts) AS back_at FROM node_heartbeats)
  WHERE epoch_us(coalesce(back_at, TIMESTAMP '2024-02-01')) - epoch_us(ts) > {GAP_S} * 1e6),
offline AS (SELECT node_id, 'NODE_OFFLINE' AS alarm_type, 'CRITICAL' AS severity, 'Node offline' AS title, 'No heartbeat' AS message, 'report' AS action, ts + INTERVAL {int(GAP_S)} SECOND AS ts, 0 AS seq FROM gaps
  UNION ALL SELECT node_id, 'NODE_OFFLINE', '', '', '', 'resolve', back_at, 1 FROM gaps WHERE back_at IS NOT NULL)"""


def gaps(spark, d):
    return A.offline_gaps(Views(spark, d).node_heartbeats(), "2024-02-01", GAP_S)


class Replay(Views):
    """The views over streams of the tables' files."""

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        df = self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path + "*")  # a file source takes a single file by a pattern only
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def replayed(spark, rows: DataFrame) -> DataFrame:
    """What a stream has put out once all there is was read."""
    path = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    q = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def hold_replay(spark, d):
    out = stream.hysteresis_by_event_time(A.health_signals(Replay(spark, d).node_heartbeats()))
    return replayed(spark, out).select("node_id", F.unix_micros("ts").alias("us"), "alarm_type", "signal", "state")


def offline_replay(spark, d):
    out = stream.offline_by_event_time(Replay(spark, d).node_heartbeats(), GAP_S)
    return replayed(spark, out).select("node_id", "alarm_type", "action", F.unix_micros("ts").alias("us"))


# What streams have put out when their input ends: all before the watermark, one minute behind the latest millisecond.
WATERMARK_SQL = "mark AS (SELECT (epoch_us(max(ts)) // 1000 - 60000) * 1000 AS us FROM events)"
HOLD_REPLAY_SQL = with_views(
    """SELECT node_id, epoch_us(ts) AS us, alarm_type, signal, last_value(signal IGNORE NULLS) OVER (PARTITION BY node_id, alarm_type ORDER BY ts, signal NULLS FIRST ROWS UNBOUNDED PRECEDING) AS state FROM (
  SELECT node_id, ts, 'DISK_FULL' AS alarm_type, CASE WHEN disk_free_mb <= 0 THEN NULL WHEN disk_free_mb < 1024 THEN 'report' WHEN disk_free_mb > 2048 THEN 'resolve' END AS signal FROM node_heartbeats
  UNION ALL SELECT node_id, ts, 'HIGH_MEMORY', CASE WHEN mem_used_mb / mem_total_mb > 0.92 THEN 'report' WHEN mem_used_mb / mem_total_mb < 0.80 THEN 'resolve' END FROM node_heartbeats)
WHERE epoch_us(ts) < (SELECT us FROM mark)""",
    "heartbeats",
    more=WATERMARK_SQL,
)
OFFLINE_REPLAY_SQL = with_views(
    f"""SELECT node_id, 'NODE_OFFLINE' AS alarm_type, action, us FROM (
  SELECT node_id, 'report' AS action, seen_us + {int(GAP_S)} * 1000000::BIGINT AS us FROM silences UNION ALL SELECT node_id, 'resolve', back FROM silences WHERE back IS NOT NULL)""",
    "heartbeats",
    more=WATERMARK_SQL
    + f""", silences AS (SELECT * FROM (SELECT node_id, epoch_us(ts) AS seen_us, lead(epoch_us(ts)) OVER (PARTITION BY node_id ORDER BY ts) AS back FROM node_heartbeats WHERE epoch_us(ts) < (SELECT us FROM mark))
  WHERE coalesce(back, (SELECT us FROM mark)) - seen_us > {GAP_S} * 1e6)""",
)


def after_actions(spark, d):
    """Every open alarm on DISK_FULL acknowledged, on HIGH_MEMORY resolved, others deleted; resolved ones cleared."""
    e = Views(spark, d).alarm_events()
    end = e.groupBy("node_id", "alarm_type").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    action = F.when(F.col("alarm_type") == "DISK_FULL", "ack").when(F.col("alarm_type") == "HIGH_MEMORY", "resolve").otherwise("delete")
    extra = end.select("node_id", "alarm_type", F.lit("").alias("severity"), F.lit("").alias("title"), F.lit("").alias("message"), action.alias("action"), "ts", (F.col("seq") + 1).alias("seq"))
    return micros(A.clear_resolved(A.aggregate_alarms(e.unionByName(extra)))).select("node_id", "alarm_type", "status", "count")


DEBOUNCE_SQL = with_views(
    "SELECT node_id, alarm_type, seq FROM sent JOIN reports USING (node_id, alarm_type, n)",
    "alarm_events",
    more="""reports AS (SELECT node_id, alarm_type, ts, seq, row_number() OVER (PARTITION BY node_id, alarm_type ORDER BY ts, seq) AS n FROM alarm_events WHERE action = 'report'),
after AS (SELECT a.node_id, a.alarm_type, a.n, min(b.n) AS next FROM reports a JOIN reports b ON a.node_id = b.node_id AND a.alarm_type = b.alarm_type AND b.ts >= a.ts + INTERVAL 86400 SECOND GROUP BY 1, 2, 3),
sent AS (SELECT DISTINCT node_id, alarm_type, 1::BIGINT AS n FROM reports UNION ALL SELECT node_id, alarm_type, next FROM sent JOIN after USING (node_id, alarm_type, n))""",
).replace("WITH", "WITH RECURSIVE", 1)

# ---- evidence ----
NOISE = [("N-1", "small", "value=1[0-9]\\."), ("N-2", "clicks", "(?i)CLICK")]
GLOSSARY = [("BUYING", ["PURCHASE VALUE"]), ("NODE", ["look at the node", "absent"]), ("NEVER", ["zzz"]), ("FAULTS", [" events: "])]
FLOWS = [("FLOW_A", [("NOTHING", "zzz"), ("SIGN_UP", "signup value=99")]), ("FLOW_B", [("PURCHASES", "zzz"), ("VIEWED", "view value=0")])]
NOISY = """noisy AS (SELECT *, CASE WHEN regexp_matches(content, 'value=1[0-9]\\.') THEN 'N-1' WHEN regexp_matches(content, '(?i)CLICK') THEN 'N-2' END AS ignored_by FROM found), clean AS (SELECT * FROM noisy WHERE ignored_by IS NULL)"""
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY {WEIGHT} DESC, file_path, line_no, rule_id) AS rank, count(*) OVER (PARTITION BY archive_id) AS total FROM clean QUALIFY rank <= 15)"""
STAGES_SQL = """stages AS (SELECT archive_id, 'FLOW_A' AS workflow, 2 AS step, 'SIGN_UP' AS stage FROM clean WHERE regexp_matches(rule_name || ' ' || content, '(?i)sign_up|sign up|signup value=99') GROUP BY 1),
staged AS (SELECT * FROM stages UNION ALL SELECT archive_id, 'FLOW_B', min(step), CASE min(step) WHEN 1 THEN 'PURCHASES' ELSE 'VIEWED' END FROM (
  SELECT archive_id, CASE WHEN regexp_matches(rule_name || ' ' || content, '(?i)purchases') THEN 1 WHEN regexp_matches(rule_name || ' ' || content, '(?i)viewed|view value=0') THEN 2 END AS step FROM clean)
  WHERE step IS NOT NULL AND archive_id NOT IN (SELECT archive_id FROM stages) GROUP BY 1)"""


def noisy(spark, d):
    return K.suppress_noise(events(spark, d), NOISE)


def clean(spark, d):
    return noisy(spark, d).where("ignored_by IS NULL")


def document(spark, d):
    from ..operators.diagnose import diagnose
    from .views import RULES_SMALL

    found, report = diagnose(Views(spark, d).event_lines(), RULES_SMALL, once=True)
    marked = K.suppress_noise(found, NOISE)
    ok = marked.where("ignored_by IS NULL")
    return K.evidence_document(report, marked, K.match_glossary(ok, GLOSSARY, report), K.project_workflow(ok, FLOWS))


def glossary(spark, d):
    from ..operators.diagnose import diagnose
    from .views import RULES_SMALL

    found, report = diagnose(Views(spark, d).event_lines(), RULES_SMALL)
    return K.match_glossary(K.suppress_noise(found, NOISE).where("ignored_by IS NULL"), GLOSSARY, report)


def marked_noise(spark, d):
    e = events(spark, d)
    known = e.where("rule_id = 'r3'").select(F.lit("[WARN] trace_id=t-3 signup value=<*>.<*>").alias("pattern")).distinct()
    return K.noise_from_marked(e.where("rule_id IN ('r1', 'r3')"), known)


KEEP_MASKED = MASKED.replace(STRIPPED, STRIPPED.replace("content", "trim(content)"))

QUERIES = {
    "c01_match_parsers": (lambda s, d: _registry().match(Views(s, d).files()), with_views("SELECT DISTINCT file_path, 'seven' AS parser FROM files WHERE regexp_matches(file_path, 'R/F/.*7') UNION ALL SELECT DISTINCT file_path, 'tens' FROM files WHERE regexp_matches(file_path, 'part-1?.log|/part-1.\\.log$')", "files")),
    "c02_c05_iostat": (iostat, IOSTAT_SQL),
    "c03_vmstat": (vmstat, VMSTAT_SQL),
    "c04_time_values": (time_values, """SELECT 'load.txt' AS file_path, 'value' AS series, event_id AS idx, strftime(ts, '%H:%M:%S') AS t, v AS value, CASE WHEN v >= 95 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, printf('value is at %.1f%%', floor(v * 10 + 0.5) / 10) AS reason, event_id + 1 AS line_no
FROM (SELECT *, CAST(printf('%.2f', value) AS DOUBLE) AS v FROM events) WHERE v >= 90"""),
    "c06_slice_window": (lambda s, d: C.slice_window(Views(s, d).metrics(), START, END).select("series", "idx", "t", "value"), with_views(f"""SELECT series, idx - a AS idx, t, value FROM metrics, (SELECT coalesce(min(idx) FILTER (t >= '{START}'), 0) AS a, coalesce(max(idx) FILTER (t <= '{END}'), max(idx)) AS b FROM metrics) WHERE idx BETWEEN a AND b""", "metrics")),
    "c07_anomalies": (lambda s, d: C.detect_anomalies(Views(s, d).metrics()), with_views("SELECT * FROM anomalies", "metrics", more=STEPS)),
    "c08_downsample": (lambda s, d: downsampled(s, d).select("series", "idx", "new_idx", "value"), with_views("SELECT series, idx, new_idx, value FROM metrics JOIN numbered USING (idx)", "metrics", more=DOWN)),
    "c09_anomalies_of": (lambda s, d: C.anomalies_of(C.detect_anomalies(Views(s, d).metrics()), "click").select("series", "idx", "severity"), with_views("SELECT series, idx, severity FROM anomalies WHERE series = 'click'", "metrics", more=STEPS)),
    "c10_anomaly_lines": (marked_lines, with_views("SELECT series, idx, line_no, event_type AS content FROM anomalies JOIN events ON event_id = line_no", "metrics", more=STEPS)),
    "c10_lines_by_time": (lines_by_time, with_views(LINES_BY_TIME_SQL, "metrics", more=STEPS)),
    "c12_own_limits": (own_limits, OWN_LIMITS_SQL),
    "c11_chart_summary": (chart_summary, with_views("SELECT 'events' AS file_path, (SELECT n FROM n) AS total_points, (SELECT arg_min(t, (idx, series)) FROM metrics) AS start_t, (SELECT arg_max(t, (idx, series)) FROM metrics) AS end_t, (SELECT count(*) FROM keep) AS points, (SELECT count(*) FROM keep) < (SELECT n FROM n) AS downsampled, printf('lows and highs (%d points)', (SELECT count(*) FROM keep)) AS resolution", "metrics", more=DOWN)),
    "o01_list_archives": (lambda s, d: O.list_archives(Views(s, d).archives(), None, "case-2", "7").select("id"), with_views("SELECT id FROM archives WHERE list_bool_or(list_transform(tags, lambda t: contains(lower(t), 'case-2'))) AND (contains(filename, '7') OR contains(remark, '7') OR list_bool_or(list_transform(tags, lambda t: contains(t, '7'))))", "archives")),
    "o02_duplicate_tags": (lambda s, d: O.duplicate_tags(Views(s, d).archives()), with_views("SELECT tag, count(*) AS n_archives FROM (SELECT DISTINCT id, lower(trim(tag)) AS tag FROM (SELECT id, unnest(tags) AS tag FROM archives)) GROUP BY 1 HAVING count(*) > 1", "archives")),
    "o03_user_usage": (lambda s, d: O.user_usage(Views(s, d).archives(), Views(s, d).users(), 1_000_000), with_views("""SELECT u."user", quota_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS used_bytes, count(id) AS n_archives, quota_bytes > 0 AND coalesce(sum(size), 0) + 1000000 > quota_bytes AS over FROM users u LEFT JOIN archives a ON a."user" = u."user" GROUP BY 1, 2""", "archives")),
    "o04_node_usage": (lambda s, d: O.node_usage(Views(s, d).archives()), with_views("SELECT node_id, bytes, n_archives, round(bytes / sum(bytes) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY bytes DESC) AS INT) AS rank FROM (SELECT node_id, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n_archives FROM archives GROUP BY 1)", "archives")),
    "o05_exempt": (lambda s, d: Views(s, d).archives().where(O.is_exempt(RETENTION)).select("id"), with_views("SELECT id FROM archives WHERE pinned OR list_contains(list_transform(tags, lambda t: lower(trim(t))), 'case-3')", "archives")),
    "o06_expired": (lambda s, d: O.expired(Views(s, d).archives(), RETENTION, NOW).select("id"), with_views(f"SELECT id FROM archives WHERE NOT (pinned OR list_contains(list_transform(tags, lambda t: lower(trim(t))), 'case-3')) AND upload_time < TIMESTAMP '{NOW}' - INTERVAL 365 DAY", "archives")),
    "o07_watermark_victims": (lambda s, d: O.watermark_victims(Views(s, d).archives(), Views(s, d).nodes(), RETENTION).select("id", "node_id", F.col("prior_mb").cast("long").alias("prior_mb")), with_views("""SELECT id, node_id, prior_mb FROM (
  SELECT id, a.node_id, n.disk_total_mb, n.disk_used_mb, CAST(coalesce(sum(size // 1048576) OVER (PARTITION BY a.node_id ORDER BY upload_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_mb
  FROM archives a JOIN nodes n ON n.node_id = a.node_id AND n.status = 'online' AND n.disk_used_mb / n.disk_total_mb * 100 >= 92 WHERE NOT (pinned OR list_contains(list_transform(tags, lambda t: lower(trim(t))), 'case-3')))
WHERE (disk_used_mb - prior_mb) / disk_total_mb * 100 > 75""", "archives")),
    "o08_ops_metrics": (lambda s, d: O.ops_metrics(Views(s, d).nodes(), Views(s, d).archives(), Views(s, d).table("events").select(F.lit(0.5).alias("seconds"))), with_views("""SELECT unnest(['nodes_total', 'nodes_online', 'disk_total_mb', 'disk_used_mb', 'archives_total', 'archives_bytes', 'search_requests', 'search_seconds']) AS metric,
  unnest([(SELECT count(*) FROM nodes)::DOUBLE, (SELECT count(*) FROM nodes WHERE status = 'online')::DOUBLE, (SELECT sum(disk_total_mb) FROM nodes)::DOUBLE, (SELECT sum(disk_used_mb) FROM nodes)::DOUBLE,
    (SELECT count(*) FROM archives)::DOUBLE, (SELECT sum(size) FROM archives)::DOUBLE, (SELECT count(*) FROM events)::DOUBLE, (SELECT count(*) * 0.5 FROM events)::DOUBLE]) AS value""", "archives")),
    "o09_latest_nodes": (lambda s, d: O.latest_nodes(Views(s, d).heartbeats()).select("ip", "port", "node_id", F.unix_micros("ts").alias("us"), "status", "disk_free_mb"), with_views("SELECT ip, port, arg_min(node_id, (ts, node_id)) AS node_id, epoch_us(max(ts)) AS us, CASE WHEN bool_or(status = 'maintenance') THEN 'maintenance' ELSE arg_max(status, (ts, node_id)) END AS status, arg_max(disk_free_mb, (ts, node_id)) AS disk_free_mb FROM heartbeats GROUP BY 1, 2", "heartbeats")),
    "o10_failures": (lambda s, d: O.classify_failures(Views(s, d).archives()), with_views("SELECT CASE WHEN contains(error_msg, 'No space') THEN 'disk_full' WHEN contains(error_msg, 'Permission') THEN 'permission' WHEN contains(error_msg, 'refused') THEN 'network' WHEN contains(error_msg, 'EOF') THEN 'corrupt_archive' ELSE 'other' END AS failure_class, node_id, count(*) AS n, min(error_msg) AS message FROM archives WHERE status = 'failed' GROUP BY 1, 2", "archives")),
    "a01_health_signals": (signals, SIGNALS_SQL),
    "a02_debounce": (lambda s, d: A.debounce(Views(s, d).alarm_events().where("action = 'report'"), 86_400).select("node_id", "alarm_type", "seq"), DEBOUNCE_SQL),
    "a03_alarms": (lambda s, d: micros(alarms(s, d)).select("node_id", "alarm_type", "episode", "severity", "title", "message", "status", "count", "first_us", "last_us", "resolved_us"), with_views("SELECT * FROM alarms", "alarm_events", more=FROM_EVENTS)),
    "a01_hold_replay": (hold_replay, HOLD_REPLAY_SQL),
    "a04_offline_replay": (offline_replay, OFFLINE_REPLAY_SQL),
    "a04_offline_gaps": (lambda s, d: gaps(s, d).select("node_id", F.unix_micros("ts").alias("us"), F.unix_micros("back_at").alias("back_us")), with_views("SELECT node_id, epoch_us(ts) AS us, epoch_us(back_at) AS back_us FROM gaps", "heartbeats", more=GAPS)),
    "a05_offline_alarms": (lambda s, d: micros(A.aggregate_alarms(A.offline_events(gaps(s, d), GAP_S))).select("node_id", "episode", "status", "count", "first_us", "resolved_us"), with_views("SELECT node_id, episode, status, count, first_us, resolved_us FROM alarms", "heartbeats", more=GAPS + ", " + EPISODES.format(source="offline"))),
    "a06_actions": (after_actions, with_views("SELECT node_id, alarm_type, status, count FROM alarms WHERE status <> 'resolved'", "alarm_events", more="acted AS (SELECT * FROM alarm_events UNION ALL SELECT node_id, alarm_type, '', '', '', CASE alarm_type WHEN 'DISK_FULL' THEN 'ack' WHEN 'HIGH_MEMORY' THEN 'resolve' ELSE 'delete' END, max(ts), max(seq) + 1 FROM alarm_events GROUP BY 1, 2), " + EPISODES.format(source="acted"))),
    "a07_list_alarms": (lambda s, d: micros(A.list_alarms(alarms(s, d))).select("node_id", "alarm_type", "episode", "status", "last_us"), with_views("SELECT node_id, alarm_type, episode, status, last_us FROM alarms WHERE status <> 'resolved'", "alarm_events", more=FROM_EVENTS)),
    "a08_alarm_summary": (lambda s, d: A.alarm_summary(alarms(s, d)), with_views("SELECT count(*) AS active, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (coalesce(severity, '') NOT IN ('critical', 'warning')) AS info FROM alarms WHERE status <> 'resolved'", "alarm_events", more=FROM_EVENTS)),
    "k01_noise": (lambda s, d: noisy(s, d).select("file_path", "line_no", "rule_id", "ignored_by"), diagnosed("SELECT file_path, line_no, rule_id, ignored_by FROM noisy", NOISY)),
    "k02_glossary": (glossary, diagnosed("SELECT DISTINCT archive_id, 'FAULTS' AS term FROM found UNION ALL SELECT DISTINCT archive_id, term FROM (SELECT archive_id, unnest(['BUYING', 'NODE']) AS term, unnest([contains(upper(content), 'PURCHASE VALUE'), contains(upper(rule_name || ' ' || content || ' ' || suggestion), 'NODE')]) AS hit FROM clean) WHERE hit", NOISY)),
    "k03_workflow": (lambda s, d: K.project_workflow(clean(s, d), FLOWS), diagnosed("SELECT * FROM staged", NOISY + ", " + STAGES_SQL)),
    "k04_ranked": (lambda s, d: K.rank_evidence(clean(s, d)).select("archive_id", "file_path", "line_no", "rule_id", "rank", F.col("omitted").cast("long").alias("omitted")), diagnosed("SELECT archive_id, file_path, line_no, rule_id, CAST(rank AS INT) AS rank, greatest(0, total - 15) AS omitted FROM ranked", NOISY + ", " + RANKED)),
    "k05_documents": (document, None),
    "k06_root_cause": (lambda s, d: K.root_cause_row(K.rank_evidence(clean(s, d)), K.project_workflow(clean(s, d), FLOWS)), diagnosed("""SELECT r.archive_id, arg_min(rule_name || ' (' || content || ')', rank) AS root_cause,
  CASE WHEN any_value(stage) IS NOT NULL THEN any_value(stage) || ' -> ' || arg_min(rule_name, rank) || ' -> timeout' ELSE arg_min(rule_name, rank) END AS chain, CAST(sum(strlen(content)) // 4 AS BIGINT) AS est_tokens
FROM ranked r LEFT JOIN staged s ON s.archive_id = r.archive_id GROUP BY 1""", NOISY + ", " + RANKED + ", " + STAGES_SQL)),
    "k07_marked_noise": (marked_noise, diagnosed(f"""SELECT pattern, min(storage_type) AS storage_type FROM (SELECT {KEEP_MASKED} AS pattern, storage_type FROM found WHERE rule_id IN ('r1', 'r3'))
WHERE pattern NOT IN (SELECT '[WARN] trace_id=t-3 signup value=<*>.<*>' FROM found WHERE rule_id = 'r3') GROUP BY 1""")),
}


def _registry() -> C.ParserRegistry:
    r = C.ParserRegistry()
    r.register("seven", "R/F/.*7", C.parse_vmstat)
    r.register("tens", "part-1?.log", C.parse_iostat)
    r.register("off", ".*", C.parse_iostat, enabled=False)
    return r
