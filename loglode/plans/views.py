"""Log-shaped views of the driver's tables, as DataFrames and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Rule

# Six rules that meet the views' lines; their texts are fixed values of the views.
RULES_SMALL = [
    Rule("r1", "errors", "Ceph", "CRITICAL", r"\[ERROR\].*value=1", suggestion="look at the node"),
    Rule("r2", "purchases", "HDFS", "FATAL", r"\[FATAL\] trace_id=t-[0-9]+ purchase value=[0-9]{3}", suggestion="check the order"),
    Rule("r3", "signups", "MinIO", "WARNING", "SIGNUP VALUE=9", is_regex=False, suggestion="none"),
    Rule("r4", "views on node 3", "Generic", "INFO", "(?i)VIEW value=[0-4]", file_path_pattern="node-3.log"),
    Rule("r5", "app clicks", "Generic", "WARNING", "click value=[0-9][.]", file_path_pattern="app/*.log; other.log"),
    Rule("r6", "off", "Generic", "FATAL", ".", enabled=False),
]


SERIES = ["click", "view", "error", "signup", "purchase"]


FAULTS = ["osd.3 marked DOWN", "12 slow requests on", "Heartbeat expired for", "MISSING BLOCKS: ", "drive 4 went offline:", "XFS (sda1): error 5 at", "Read-only file system", "quorum lost by", "invoked oom-killer: gfp", "panic: runtime error in", "Full GC took 3.2 secs for", "raft: peer 2 election timeout", "connection pool full for", "x509: certificate has expired for", "CONNECTION RESET BY PEER from"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table, with its times without a zone taken as UTC (the session's zone)."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def event_lines(self) -> DataFrame:
        """Lines of eight files; places follow from event ids, so no line waits for another."""
        e = self.table("events").select("event_id", "ts", "user_id", "event_type", "value")
        node = F.col("event_id") % 8
        level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "purchase", "FATAL").otherwise("INFO")
        content = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string(" [%s] trace_id=t-%d %s value=%.2f", level, "user_id", "event_type", "value"))
        return e.select(
            (F.col("event_id") % 2).cast("string").alias("archive_id"), F.format_string("app/node-%d.log", node).alias("file_path"),
            F.expr("event_id div 8 + 1").alias("line_no"), content.alias("content"),
        )

    def fault_lines(self) -> DataFrame:
        """Kernel and service messages, one an event: every fourth names a fault."""
        e = self.table("events")
        said = F.element_at(F.array(*map(F.lit, FAULTS)), F.expr("CAST(event_id div 4 % {n} + 1 AS INT)".format(n=len(FAULTS))))
        text = F.when(F.col("event_id") % 4 == 0, said).otherwise("request served")
        return e.select(F.lit("faults").alias("archive_id"), F.concat(F.lit("var/log/"), (F.col("user_id") % 10).cast("string"), F.lit(".log")).alias("file_path"), F.col("event_id").alias("line_no"), F.concat_ws(" ", text, F.col("user_id").cast("string")).alias("content"))

    def service_lines(self) -> DataFrame:
        """Five kinds of messages with words that vary (numbers spelt in letters), two of them with a number now and then."""
        e = self.table("events")
        spelt = lambda c: F.translate(F.expr(c).cast("string"), "0123456789", "abcdefghij")
        u, v, w = spelt("user_id"), spelt("CAST(floor(value) AS BIGINT)"), spelt("event_id div 8")
        third = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(spelt("user_id % 7"))
        said = {
            "click": F.concat_ws(" ", F.lit("gateway routed request from"), u, F.lit("to"), v, F.lit("after wait")), "view": F.concat_ws(" ", F.lit("cache shard"), third, F.lit("missed"), v),
            "error": F.concat_ws(" ", F.lit("ERROR disk failed on"), u, F.lit("at"), v, F.lit("now")), "signup": F.concat_ws(" ", F.lit("WARN user"), third, F.lit("joined"), v, F.lit("by mail")),
        }
        text = F.concat_ws(" ", F.lit("job run done"), spelt("user_id % 13"), v, w, spelt("user_id % 29"), F.lit("end"))
        for kind, words in said.items():
            text = F.when(F.col("event_type") == kind, words).otherwise(text)
        content = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), text)
        return e.select((F.col("event_id") % 2).cast("string").alias("archive_id"), F.format_string("srv/%d.log", F.col("event_id") % 8).alias("file_path"), F.expr("event_id div 8 + 1").alias("line_no"), content.alias("content"))

    def doc_lines(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
        return d.select(F.lit("docs").alias("archive_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), (F.col("pos") + 1).cast("long").alias("line_no"), "content")

    def chat_lines(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.lit("chat").alias("archive_id"), F.col("conv_id").cast("string").alias("file_path"), (F.col("turn") + 1).alias("line_no"), F.concat("role", F.lit(": "), "text").alias("content"))

    def page_lines(self) -> DataFrame:
        p = self.table("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "content"))
        return p.select(F.lit("pages").alias("archive_id"), F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), (F.col("pos") + 1).cast("long").alias("line_no"), "content")

    def metrics(self) -> DataFrame:
        """Five series that take the events in turn."""
        e = self.table("events")
        name = F.element_at(F.array(*map(F.lit, SERIES)), (F.col("event_id") % 5 + 1).cast("int"))
        return e.select(F.lit("events").alias("file_path"), name.alias("series"), F.lit("%").alias("unit"), F.expr("event_id div 5").alias("idx"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "value", F.col("event_id").alias("line_no"))

    def heartbeats(self) -> DataFrame:
        e = self.table("events")
        node = F.col("user_id") % 20
        status = F.when((node == 7) & (F.col("event_type") == "error"), "maintenance").otherwise("online")
        free = F.floor(F.col("value") * 20).cast("long")
        return e.select(
            F.format_string("n%d-%d", node, F.floor(F.col("event_id") / 4000).cast("int")).alias("node_id"), F.format_string("10.0.0.%d", node).alias("ip"), F.lit(9000).alias("port"), "ts", status.alias("status"),
            F.lit(10_000).cast("long").alias("disk_total_mb"), (10_000 - free).alias("disk_used_mb"), free.alias("disk_free_mb"), F.lit(50_000).cast("long").alias("mem_total_mb"), F.floor(F.col("value") * 100).cast("long").alias("mem_used_mb"),
        )

    def node_heartbeats(self) -> DataFrame:
        """The same with one id a node."""
        return self.heartbeats().withColumn("node_id", F.split_part("node_id", F.lit("-"), F.lit(1)))

    def alarm_events(self) -> DataFrame:
        e = self.table("events")
        kind = F.element_at(F.array(F.lit("DISK_FULL"), F.lit("HIGH_MEMORY"), F.lit("NODE_OFFLINE")), (F.col("event_id") % 3 + 1).cast("int"))
        severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "warning").otherwise("")
        return e.select(
            F.format_string("u%d", "user_id").alias("node_id"), kind.alias("alarm_type"), severity.alias("severity"), F.col("event_type").alias("title"), F.format_string("value %.2f", "value").alias("message"),
            F.when(F.col("event_type") == "purchase", "resolve").when(F.col("event_type") == "signup", "ack").otherwise("report").alias("action"), "ts", F.col("event_id").alias("seq"),
        )

    def archives(self) -> DataFrame:
        o = self.table("orders")
        errors = ["No space left on device", "Permission denied: /data", "dial tcp: connection refused", "unexpected EOF in archive", "strange fault"]
        no = F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(5))
        message = F.element_at(F.array(*map(F.lit, errors)), no)
        return o.select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user"), F.format_string("logs-%d.tar.gz", "o_orderkey").alias("filename"), F.floor(F.col("o_totalprice") * 1000).cast("long").alias("size"),
            F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ready").alias("status"), F.format_string("node-%d", F.col("o_custkey") % 5).alias("node_id"),
            F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.concat(F.lit("Case-"), (F.col("o_orderkey") % 7).cast("string"))).alias("tags"),
            F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("remark"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), F.col("o_orderdate").alias("upload_time"), message.alias("error_msg"),
        )

    def nodes(self) -> DataFrame:
        """Five nodes whose use is a share of what their archives hold."""
        a = self.archives().groupBy("node_id").agg(F.sum(F.expr("size div 1048576")).alias("mb"))
        return a.select("node_id", F.when(F.col("node_id") == "node-4", "offline").otherwise("online").alias("status"), F.col("mb").alias("disk_total_mb"), F.expr("mb * 95 div 100").alias("disk_used_mb"))

    def users(self) -> DataFrame:
        c = self.table("customer")
        return c.select(F.col("c_custkey").cast("string").alias("user"), F.when(F.col("c_custkey") % 10 == 0, 0).otherwise(F.lit(2_000_000_000)).cast("long").alias("quota_bytes"))

    def files(self) -> DataFrame:
        li = self.table("lineitem")
        path = F.format_string("node-%d/%s/%s/part-%d.log", F.col("l_suppkey") % 4, "l_returnflag", "l_linestatus", F.col("l_partkey") % 50)
        rows = li.select((F.col("l_orderkey") % 2).cast("string").alias("archive_id"), path.alias("file_path"), F.floor(F.col("l_extendedprice")).cast("long").alias("bytes"))
        return rows.groupBy("archive_id", "file_path").agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("line_count"))


SQL = {
    "event_lines": """event_lines AS (
  SELECT CAST(event_id % 2 AS VARCHAR) AS archive_id, 'app/node-' || (event_id % 8)::VARCHAR || '.log' AS file_path,
    event_id // 8 + 1 AS line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
      WHEN 'purchase' THEN 'FATAL' ELSE 'INFO' END || '] trace_id=t-' || user_id::VARCHAR || ' ' || event_type || ' value=' || printf('%.2f', value) AS content
  FROM events)""",
    "service_lines": """spelt AS (
  SELECT *, translate(user_id::VARCHAR, '0123456789', 'abcdefghij') AS u, translate(CAST(floor(value) AS BIGINT)::VARCHAR, '0123456789', 'abcdefghij') AS v, translate((event_id // 8)::VARCHAR, '0123456789', 'abcdefghij') AS w,
    translate((user_id % 13)::VARCHAR, '0123456789', 'abcdefghij') AS x, translate((user_id % 29)::VARCHAR, '0123456789', 'abcdefghij') AS y,
    CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE translate((user_id % 7)::VARCHAR, '0123456789', 'abcdefghij') END AS third FROM events),
service_lines AS (
  SELECT CAST(event_id % 2 AS VARCHAR) AS archive_id, 'srv/' || (event_id % 8)::VARCHAR || '.log' AS file_path, event_id // 8 + 1 AS line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || CASE event_type WHEN 'click' THEN 'gateway routed request from ' || u || ' to ' || v || ' after wait' WHEN 'view' THEN 'cache shard ' || third || ' missed ' || v
      WHEN 'error' THEN 'ERROR disk failed on ' || u || ' at ' || v || ' now' WHEN 'signup' THEN 'WARN user ' || third || ' joined ' || v || ' by mail'
      ELSE 'job run done ' || x || ' ' || v || ' ' || w || ' ' || y || ' end' END AS content FROM spelt)""",
    "fault_lines": f"""fault_lines AS (
  SELECT 'faults' AS archive_id, 'var/log/' || (user_id % 10)::VARCHAR || '.log' AS file_path, event_id AS line_no,
    CASE WHEN event_id % 4 = 0 THEN {FAULTS}[event_id // 4 % {len(FAULTS)} + 1] ELSE 'request served' END || ' ' || user_id::VARCHAR AS content FROM events)""",
    "doc_lines": """doc_lines AS (
  SELECT 'docs' AS archive_id, source || '/' || doc_id::VARCHAR AS file_path, CAST(i AS BIGINT) AS line_no, s AS content
  FROM (SELECT source, doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents)))""",
    "chat_lines": """chat_lines AS (
  SELECT 'chat' AS archive_id, conv_id::VARCHAR AS file_path, turn + 1 AS line_no, role || ': ' || text AS content FROM conversations)""",
    "page_lines": """page_lines AS (
  SELECT 'pages' AS archive_id, 'page-' || page_id::VARCHAR || '.html' AS file_path, CAST(i AS BIGINT) AS line_no, s AS content
  FROM (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT page_id, string_split(html, chr(10)) AS p FROM pages)))""",
    "metrics": """metrics AS (
  SELECT 'events' AS file_path, ['click', 'view', 'error', 'signup', 'purchase'][event_id % 5 + 1] AS series, '%' AS unit, event_id // 5 AS idx,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, value, event_id AS line_no FROM events)""",
    "heartbeats": """heartbeats AS (
  SELECT 'n' || (user_id % 20)::VARCHAR || '-' || (event_id // 4000)::VARCHAR AS node_id, '10.0.0.' || (user_id % 20)::VARCHAR AS ip, 9000 AS port, ts,
    CASE WHEN user_id % 20 = 7 AND event_type = 'error' THEN 'maintenance' ELSE 'online' END AS status, 10000::BIGINT AS disk_total_mb,
    10000 - CAST(floor(value * 20) AS BIGINT) AS disk_used_mb, CAST(floor(value * 20) AS BIGINT) AS disk_free_mb, 50000::BIGINT AS mem_total_mb, CAST(floor(value * 100) AS BIGINT) AS mem_used_mb
  FROM events), node_heartbeats AS (SELECT * REPLACE (split_part(node_id, '-', 1) AS node_id) FROM heartbeats)""",
    "alarm_events": """alarm_events AS (
  SELECT 'u' || user_id::VARCHAR AS node_id, ['DISK_FULL', 'HIGH_MEMORY', 'NODE_OFFLINE'][event_id % 3 + 1] AS alarm_type,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' ELSE '' END AS severity, event_type AS title, printf('value %.2f', value) AS message,
    CASE event_type WHEN 'purchase' THEN 'resolve' WHEN 'signup' THEN 'ack' ELSE 'report' END AS action, ts, event_id AS seq FROM events)""",
    "archives": """archives AS (
  SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS "user", 'logs-' || o_orderkey::VARCHAR || '.tar.gz' AS filename, CAST(floor(o_totalprice * 1000) AS BIGINT) AS size,
    CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status, 'node-' || (o_custkey % 5)::VARCHAR AS node_id,
    [o_orderstatus, o_orderpriority, 'Case-' || (o_orderkey % 7)::VARCHAR] AS tags, 'order of ' || o_custkey::VARCHAR AS remark, o_orderpriority = '1-URGENT' AS pinned, o_orderdate AS upload_time,
    ['No space left on device', 'Permission denied: /data', 'dial tcp: connection refused', 'unexpected EOF in archive', 'strange fault'][coalesce(try_cast(substr(o_orderpriority, 1, 1) AS INT), 5)] AS error_msg
  FROM orders),
nodes AS (SELECT node_id, CASE WHEN node_id = 'node-4' THEN 'offline' ELSE 'online' END AS status, mb AS disk_total_mb, mb * 95 // 100 AS disk_used_mb
  FROM (SELECT node_id, CAST(sum(size // 1048576) AS BIGINT) AS mb FROM archives GROUP BY node_id)),
users AS (SELECT c_custkey::VARCHAR AS "user", CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 2000000000 END::BIGINT AS quota_bytes FROM customer)""",
    "files": """files AS (
  SELECT CAST(l_orderkey % 2 AS VARCHAR) AS archive_id, 'node-' || (l_suppkey % 4)::VARCHAR || '/' || l_returnflag || '/' || l_linestatus || '/part-' || (l_partkey % 50)::VARCHAR || '.log' AS file_path,
    CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS size, count(*) AS line_count FROM lineitem GROUP BY 1, 2)""",
}


def with_views(body: str, *names: str, more: str = "") -> str:
    """A query with the named views as common table expressions; `more` adds further ones."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return f"WITH {', '.join(parts)}\n{body}"
