"""Archive, retention, quota and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RetentionConfig
from .running import running


def list_archives(archives: DataFrame, user: str | None = None, tag: str = "", keyword: str = "") -> DataFrame:
    """Own archives (all where user is None) with a tag and a keyword, case folded; both tests must hold."""
    out = archives if user is None else archives.where(F.col("user") == user)
    has = lambda s: F.exists("tags", lambda t: F.lower(t).contains(s.strip().lower()))
    if tag.strip():
        out = out.where(has(tag))
    if keyword.strip():
        k = keyword.strip().lower()
        out = out.where(F.lower("filename").contains(k) | F.lower("remark").contains(k) | has(k))
    return out


def _tags(archives: DataFrame) -> DataFrame:
    return archives.select("id", F.explode("tags").alias("tag")).select("id", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct()


def duplicate_tags(archives: DataFrame) -> DataFrame:
    """Tags (trimmed, lower case) that two or more archives use, with their number."""
    return _tags(archives).groupBy("tag").agg(F.count(F.lit(1)).alias("n_archives")).where("n_archives > 1")


def tags_in_use(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of the wanted tags (id, tag) another archive has already."""
    w = wanted.select("id", F.lower(F.trim("tag")).alias("tag"))
    other = _tags(archives).withColumnRenamed("id", "other")
    return w.join(other, (w.tag == other.tag) & (w.id != other.other), "left_semi")


def user_usage(archives: DataFrame, users: DataFrame, incoming: int = 0) -> DataFrame:
    """Bytes per user and whether incoming bytes would go over the quota; a quota of 0 or less is none."""
    used = archives.groupBy("user").agg(F.sum("size").alias("used_bytes"), F.count(F.lit(1)).alias("n_archives"))
    out = users.join(used, "user", "left").na.fill(0, ["used_bytes", "n_archives"])
    return out.withColumn("over", (F.col("quota_bytes") > 0) & (F.col("used_bytes") + incoming > F.col("quota_bytes")))


def node_usage(archives: DataFrame) -> DataFrame:
    """Bytes and archives per node, share of all bytes, and rank by bytes."""
    per = archives.groupBy("node_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_archives"))
    total = per.agg(F.sum("bytes").alias("all_bytes"))
    out = per.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("bytes") / F.greatest(F.col("all_bytes"), F.lit(1)), 6))
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc("bytes")))).drop("all_bytes")  # one row a node


def is_exempt(cfg: RetentionConfig) -> Column:
    """Pinned, or with a tag that equals an exempt one."""
    tags = [t.strip().lower() for t in cfg.exempt_tags]
    return F.coalesce("pinned", F.lit(False)) | F.coalesce(F.exists("tags", lambda t: F.lower(F.trim(t)).isin(tags)), F.lit(False))


def expired(archives: DataFrame, cfg: RetentionConfig, now: str) -> DataFrame:
    """Archives past their days; none where days is 0 or retention is off."""
    if not cfg.enabled or cfg.days <= 0:
        return archives.where(F.lit(False))
    return archives.where(~is_exempt(cfg) & (F.col("upload_time") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {cfg.days} DAYS")))


def watermark_victims(archives: DataFrame, nodes: DataFrame, cfg: RetentionConfig) -> DataFrame:
    """On online nodes over the emergency mark, the oldest archives whose removal brings usage down to the target.

    nodes: node_id, status, disk_total_mb, disk_used_mb. An archive goes while usage before it is above the target.
    """
    over = nodes.where((F.col("status") == "online") & (F.col("disk_total_mb") > 0) & (F.col("disk_used_mb") / F.col("disk_total_mb") * 100 >= cfg.emergency_pct))
    rows = archives.where(~is_exempt(cfg)).join(F.broadcast(over.select("node_id", "disk_total_mb", "disk_used_mb")), "node_id")
    rows = rows.withColumn("size_mb", F.expr("size div 1048576"))
    rows = running(rows, ["node_id"], ["upload_time", "id"], sums={"prior_mb": "size_mb"})
    return rows.where((F.col("disk_used_mb") - F.col("prior_mb")) / F.col("disk_total_mb") * 100 > cfg.target_pct)


def ops_metrics(nodes: DataFrame, archives: DataFrame, query_log: DataFrame) -> DataFrame:
    """Long table (metric, value) of nodes, capacity, archives and searches."""
    row = lambda df, **m: df.agg(*[v.cast("double").alias(k) for k, v in m.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = [
        row(nodes, nodes_total=F.count(F.lit(1)), nodes_online=F.count_if(F.col("status") == "online"), disk_total_mb=zero(F.sum("disk_total_mb")), disk_used_mb=zero(F.sum("disk_used_mb"))),
        row(archives, archives_total=F.count(F.lit(1)), archives_bytes=zero(F.sum("size"))),
        row(query_log, search_requests=F.count(F.lit(1)), search_seconds=zero(F.sum("seconds"))),
    ]
    out = None
    for p in parts:
        long = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in p.columns])).alias("m")).select("m.metric", "m.value")
        out = long if out is None else out.unionByName(long)
    return out


def latest_nodes(heartbeats: DataFrame) -> DataFrame:
    """One row per (ip, port): the newest heartbeat with the first id; maintenance status sticks."""
    newest = F.max_by(F.struct("ts", "status", "disk_total_mb", "disk_used_mb", "disk_free_mb", "mem_total_mb", "mem_used_mb"), F.struct("ts", "node_id"))
    g = heartbeats.groupBy("ip", "port").agg(F.min_by("node_id", F.struct("ts", "node_id")).alias("node_id"), newest.alias("n"), F.bool_or(F.col("status") == "maintenance").alias("held"))
    return g.select("ip", "port", "node_id", "n.*", "held").withColumn("status", F.when(F.col("held"), "maintenance").otherwise(F.col("status"))).drop("held")


# Texts that tell the class of a failure, in order of precedence.
FAILURE_CLASSES = [
    ("disk_full", ["no space left on device", "space left", "disk full", "存储空间不足", "磁盘空间不足"]),
    ("permission", ["permission denied", "access denied", "权限不足"]),
    ("network", ["connection refused", "timeout", "no route to host", "network", "节点通信"]),
    ("corrupt_archive", ["unexpected eof", "invalid header", "corrupted", "损坏", "unrecognized archive"]),
    ("out_of_memory", ["killed", "out of memory", "oom"]),
]


def failure_class(message: Column) -> Column:
    low, out = F.lower(message), F.lit("other")
    for name, texts in reversed(FAILURE_CLASSES):
        test = F.lit(False)
        for t in texts:
            test = test | low.contains(t)
        out = F.when(test, name).otherwise(out)
    return out


def classify_failures(archives: DataFrame) -> DataFrame:
    """Failed archives by class of error and node, with one message (cut at 80 characters)."""
    m = F.coalesce("error_msg", F.lit(""))
    cut = F.when(F.length(m) > 80, F.concat(F.substring(m, 1, 80), F.lit("..."))).otherwise(m)
    rows = archives.where(F.col("status") == "failed").select(failure_class(m).alias("failure_class"), "node_id", cut.alias("message"))
    return rows.groupBy("failure_class", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))
