"""Alarms from heartbeats and reports, over tables. The streaming forms are in loglode.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .running import running

KEY = ["node_id", "alarm_type"]


def health_signals(heartbeats: DataFrame) -> DataFrame:
    """(node_id, ts, alarm_type, signal): 'report', 'resolve' or null (hold) for disk space and memory."""
    free, used = F.col("disk_free_mb"), F.col("mem_used_mb") / F.when(F.col("mem_total_mb") > 0, F.col("mem_total_mb"))
    disk = F.when(free <= 0, None).when(free < 1024, "report").when(free > 2048, "resolve")
    memory = F.when(used > 0.92, "report").when(used < 0.80, "resolve")
    both = F.array(F.struct(F.lit("DISK_FULL").alias("alarm_type"), disk.alias("signal")), F.struct(F.lit("HIGH_MEMORY").alias("alarm_type"), memory.alias("signal")))
    return heartbeats.select("node_id", "ts", F.explode(both).alias("s")).select("node_id", "ts", "s.alarm_type", "s.signal")


def hysteresis(signals: DataFrame) -> DataFrame:
    """signals with state, the last signal that was not a hold."""
    return running(signals, KEY, ["ts"], lasts={"state": "signal"})


def debounce(reports: DataFrame, seconds: float = 30.0, parts: int | None = None) -> DataFrame:
    """Reports at least `seconds` after the last one sent for the same node and type, in order of (ts, seq).

    Each report points to the first one that may be sent if it is; the sent ones are what the first report of a key
    leads to.  Pointers are found by one run over reports and waiting times in order, and followed by doubling: each
    round joins the reached reports with pointers twice as long, so a key of any size takes a logarithm of rounds.
    Reports without a time are not sent.
    """
    at, wait = F.unix_micros("ts"), round(seconds * 1e6)
    if wait <= 0:
        return reports.where("ts IS NOT NULL")
    rows = written(reports.where("ts IS NOT NULL").withColumn("_id", F.monotonically_increasing_id()), "reports")
    # Backward in time: at an equal instant the report comes before the waiting time that it ends.
    place = rows.select(*KEY, at.alias("us"), "seq", "_id")
    ends = place.select(*KEY, (-F.col("us")).alias("o1"), F.lit(0).alias("o2"), (-F.col("seq")).alias("o3"), F.col("_id").alias("next"), F.lit(None).cast("long").alias("source"))
    waits = place.select(*KEY, (-F.col("us") - wait).alias("o1"), F.lit(1).alias("o2"), F.lit(0).cast("long").alias("o3"), F.lit(None).cast("long").alias("next"), F.col("_id").alias("source"))
    met = running(ends.unionByName(waits), KEY, ["o1", "o2", "o3"], lasts={"to": "next"}, parts=parts)
    jump = written(met.where("source IS NOT NULL AND to IS NOT NULL").select(F.col("source").alias("a"), F.col("to").alias("b")), "jumps")
    reached = written(place.groupBy(*KEY).agg(F.min_by("_id", F.struct("us", "seq", "_id")).alias("a")).select("a"), "reached")
    while not jump.isEmpty():
        reached = written(reached.unionByName(reached.join(jump, "a").select(F.col("b").alias("a"))).distinct(), "reached")
        jump = written(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "jumps")
    return rows.join(reached.withColumnRenamed("a", "_id"), "_id", "left_semi").select(*reports.columns)


def aggregate_alarms(alarm_events: DataFrame) -> DataFrame:
    """Episodes of each (node, type): reports until a resolve make one alarm with count and last wording.

    alarm_events: node_id, alarm_type, severity, title, message, action ('report', 'resolve', 'ack', 'delete'), ts,
    seq.  A delete takes the open alarm away; the next report begins another.
    """
    order = Window.partitionBy(*KEY).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = alarm_events.withColumn("episode", F.coalesce(F.count_if(F.col("action").isin("resolve", "delete")).over(order), F.lit(0)))
    report, at = F.col("action") == "report", F.struct("ts", "seq")
    said = lambda c: F.max_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(report & (F.coalesce(c, F.lit("")) != ""), at))
    out = rows.groupBy(*KEY, "episode").agg(
        F.count_if(report).alias("count"), said("severity").alias("severity"), said("title").alias("title"),
        F.max_by("message", F.when(report, at)).alias("message"),
        F.min(F.when(report, F.col("ts"))).alias("first_occur"), F.max(F.when(report, F.col("ts"))).alias("last_occur"),
        F.max(F.when(F.col("action") == "resolve", F.col("ts"))).alias("resolved_at"),
        F.bool_or(F.col("action") == "ack").alias("acked"), F.bool_or(F.col("action") == "delete").alias("deleted"),
    )
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acked"), "acknowledged").otherwise("active")
    # Resolves that follow no report make no alarm; episodes count those that do.
    out = out.where((F.col("count") > 0) & ~F.coalesce("deleted", F.lit(False))).withColumn("status", status)
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("episode"))
    return out.withColumn("episode", number.cast("long")).drop("acked", "deleted")


def offline_gaps(heartbeats: DataFrame, now: str, seconds: float = 12.0) -> DataFrame:
    """(node_id, ts, back_at): silences of over `seconds`; back_at is null while the node is still away."""
    w = Window.partitionBy("node_id").orderBy("ts")
    rows = heartbeats.select("node_id", "ts", F.lead("ts").over(w).alias("back_at"))
    gap = F.unix_micros(F.coalesce("back_at", F.lit(now).cast("timestamp"))) - F.unix_micros("ts")
    return rows.where(gap > seconds * 1e6)


def offline_events(gaps: DataFrame, seconds: float = 12.0) -> DataFrame:
    """NODE_OFFLINE reports at the end of the grace time, and the resolve that the next heartbeat brings."""
    text = lambda s: F.lit(s)
    after = F.timestamp_micros(F.unix_micros("ts") + int(seconds * 1e6))
    report = gaps.select("node_id", text("NODE_OFFLINE").alias("alarm_type"), text("CRITICAL").alias("severity"), text("Node offline").alias("title"), text("No heartbeat").alias("message"), text("report").alias("action"), after.alias("ts"), F.lit(0).cast("long").alias("seq"))
    back = gaps.where("back_at IS NOT NULL").select("node_id", text("NODE_OFFLINE").alias("alarm_type"), text("").alias("severity"), text("").alias("title"), text("").alias("message"), text("resolve").alias("action"), F.col("back_at").alias("ts"), F.lit(1).cast("long").alias("seq"))
    return report.unionByName(back)


def acknowledge(alarms: DataFrame, node_id: str, alarm_type: str) -> DataFrame:
    """The active episode of a key becomes acknowledged; a key without an unresolved episode is an error."""
    mine = (F.col("node_id") == node_id) & (F.col("alarm_type") == alarm_type) & (F.col("status") != "resolved")
    if alarms.where(mine).isEmpty():
        raise ValueError("the alarm is resolved or unknown")
    return alarms.withColumn("status", F.when(mine, "acknowledged").otherwise(F.col("status")))


def resolve(alarms: DataFrame, node_id: str, alarm_type: str, at: str) -> DataFrame:
    mine = (F.col("node_id") == node_id) & (F.col("alarm_type") == alarm_type) & (F.col("status") != "resolved")
    when = F.when(mine, F.lit(at).cast("timestamp")).otherwise(F.col("resolved_at"))
    return alarms.withColumn("resolved_at", when).withColumn("status", F.when(mine, "resolved").otherwise(F.col("status")))


def delete_alarm(alarms: DataFrame, node_id: str, alarm_type: str, episode: int) -> DataFrame:
    """The alarms without that one; one that is not there is no error."""
    mine = F.col("node_id").eqNullSafe(node_id) & F.col("alarm_type").eqNullSafe(alarm_type) & F.col("episode").eqNullSafe(episode)
    return alarms.where(~mine)


def clear_resolved(alarms: DataFrame) -> DataFrame:
    return alarms.where(F.col("status") != "resolved")


def list_alarms(alarms: DataFrame, status: str = "active") -> DataFrame:
    """'active' takes in acknowledged alarms; 'all' or '' everything; newest first."""
    test = F.lit(True) if status in ("", "all") else (F.col("status") != "resolved") if status == "active" else (F.col("status") == status)
    return alarms.where(test).orderBy(F.desc("last_occur"), *KEY, "episode")


def alarm_summary(alarms: DataFrame) -> DataFrame:
    """Unresolved alarms and how many of each severity; other severities count as info."""
    s, rows = F.lower("severity"), alarms.where("status <> 'resolved'")
    return rows.agg(F.count(F.lit(1)).alias("active"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warning"), F.count_if(~F.coalesce(s, F.lit("")).isin("critical", "warning")).alias("info"))
