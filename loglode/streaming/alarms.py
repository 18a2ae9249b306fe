"""Structured Streaming forms of the alarm operators.

Event time needs a watermark, which is a choice of ours: one minute unless given.  State is kept per (node, type) or
per node, so it is as large as the fleet and never as large as the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alarms import health_signals

WATERMARK = "1 minute"


def stream_signals(heartbeats: DataFrame) -> DataFrame:
    """Report and resolve signals of a heartbeat stream; stateless."""
    return health_signals(heartbeats).where("signal IS NOT NULL")


def debounce_stream(reports: DataFrame, seconds: float = 30.0, watermark: str = WATERMARK) -> DataFrame:
    """Append mode: reports at least `seconds` after the last one sent for their key."""
    schema = reports.schema

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        keep = []
        for ts in rows["ts"]:
            at = int(ts.value // 1000)
            ok = sent is None or at - sent >= seconds * 1e6
            sent = at if ok else sent
            keep.append(ok)
        state.update((sent,))
        yield rows[keep]

    grouped = reports.withWatermark("ts", watermark).groupBy("node_id", "alarm_type")
    return grouped.applyInPandasWithState(walk, schema, "sent long", "append", GroupStateTimeout.NoTimeout)


ALARM = "node_id string, alarm_type string, episode long, severity string, title string, message string, status string, count long, first_occur timestamp, last_occur timestamp, resolved_at timestamp"


def aggregate_stream(alarm_events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Update mode: the current row of each alarm episode that a batch touched; a deleted one has status 'deleted'.

    Deleted episodes keep their numbers here, as rows of earlier batches have them.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episode, n, severity, title, message, status, first, last = state.get if state.exists else (0, 0, "", "", "", "resolved", 0, 0)
        out: dict[int, tuple] = {}
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            at, done = int(r.ts.value // 1000), None
            if r.action == "report":
                if status in ("resolved", "deleted"):
                    episode, n, severity, title, status, first = episode + 1, 0, "", "", "active", at
                n, last, message = n + 1, at, r.message
                severity, title = r.severity or severity, r.title or title
            elif status in ("resolved", "deleted"):
                continue
            elif r.action == "resolve":
                status, done = "resolved", at
            elif r.action == "delete":
                status = "deleted"
            elif r.action == "ack":
                status = "acknowledged"
            out[episode] = (*key, episode, severity, title, message, status, n, pd.Timestamp(first * 1000), pd.Timestamp(last * 1000), pd.Timestamp(done * 1000) if done is not None else pd.NaT)
        state.update((episode, n, severity, title, message, status, first, last))
        names = [c.split()[0] for c in ALARM.split(", ")]
        yield pd.DataFrame(list(out.values()), columns=names)

    kept = "episode long, n long, severity string, title string, message string, status string, first long, last long"
    grouped = alarm_events.withWatermark("ts", watermark).groupBy("node_id", "alarm_type")
    return grouped.applyInPandasWithState(walk, ALARM, kept, "update", GroupStateTimeout.NoTimeout)


def offline_stream(heartbeats: DataFrame, seconds: float = 12.0) -> DataFrame:
    """Update mode: 'report' once a node was silent for `seconds` of processing time, 'resolve' when it is back."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["node_id", "alarm_type", "action", "last_seen"]
        if state.hasTimedOut:
            seen = state.get[0]
            state.update((seen, True))
            yield pd.DataFrame([(key[0], "NODE_OFFLINE", "report", pd.Timestamp(seen * 1000))], columns=columns)
            return
        seen, away = state.get if state.exists else (0, False)
        seen = max([seen, *(int(ts.value // 1000) for b in batches for ts in b["ts"])])
        state.update((seen, False))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame([(key[0], "NODE_OFFLINE", "resolve", pd.Timestamp(seen * 1000))] if away else [], columns=columns)

    schema = "node_id string, alarm_type string, action string, last_seen timestamp"
    return heartbeats.groupBy("node_id").applyInPandasWithState(walk, schema, "seen long, away boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _timed(rows: DataFrame, watermark: str, *columns: str) -> DataFrame:
    """Rows with their time as `us`, microseconds as the watermark counts them whatever the session's time zone."""
    return rows.withWatermark("ts", watermark).where("ts IS NOT NULL").select(*columns, "ts", F.unix_micros("ts").alias("us"))


def _wake(state: GroupState, instants: list[int]) -> None:
    """Come back once the watermark has passed the first of these instants (microseconds)."""
    if instants:
        state.setTimeoutTimestamp(max(min(instants) // 1000, state.getCurrentWatermarkMs()))


def hysteresis_by_event_time(signals: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Append mode: operators.alarms.hysteresis of a signal stream, whatever order and speed rows come in.

    A row waits in its key's state until the watermark has passed it, so rows go out in order of (ts, signal), holds
    first at equal times, and a replay gives what the table gives for all rows before the watermark.  State is the held
    signal and the rows of about one watermark delay (of one batch, where a batch spans more).  Rows behind the
    watermark are dropped by Spark; rows without a time have no place and are left out.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at, said = state.get if state.exists else (None, [], [])
        rows = list(zip(at, said))
        if not state.hasTimedOut:
            rows += [(int(us), x if isinstance(x, str) else None) for b in batches for us, x in zip(b["us"], b["signal"])]
        now = state.getCurrentWatermarkMs() * 1000
        out, later = [], [r for r in rows if r[0] >= now]
        for us, signal in sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], r[1] or "")):
            held = signal or held
            out.append((*key, us, signal, held))
        state.update((held, [us for us, _ in later], [x for _, x in later]))
        _wake(state, [us for us, _ in later])
        yield pd.DataFrame(out, columns=["node_id", "alarm_type", "us", "signal", "state"])

    grouped = _timed(signals, watermark, "node_id", "alarm_type", "signal").groupBy("node_id", "alarm_type")
    schema, kept = "node_id string, alarm_type string, us bigint, signal string, state string", "held string, at array<bigint>, said array<string>"
    out = grouped.applyInPandasWithState(walk, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("node_id", F.timestamp_micros("us").alias("ts"), "alarm_type", "signal", "state")


def offline_by_event_time(heartbeats: DataFrame, seconds: float = 12.0, watermark: str = WATERMARK) -> DataFrame:
    """Append mode: operators.alarms.offline_events of a heartbeat stream, by the heartbeats' own times.

    (node_id, alarm_type, action, ts): a report `seconds` after the last heartbeat once the watermark has passed that
    instant, and a resolve at the heartbeat that ends a silence.  Heartbeats wait for the watermark as in
    hysteresis_by_event_time, so a replay at any speed gives the batch result of all heartbeats before the watermark W,
    with W as its `now`.  The watermark is the whole stream's: a silent node is reported because others go on.
    """
    wait = round(seconds * 1e6)

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, away, at = state.get if state.exists else (None, False, [])
        rows = list(at) + ([] if state.hasTimedOut else [int(us) for b in batches for us in b["us"]])
        now = state.getCurrentWatermarkMs() * 1000
        out, later = [], [us for us in rows if us >= now]
        for us in [*sorted(us for us in rows if us < now), None]:
            until = now if us is None else us
            if seen is not None and not away and until - seen > wait:
                away = True
                out.append(("report", seen + wait))
            if us is not None:
                if away:
                    out.append(("resolve", us))
                seen, away = us, False
        state.update((seen, away, later))
        _wake(state, later + ([seen + wait] if seen is not None and not away else []))
        yield pd.DataFrame([(key[0], action, us) for action, us in out], columns=["node_id", "action", "us"])

    grouped = _timed(heartbeats, watermark, "node_id").groupBy("node_id")
    out = grouped.applyInPandasWithState(walk, "node_id string, action string, us bigint", "seen bigint, away boolean, at array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("node_id", F.lit("NODE_OFFLINE").alias("alarm_type"), "action", F.timestamp_micros("us").alias("ts"))
