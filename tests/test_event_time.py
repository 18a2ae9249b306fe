"""A replay at any speed gives the batch result, with rows out of order and rows that come too late."""

import os
import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loglode.operators import alarms as A
from loglode.streaming import alarms as S

T0 = datetime(2026, 5, 1, tzinfo=timezone.utc)
BEATS = "node_id string, ts timestamp"
SIGNALS = "node_id string, ts timestamp, alarm_type string, signal string"


def at(s):
    return T0 + timedelta(seconds=s)


def replay(spark, rows, schema, batches, operator, folder):
    """Rows cut into batches of their order, through a stream of one file a batch; what the sink holds in the end."""
    size = -(-len(rows) // batches)
    source = folder / uuid.uuid4().hex
    for i in range(0, len(rows), size):
        part = source / str(i)
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.parquet(str(part))
        for f in part.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    name = "t" + uuid.uuid4().hex
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    q.awaitTermination()
    return sorted(map(repr, spark.table(name).collect()))


def shuffled(rows, rnd, seconds=40):
    """Rows in an order of arrival that is never more than `seconds` off."""
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.random() * seconds))


@pytest.fixture(scope="module")
def beats():
    rnd, rows = random.Random(2), [("gone", at(3)), ("exact", at(0)), ("exact", at(12)), ("exact", at(24.000001)), ("exact", at(40)), ("exact", at(40)), (None, at(5))]
    for node in range(4):
        s = 0.0
        while s < 600:
            rows.append((f"n{node}", at(round(s, 6))))
            s += rnd.choice([5, 5, 5, 5, 11.9, 12, 12.1, 30, 75])
    rows.append(("clock", at(700)))
    return shuffled(rows, rnd)


def offline(spark, rows, until):
    table = spark.createDataFrame([r for r in rows if r[1] < until], BEATS)
    return sorted(map(repr, A.offline_events(A.offline_gaps(table, until.strftime("%Y-%m-%d %H:%M:%S+00:00"))).select("node_id", "alarm_type", "action", "ts").collect()))


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("batches", [1, 5])
def test_offline_replay_at_any_speed(spark, tmp_path, beats, batches, zone):
    want = offline(spark, beats, at(640))
    assert len(want) > 20 and any("gone" in r for r in want)
    assert replay(spark, beats, BEATS, batches, S.offline_by_event_time, tmp_path) == want


def test_offline_late_rows_change_nothing(spark, tmp_path, beats):
    late = [("n0", at(1)), ("gone", at(60)), ("n1", None)]
    assert replay(spark, beats + late * 20, BEATS, 4, S.offline_by_event_time, tmp_path) == offline(spark, beats, at(640))


@pytest.mark.parametrize("batches", [1, 4])
def test_hold_replay(spark, tmp_path, batches):
    rnd = random.Random(4)
    rows = [(f"n{rnd.randrange(3)}", at(s / 2), rnd.choice(["DISK_FULL", "HIGH_MEMORY"]), rnd.choice([None, None, "report", "resolve"])) for s in range(600)]
    rows = shuffled([*rows, ("clock", at(400), "DISK_FULL", None)], rnd)
    done = spark.createDataFrame([r for r in rows if r[1] < at(340)], SIGNALS)
    want = A.hysteresis(done).select("node_id", "ts", "alarm_type", "signal", "state")
    got = replay(spark, rows, SIGNALS, batches, S.hysteresis_by_event_time, tmp_path)
    assert got == sorted(map(repr, want.collect())) and len(got) == 600 and want.where(F.col("signal").isNull() & F.col("state").isNotNull()).count() > 100


def test_empty_stream(spark, tmp_path):
    assert replay(spark, [("a", None)], BEATS, 1, S.offline_by_event_time, tmp_path) == []
