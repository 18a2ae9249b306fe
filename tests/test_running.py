"""Running results in two levels against plain loops, over keys that lie in many ranges."""

import random
from datetime import datetime, timedelta

import pytest

from loglode.operators import alarms, capacity, series
from loglode.operators.running import running
from loglode.plans.views import Views
from loglode.schema import RetentionConfig

from .test_queries import plan_of


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_a_loop(spark, parts):
    r = random.Random(parts)
    rows = [("big" if r.random() < 0.7 else r.choice(["a", "b", None]), k, r.choice([None, r.randrange(9)]), r.choice([None, None, f"v{k}"])) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, x long, s string").repartition(5)
    got = running(df, ["k"], ["o"], counts=["n"], sums={"total": "x"}, lasts={"last": "s"}, parts=parts)
    n, total, last, want = {}, {}, {}, []
    for k, o, x, s in rows:
        last[k] = s if s is not None else last.get(k)
        want.append((k, o, x, s, n.get(k, 0), total.get(k, 0), last[k]))
        n[k], total[k] = n.get(k, 0) + 1, total.get(k, 0) + (x or 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert running(df.where("false"), ["k"], ["o"], counts=["n"]).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_and_sums_within_a_key(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["f", "f", "g", None]), r.choice(["a", "b", None]), k, r.choice([None, 0, 1]), r.choice([None, None, f"v{k}"])) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, d string, o long, x long, s string").repartition(5)
    got = running(df, ["k"], ["o"], counts=["n"], sums={"total": "x"}, lasts={"last": "s"}, parts=parts, within=["d"])
    n, total, last, want = {}, {}, {}, []
    for k, d, o, x, s in rows:
        last[k] = s if s is not None else last.get(k)
        want.append((k, d, o, x, s, n.get((k, d), 0), total.get((k, d), 0), last[k]))
        n[k, d], total[k, d] = n.get((k, d), 0) + 1, total.get((k, d), 0) + (x or 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("parts", [None, 6])
def test_debounce_equals_a_walk(spark, parts):
    r, t0 = random.Random(3), datetime(2026, 1, 1)
    rows = [("hot" if r.random() < 0.8 else r.choice(["n1", "n2"]), "DISK", t0 + timedelta(seconds=r.randrange(4000) / r.choice([1, 2])), k) for k in range(900)]
    rows += [("n3", "DISK", t0, 1), ("n3", "DISK", t0 + timedelta(seconds=30), 3), ("n3", "DISK", t0 + timedelta(seconds=30), 2), ("n3", "DISK", None, 4)]
    df = spark.createDataFrame(rows, "node_id string, alarm_type string, ts timestamp, seq long").repartition(4)
    sent, want = {}, []
    for node, _, ts, seq in sorted((x for x in rows if x[2]), key=lambda x: (x[2], x[3])):
        if node not in sent or (ts - sent[node]).total_seconds() >= 30:
            sent[node] = ts
            want.append((node, seq))
    assert sorted((x.node_id, x.seq) for x in alarms.debounce(df, 30, parts).collect()) == sorted(want)
    assert alarms.debounce(df.where("false")).collect() == []



def test_no_window_over_a_whole_file(spark, sf_dir):
    lines = Views(spark, sf_dir).event_lines()
    v = Views(spark, sf_dir)
    plans = [series.parse_iostat(lines), series.parse_vmstat(lines), series.parse_time_value(lines), alarms.hysteresis(alarms.health_signals(v.node_heartbeats())), capacity.watermark_victims(v.archives(), v.nodes(), RetentionConfig())]
    for df in plans:
        text = [x for x in plan_of(df).split("\n") if "Window " in x and "windowspecdefinition" in x]
        assert text and all("windowspecdefinition(_part#" in x or "_n#" in x for x in text)
