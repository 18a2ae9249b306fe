"""Operators on small inputs with known answers."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglode.functions import line as L
from loglode.functions.default_rules import DEFAULT_RULES
from loglode.operators import alarms, capacity, diff, evidence, search, series, templates
from loglode.operators import diagnose as D
from loglode.schema import ALARM_EVENTS, LINES, METRICS, PreprocessRule, RetentionConfig, Rule, SearchQuery

WORDS = """line 1: this is a plain error message
line 2: system error_code=500 encountered
line 3: prefixmyerror happens here
line 4: error. at end of sentence
line 5: an Error with capital E
line 6: no matching word here"""

TRACES = """2026-09-12 10:00:00 [INFO] trace_id=trace-001 Gateway received request
2026-09-12 10:05:00 [WARN] trace_id=trace-001 slow response from upstream 850ms
2026-09-12 10:10:00 [ERROR] trace_id=trace-002 connection refused host=10.0.1.2
2026-09-12 10:15:00 [FATAL] trace_id=trace-002 panic: nil pointer dereference"""

CLUSTER = """ceph/ceph-osd.0.log|2026-09-09 10:00:01 [INFO] osd.0 starting up with 128 pgs
ceph/ceph-osd.0.log|2026-09-09 10:00:02 [ERROR] osd.0 marked down, heartbeat_check: no reply from peer
ceph/ceph-osd.0.log|2026-09-09 10:00:03 [WARN] 25 slow requests are blocked currently > 30.0s
ceph/ceph-osd.0.log|2026-09-09 10:00:04 [INFO] heartbeat restored to mon.a
ceph/ceph-osd.0.log|2026-09-09 10:00:05 [INFO] sync block completed partition=0 seq=1
hdfs/hadoop-datanode.log|2026-09-09 10:01:00 [INFO] DataNode registration succeeded
hdfs/hadoop-datanode.log|2026-09-09 10:01:01 [ERROR] DataNode-1 is dead, Lost contact with DataNode after 600s
hdfs/hadoop-datanode.log|2026-09-09 10:01:02 [FATAL] Corrupt block blk_1073741825 detected checksum mismatch
hdfs/hadoop-datanode.log|2026-09-09 10:01:03 [INFO] Block pool BP-724128 service shutdown
sys/dmesg.log|2026-09-09 10:02:00 [INFO] Linux version 6.6.0-generic
sys/dmesg.log|2026-09-09 10:02:01 [CRITICAL] blk_update_request: I/O error, dev sdb, sector 1209348
sys/dmesg.log|2026-09-09 10:02:02 [INFO] EXT4-fs error: remounting filesystem read-only"""


def lines_of(spark, text, archive="a"):
    rows, at = [], {}
    for row in text.split("\n"):
        path, _, content = row.rpartition("|")
        path = path or "app.log"
        at[path] = at.get(path, 0) + 1
        rows.append((archive, path, at[path], content))
    return spark.createDataFrame(rows, LINES)


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "content string").select(column.alias("v")).first()["v"]


def test_whole_words(spark):
    lines = lines_of(spark, WORDS)
    found = lambda **q: sorted(r.line_no for r in search.matching(lines, SearchQuery(keyword="error", **q)).collect())
    assert len(found()) == 5
    assert found(whole_word=True) == [1, 4, 5]
    assert found(whole_word=True, case_sensitive=True) == [1, 4]
    assert found(whole_word=True, regex=True) == [1, 4, 5]


def test_regex_is_not_prefiltered_by_literals(spark):
    lines = lines_of(spark, "barbaz\nfoo\nan error here")
    assert search.matching(lines, SearchQuery(keyword="foo|barbaz", regex=True)).count() == 2
    assert search.matching(lines, SearchQuery(keyword=r"\berror\b", regex=True)).count() == 1


def test_histogram_traces_facets(spark):
    r = search.search(lines_of(spark, TRACES), SearchQuery(keyword="trace_id"))
    assert r.hits.count() == 4
    assert {(x.facet, x.value): x.n for x in r.facets.collect()}["level", "TRACE"] == 1
    assert [x.trace_id for x in r.traces.collect()] == ["trace-001", "trace-002"]
    h = {x.bucket: x for x in r.histogram.collect()}
    assert len(h) == 20 and [b for b in sorted(h) if h[b].total] == [0, 6, 13, 19]


def test_context(spark):
    lines = lines_of(spark, CLUSTER)
    hit = search.with_context(lines, search.matching(lines, SearchQuery(keyword="heartbeat_check")), 2).first()
    assert (len(hit.context_before), len(hit.context_after)) == (1, 2)
    assert hit.context_after[0].endswith("30.0s")


def test_large_file_hits(spark):
    rows = spark.range(1, 420_001).select(F.lit("a").alias("archive_id"), F.lit("big.log").alias("file_path"), F.col("id").alias("line_no"), F.when(F.col("id").isin(100, 50_000, 150_000, 250_000, 320_000), "needle found").otherwise("hay").alias("content"))
    assert sorted(r.line_no for r in search.matching(rows, SearchQuery(keyword="needle")).collect()) == [100, 50_000, 150_000, 250_000, 320_000]
    sparse = rows.where("line_no <= 80000").withColumn("content", F.when(F.col("line_no") == 68_200, "x disk_sector_corrupt y").otherwise(F.col("content")))
    index = search.chunk_token_index(sparse)
    assert search.prune_chunks(index, "disk_sector_corrupt").count() == 1
    assert [r.line_no for r in search.search_indexed(sparse, index, "disk_sector_corrupt").collect()] == [68_200]


# Expected results that must be met.
SCOPES = [
    ("", "ceph/ceph-osd.0.log", True), ("  ", "sys/dmesg.log", True), ("dmesg.log", "sys/dmesg.log", True), ("dmesg.log", "dmesg.log", True), ("dmesg.log", "var/log/dmesg.log", True),
    ("dmesg.log", "sys/ceph-osd.log", False), ("*.log", "ceph/ceph-osd.0.log", True), ("ceph-*.log", "ceph/ceph-osd.0.log", True), ("ceph-*.log", "ceph/ceph-mon.log", True), ("ceph-*.log", "sys/dmesg.log", False),
    ("sys/dmesg.log", "sys/dmesg.log", True), ("sys/dmesg.log", "root/sys/dmesg.log", True), ("sys/dmesg.log", "other/dmesg.log", False), ("ceph/*.log", "ceph/ceph-osd.0.log", True), ("ceph/*.log", "hdfs/hadoop.log", False),
    ("dmesg.log, syslog, messages", "sys/dmesg.log", True), ("dmesg.log; syslog; messages", "var/log/syslog", True), ("dmesg.log, syslog", "ceph/ceph-osd.0.log", False), ("DMESG.LOG", "sys/dmesg.log", True), ("Ceph/*.LOG", "ceph/ceph-osd.0.log", True),
]


@pytest.mark.parametrize("pattern,path,expected", SCOPES)
def test_path_scope(pattern, path, expected):
    regex = L.path_regex(pattern)
    assert bool(not regex or re.search(regex, path.lower())) == expected


def test_scoped_rules(spark):
    lines = lines_of(spark, "ceph/ceph-osd.0.log|osd.0 marked down\nhdfs/hadoop-datanode.log|DataNode-1 is dead\nsys/dmesg.log|blk_update_request: I/O error")
    pairs = [("ceph-osd*.log", "marked down"), ("hdfs/*.log", "is dead"), ("sys/dmesg.log", "I/O error"), ("not_exist_file.log", "marked down")]
    rules = [Rule(f"r{i}", "n", "s", "FATAL", p, True, s) for i, (s, p) in enumerate(pairs)]
    assert D.scan_rules(lines, rules).count() == 3


def test_diagnose_default_rules(spark):
    events, report = D.diagnose(lines_of(spark, CLUSTER), DEFAULT_RULES)
    got = {(e.rule_id, e.file_path, e.line_no) for e in events.collect()}
    assert {("rule_ceph_001", "ceph/ceph-osd.0.log", 2), ("rule_ceph_002", "ceph/ceph-osd.0.log", 3), ("rule_hdfs_001", "hdfs/hadoop-datanode.log", 2), ("rule_hdfs_002", "hdfs/hadoop-datanode.log", 3), ("rule_io_001", "sys/dmesg.log", 2), ("rule_io_002", "sys/dmesg.log", 3)} == got
    r = report.first()
    assert (r.fatal, r.critical, r.warning, r.health_score) == (3, 3, 0, 0)
    clean = D.diagnose(lines_of(spark, "all is well"), DEFAULT_RULES)[1].first()
    assert (clean.health_score, clean.total_events) == (100, 0)
    assert D.scan_rules(lines_of(spark, "2 pg degraded"), DEFAULT_RULES).first().rule_id == "rule_ceph_003"
    assert D.scan_rules(lines_of(spark, "a (b"), [Rule("x", "n", "s", "INFO", "A (B")]).count() == 1


# Expected results that must be met.
LEVELS = [("[ERR]", "ERROR"), ("[ERROR]", "ERROR"), ("[CRIT]", "FATAL"), ("[FATAL]", "FATAL"), ("[FTL]", "FATAL"), ("[WRN]", "WARN"), ("[WARNING]", "WARN"), ("[INF]", "INFO"), ("[DBG]", "DEBUG"), ("x", "INFO")]


def test_template_levels_and_trace_ids(spark):
    rows = spark.createDataFrame([(f"2026-09-12 10:00:00 {t} x", e) for t, e in LEVELS], "content string, want string")
    assert rows.where(L.template_level(F.col("content")) != F.col("want")).count() == 0
    pairs = [("a trace_id=c89f3a1b4e2d5c6f b", "c89f3a1b4e2d5c6f"), ("request_id: req-99881122", "req-99881122"), ('{"trace_id":"trace-abc-123"}', "trace-abc-123"), ("plain", None)]
    for text, want in pairs:
        assert one(spark, L.extract_trace_id(F.col("content")), text) == want


def test_preprocess_rules(spark):
    rules = [PreprocessRule("mask", r"\btenant_[0-9a-zA-Z]+\b"), PreprocessRule("level_mapping", "(?i)runtime error: panic", "fatal")]
    p = one(spark, L.preprocess(F.col("content"), rules), '2026-09-12 10:00:00 [INFO] tenant_a1 runtime error: panic "q" 10.0.0.1:80 0xff 7 a7')
    assert (p.cleaned, p.level, p.ts) == ('[INFO] <*> runtime error: panic "<*>" <*> <*> <*> a7', "FATAL", "2026-09-12 10:00:00")
    assert tuple(one(spark, L.preprocess(F.col("content")), "   ")) == ("", "INFO", "")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a1 _é-9.", max_size=20))
def test_digit_runs(text):
    ours = re.sub(f"{L.LEFT}[0-9]+{L.RIGHT}", "<*>", text)
    out, i = "", 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789":
            j += 1
        if j == i:
            out, i = out + text[i], i + 1
            continue
        word = lambda c: c.isascii() and (c.isalnum() or c == "_")
        alone = (i == 0 or not word(text[i - 1])) and (j == len(text) or not word(text[j]))
        out, i = out + ("<*>" if alone else text[i:j]), j
    assert ours == out


# Expected results that must be met.
TEMPLATES = """2026-09-12 14:00:01.123 [ERROR] Failed to connect to 192.168.1.10:8080 timeout after 3000ms
2026-09-12 14:00:02.456 [ERROR] Failed to connect to 192.168.1.11:8080 timeout after 3005ms
2026-09-12 14:00:03.789 [ERROR] Failed to connect to 10.0.0.5:9000 timeout after 1500ms
2026-09-12 14:01:00.000 [INFO] User login success user_id=10001 ip=172.16.0.1
2026-09-12 14:01:05.000 [INFO] User login success user_id=10002 ip=172.16.0.2
2026-09-12 14:02:00.000 [FATAL] Out of memory: Kill process 5432 (mysqld) score 850"""


def test_templates(spark):
    got = templates.templates(lines_of(spark, TEMPLATES), similarity=0.5).collect()
    assert len(got) == 3 and (got[0]["count"], got[0].level) == (3, "ERROR")
    assert got[0].pattern == "[ERROR] Failed to connect to <*> timeout after <*>"
    assert got[0].first_seen == "2026-09-12 14:00:01.123" and got[0].last_seen == "2026-09-12 14:00:03.789"


def test_diff(spark):
    a = lines_of(spark, "app.log|2026-09-11 10:00:00 [INFO] service startup success\napp.log|2026-09-11 10:01:00 [INFO] query processed normal", "a")
    b = lines_of(spark, "app.log|2026-09-12 10:00:00 [INFO] service startup success\napp.log|2026-09-12 10:01:00 [ERROR] Out of memory: Kill process 1234 (app)\napp.log|2026-09-12 10:02:00 [ERROR] Out of memory: Kill process 5678 (worker)\ncrash.log|2026-09-12 10:03:00 [FATAL] Core dumped on SIGSEGV", "b")
    parts = diff.diff(a, D.scan_rules(a, DEFAULT_RULES), b, D.scan_rules(b, DEFAULT_RULES))
    assert [tuple(r) for r in parts["files"].collect()] == [("added", "crash.log")]
    assert parts["new_fatal"].where("file_path = 'crash.log'").count() == 2  # two rules meet the line
    assert parts["new_templates"].count() >= 1
    assert parts["summary"].first().added == 1
    with pytest.raises(ValueError):
        diff.scope_type("a", "x", "a", "x")


def metric(spark, values, unit="%"):
    return spark.createDataFrame([("f", "s", unit, i, f"{i:06d}", float(v), i + 1) for i, v in enumerate(values)], METRICS)


def test_downsample_keeps_peaks(spark):
    y = [10 + i % 10 for i in range(10_000)]
    y[4582] = 100
    got = series.downsample_minmax(metric(spark, y), None, 1500).collect()
    assert len(got) <= 1600 and max(r.value for r in got) == 100
    assert sorted(r.new_idx for r in got) == list(range(len(got)))


@pytest.mark.parametrize("n,target", [(50, 10), (37, 8), (9, 4), (10, 10)])
def test_downsample_against_a_plain_model(spark, n, target):
    r = random.Random(n)
    y = [r.randrange(6) for _ in range(n)]
    keep = {0, n - 1} if n > target else set(range(n))
    for b in range(target // 2 if n > target else 0):
        lo, hi = math.floor(b * (n / (target // 2))), min(n, math.floor((b + 1) * (n / (target // 2))))
        part = range(lo, hi)
        keep |= {min(part, key=lambda i: (y[i], i)), min(part, key=lambda i: (-y[i], i))}
    assert {x.idx for x in series.downsample_minmax(metric(spark, y), None, target).collect()} == keep


def test_anomalies(spark):
    y = [15.0] * 100
    y[50] = 98.5
    got = {r.idx: r for r in series.detect_anomalies(metric(spark, y)).collect()}
    assert set(got) == {50, 51} and got[50].severity == "CRITICAL"


def test_parsers(spark):
    text = "Linux\n10:00:00\nDevice a b\nsda 1 2 3 4 5 6 7 8 9 10 11 12.5\nsdb 1 2 3 4 5 6 7 8 9 10 11 97\nTime: 10:00:05\nsda 1 2 3 4 5 6 7 8 9 10 11 x\nsda 1 2 3 4 5 6 7 8 9 10 11 86"
    rows = spark.createDataFrame([("sysstat/iostat-20260913.log", i, c) for i, c in enumerate(text.split("\n"), 1)], "file_path string, line_no long, content string")
    got = sorted((r.series, r.idx, r.t, r.value, r.line_no) for r in series.parse_iostat(rows).collect())
    assert got == [("sda", 0, "10:00:00", 12.5, 4), ("sda", 1, "10:00:05", 86.0, 8), ("sdb", 0, "10:00:00", 97.0, 5)]
    registry = series.ParserRegistry()
    registry.register("iostat", r"(?i).*iostat.*\.log$", series.parse_iostat)
    registry.register_whole_file("lines", "messages", lambda p: p.assign(series="n", unit="", idx=0, t="", value=float(len(p)))[["file_path", "series", "unit", "idx", "t", "value", "line_no"]].head(1))
    both = rows.unionByName(spark.createDataFrame([("var/log/messages", 1, "x")], rows.schema))
    assert {(r.file_path, r.parser) for r in registry.match(both).collect()} == {("sysstat/iostat-20260913.log", "iostat"), ("var/log/messages", "lines")}
    assert registry.parse(both).count() == 4
    assert series.parse_time_value(rows.withColumn("content", F.lit("10:00:00 95.5"))).first().value == 95.5
    vm = spark.createDataFrame([("v", 1, " ".join(map(str, range(17)))), ("v", 2, "short")], "file_path string, line_no long, content string")
    assert {r.series: r.value for r in series.parse_vmstat(vm).collect()} == {"us": 12.0, "sy": 13.0, "wa": 15.0}


def test_charts_mark_a_parsers_own_limits(spark):
    rows = [("vmstat-1.log", i, f"1 0 0 1 2 3 4 5 6 7 8 9 {us} 1 2 {wa} 0") for i, (us, wa) in enumerate([(99, 39), (5, 40), (5, 70)], 1)]
    rows += [("free.log", i, f"10:00:0{i} {v}") for i, v in enumerate([1, 99, 1, 1], 1)]
    registry = series.ParserRegistry()
    registry.register("vmstat", r"vmstat.*\.log$", series.parse_vmstat, limits=series.VMSTAT_LIMITS)
    registry.register("free", r"free\.log$", series.parse_time_value)
    _, marked = series.chart(spark.createDataFrame(rows, "file_path string, line_no long, content string"), registry)
    got = sorted((r.file_path, r.series, r.idx, r.severity) for r in marked.collect())
    assert [g for g in got if g[0] != "free.log"] == [("vmstat-1.log", "wa", 1, "WARNING"), ("vmstat-1.log", "wa", 2, "CRITICAL")]
    assert ("free.log", "value", 1, "CRITICAL") in got


def test_a_chart_parses_its_lines_once(spark):
    rows = [(f"iostat-{k}.log", i, f"{'sdb' if i % 3 else 'sda'} 1 2 3 4 5 6 7 8 9 10 {i if k else 0}" if i % 5 else f"Time: 10:00:{i}") for k in (0, 1) for i in range(11, 99)]
    spark.createDataFrame(rows, "file_path string, line_no long, content string").createOrReplaceTempView("reports")
    registry, read = series.ParserRegistry(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    registry.register("iostat", r"iostat.*\.log$", series.parse_iostat, limits=series.IOSTAT_LIMITS)
    lines = spark.table("reports").mapInPandas(counted, "file_path string, line_no long, content string")
    points, marked = series.chart(lines, registry)
    assert sorted((r.file_path, r.series, r.value) for r in marked.collect()) == sorted(("iostat-1.log", "sdb" if i % 3 else "sda", float(i)) for i in range(85, 99) if i % 5)
    assert points.count() == sum(i % 5 > 0 for _, i, _ in rows)
    assert read.value == len(rows)


def test_anomaly_lines_by_time(spark):
    lines = spark.createDataFrame([("f", 1, "at 12:10:00:05 x"), ("f", 2, "2026-01-01 10:00:05 y"), ("f", 3, "again 10:00:05"), ("g", 1, "10:00:05"), ("f", 4, "sample 17")], "file_path string, line_no long, content string")
    found = spark.createDataFrame([("f", "a", "10:00:05"), ("f", "b", "2026-01-01 10:00:05"), ("f", "c", "17"), ("f", "d", "11:11:11")], "file_path string, series string, t string").withColumn("line_no", F.lit(None).cast("long"))
    got = {r.series: r.line_no for r in series.anomaly_lines(found, lines).collect()}
    assert got == {"a": 1, "b": 2, "c": 4, "d": None}


def plain_templates(rows, similarity, depth=4):
    """(pattern, count) of the greedy walk, one line after another."""
    leaves = {}
    for pattern, count in rows:
        tokens = pattern.split()
        leaf = leaves.setdefault((len(tokens), *("<*>" if any(c.isdigit() for c in t) else t for t in tokens[: depth - 1])), [])
        scores = [sum(a == b for a, b in zip(c[0], tokens)) / len(tokens) for c in leaf]
        best = max(range(len(leaf)), key=lambda i: scores[i], default=None)
        if best is None or scores[best] < similarity:
            leaf.append((tokens, count))
        else:
            leaf[best] = ([a if a == b else "<*>" for a, b in zip(leaf[best][0], tokens)], leaf[best][1] + count)
    return sorted((" ".join(t), n) for leaf in leaves.values() for t, n in leaf)


def test_merging_equals_a_plain_walk(spark):
    import random

    r = random.Random(4)
    texts = [" ".join(["disk", "unit", r.choice("ab"), *(r.choice(["red", "green", "blue"]) for _ in range(6))]) for _ in range(300)]
    masked = templates.masked_patterns(lines_of(spark, "\n".join(texts)))
    rows = [(x.pattern, x["count"]) for x in masked.orderBy("sample_file", "sample_line").collect()]
    for similarity in (0.55, 0.8):
        got = sorted((x.pattern, x["count"]) for x in templates.merge_templates(masked, similarity).collect())
        assert got == plain_templates(rows, similarity) and len(got) < len(rows)


def test_slice_window(spark):
    m = metric(spark, range(10))
    idx = lambda a, b: sorted(r.value for r in series.slice_window(m, a, b).collect())
    assert idx("000003", "000005") == [3, 4, 5]
    assert idx("9", "") == list(range(10)) and idx("000007", "000002") == list(range(10))


ARCHIVE = "id string, node_id string, user string, size long, tags array<string>, pinned boolean, upload_time timestamp"


def test_retention(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 9, 1)
    old = now - timedelta(days=200)
    rows = spark.createDataFrame([("plain", "n", "u", 2500 << 20, ["x"], False, old), ("pinned", "n", "u", 1000 << 20, [], True, old), ("kept", "n", "u", 1, [" KEEP"], False, old), ("new", "n", "u", 1, None, None, now)], ARCHIVE)
    assert [r.id for r in capacity.expired(rows, RetentionConfig(), "2026-09-01").collect()] == ["plain"]
    assert capacity.expired(rows, RetentionConfig(days=0), "2026-09-01").count() == 0
    nodes = spark.createDataFrame([("n", "online", 10_000, 9_500)], "node_id string, status string, disk_total_mb long, disk_used_mb long")
    assert [r.id for r in capacity.watermark_victims(rows, nodes, RetentionConfig()).collect()] == ["plain"]


def test_tags(spark):
    for text, n in (("Ceph, OSD故障, 生产环境", 3), ("HDFS，NameNode；宕机; 重启", 4), ('["a", "b", "c"]', 3), (" , ;", 0)):
        assert len(one(spark, L.parse_tags(F.col("content")), text)) == n


def alarm_rows(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([("n1", k, s, "t", m, a, t0 + timedelta(seconds=10 * i), i) for i, (k, s, m, a) in enumerate(rows)], ALARM_EVENTS)


def test_alarms(spark):
    rows = [("DISK_FULL", "critical", "one", "report"), ("DISK_FULL", "critical", "two", "report"), ("HIGH_MEMORY", "warning", "m", "report")]
    table = alarms.aggregate_alarms(alarm_rows(spark, rows))
    disk = table.where("alarm_type = 'DISK_FULL'").first()
    assert (disk["count"], disk.message) == (2, "two")
    assert tuple(alarms.alarm_summary(table).first()) == (2, 1, 1, 0)
    rows += [("DISK_FULL", "", "", "resolve"), ("HIGH_MEMORY", "", "", "ack")]
    table = alarms.aggregate_alarms(alarm_rows(spark, rows))
    assert alarms.list_alarms(table).count() == 1 and alarms.list_alarms(table, "acknowledged").count() == 1
    done = alarms.resolve(table, "n1", "HIGH_MEMORY", "2026-01-02")
    assert alarms.list_alarms(done).count() == 0 and alarms.list_alarms(done, "all").count() == 2 and alarms.clear_resolved(done).count() == 0
    with pytest.raises(ValueError):
        alarms.acknowledge(done, "n1", "DISK_FULL")
    again = alarms.aggregate_alarms(alarm_rows(spark, [("A", "", "", "resolve"), ("A", "", "", "report"), ("A", "", "", "report"), ("A", "", "", "resolve"), ("A", "", "", "report")]))
    assert sorted((r.episode, r["count"], r.status) for r in again.collect()) == [(1, 2, "resolved"), (2, 1, "active")]


def test_deleted_alarms(spark):
    rows = [("A", "", "x", "report"), ("A", "", "", "delete"), ("A", "", "", "delete"), ("A", "", "y", "report"), ("A", "", "", "resolve"), ("A", "", "z", "report")]
    table = alarms.aggregate_alarms(alarm_rows(spark, rows))
    assert sorted((r.episode, r.message, r.status) for r in table.collect()) == [(1, "y", "resolved"), (2, "z", "active")]
    assert [r.message for r in alarms.delete_alarm(table, "n1", "A", 1).collect()] == ["z"]
    assert alarms.delete_alarm(table, "n1", "B", 1).count() == 2


def test_debounce(spark):
    rows = alarm_rows(spark, [("A", "", str(i), "report") for i in range(8)])  # ten seconds apart
    assert sorted(r.seq for r in alarms.debounce(rows, 30).collect()) == [0, 3, 6]


def test_evidence(spark):
    from loglode.functions.default_rules import GLOSSARY

    rows = [("client.log", 12, "ERROR", "ERR: lease file not found, creating new one for session"), ("chunkserver-3.log", 891, "CRITICAL", "failed to seal chunk 102941: timeout waiting for replica commit"), ("chunkserver-3.log", 905, "FATAL", "peer wal commit timeout on target node 192.168.1.13")]
    events = spark.createDataFrame([(f"e{n}", "a", f"r{n}", "rule", s, "X", f, n, c, "", "") for f, n, s, c in rows], "id string, archive_id string, rule_id string, rule_name string, severity string, storage_type string, file_path string, line_no long, matched_content string, suggestion string, ts string")
    marked = evidence.suppress_noise(events)
    clean = marked.where("ignored_by IS NULL")
    assert clean.count() == 2 and marked.where("ignored_by = 'NOISE-001'").count() == 1
    assert {r.term for r in evidence.match_glossary(clean, GLOSSARY).collect()} == {"CHUNK_SEAL", "PEER_WAL_COMMIT"}
    told = spark.createDataFrame([("b", "chunk seal failed: CHUNK_SEAL")], "archive_id string, summary_text string")
    assert {r.archive_id for r in evidence.match_glossary(clean, GLOSSARY, told).collect()} == {"a", "b"}
    stages = evidence.project_workflow(clean)
    assert tuple(stages.first())[1:] == ("WRITE_DATA_FLOW", 3, "PEER_WAL_COMMIT")
    ranked = evidence.rank_evidence(clean)
    assert evidence.root_cause_row(ranked, stages).first().root_cause.startswith("rule (peer wal")
    report = spark.createDataFrame([("a", "Two events.")], "archive_id string, summary_text string")
    text = evidence.evidence_document(report, marked, evidence.match_glossary(clean), stages).first().document
    assert text.index("# Overview") < text.index("# Terms") < text.index("# Stage") < text.index("# Ignored") < text.index("# Events")
    new = evidence.noise_from_marked(events.limit(1), spark.createDataFrame([], "pattern string"))
    assert new.count() == 1
