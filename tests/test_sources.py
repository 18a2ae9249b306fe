"""Files, archives, rotation, reports and streams."""

import bz2
import gzip
import io
import json
import random
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from loglode.operators import alarms
from loglode.schema import ALARM_EVENTS, HEARTBEATS, LINES
from loglode.sources import archives, catalog, tables, text
from loglode.streaming import alarms as streams


def test_line_numbers_over_splits(spark, tmp_path):
    r = random.Random(1)
    want = set()
    for name, n in (("a/x.log", 5000), ("a/y z.log", 3000), ("b/e.log", 0), ("one.txt", 1)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        lines = ["w" * r.randrange(40) + str(i) for i in range(n)]
        p.write_text("\n".join(lines))
        want |= {(name, i, x) for i, x in enumerate(lines, 1)}
    lines = [f"g{i}" for i in range(700)]
    (tmp_path / "c.log.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "d.log.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    want |= {(f, i, x) for f in ("c.log.gz", "d.log.bz2") for i, x in enumerate(lines, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = [(x.file_path, x.line_no, x.content) for x in text.read_log_lines(spark, str(tmp_path), "a").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(want)
    assert {(f.replace("%20", " "), n, c) for f, n, c in got} == want


def tar(entries, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = tar([("node1/a.log", b"one\ntwo\n"), ("b.log", b"three")])
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("deep/n.tar.gz", tar([("x.log", b"deep\n")]))
        f.writestr("../evil.log", "no")
    (tmp_path / "top.tar").write_bytes(tar([("node1.tar.gz", inner), ("../bad.log", b"no"), ("p.zip", z.getvalue()), ("q.log.gz", gzip.compress(b"q1\nq2\n")), ("empty.log", b"")], "w"))
    (tmp_path / "broken.tar.gz").write_bytes(b"not an archive")
    damaged = gzip.compress(b"lost\n" * 5000)
    damaged = damaged[:20] + b"\xff" * 20 + damaged[40:]
    (tmp_path / "part.tar").write_bytes(tar([("in.tar.gz", b"no package"), ("bad.log.gz", damaged), ("after.log", b"still read\n")], "w"))
    table = archives.read_archives(spark, str(tmp_path))
    faults = {(r.archive_path.rpartition("/")[2], r.file_path) for r in table.where("error IS NOT NULL AND line_no IS NULL").collect()}
    assert faults == {("broken.tar.gz", ""), ("part.tar", "in.tar.gz"), ("part.tar", "bad.log")}
    assert [r.content for r in archives.archive_lines(table).where("file_path = 'after.log'").collect()] == ["still read"]
    got = {(r.file_path, r.line_no, r.content, r.depth) for r in table.where("error IS NULL AND NOT archive_path LIKE '%part.tar'").collect()}
    assert got == {("node1/a.log", 1, "one", 2), ("node1/a.log", 2, "two", 2), ("node1/b.log", 1, "three", 2), ("p/deep/n/x.log", 1, "deep", 3), ("q.log", 1, "q1", 1), ("q.log", 2, "q2", 1)}


def test_rotation(spark):
    rows = [("testlog/dmesg.1", 1, "[   1.000000] a"), ("testlog/dmesg.0", 1, "[  50.000000] b"), ("testlog/dmesg", 1, "[ 100.000000] c"), ("testlog/syslog.1", 1, "2026-01-01 10:00:00 x"), ("testlog/syslog.1", 2, "2026-01-01 10:00:01 y"), ("testlog/syslog", 1, "2026-01-01 12:00:00 z"), ("other/plain.log", 1, "p")]
    lines = spark.createDataFrame([("a", *r) for r in rows], LINES)
    names = lines.select("archive_id", "file_path").distinct().withColumn("original", F.when(F.col("file_path").endswith(".1"), F.concat("file_path", F.lit(".gz"))).otherwise(F.col("file_path")))
    got = sorted((r.file_path, r.line_no, r.content[-1]) for r in catalog.consolidate_rotated(lines, names).collect())
    assert got == [("other/plain.log", 1, "p"), *[("testlog/dmesg/dmesg", i, c) for i, c in enumerate("abc", 1)], *[("testlog/syslog/syslog", i, c) for i, c in enumerate("xyz", 1)]]


def test_archives_in_pieces(spark, tmp_path):
    """Pieces of any size give the rows of whole packages; odd names, an empty zip, a plain tar that is packed."""
    r = random.Random(4)
    entries = [(f"d{i % 3}/" + "n" * (140 if i % 5 == 0 else 4) + f"{i}.log", "".join(f"{i} {r.random()}\n" for _ in range(r.randrange(60))).encode()) for i in range(40)]
    folder = tmp_path / "odd #1 %20 name"
    folder.mkdir()
    (folder / "a b.tar").write_bytes(tar(entries, "w"))
    (folder / "packed.tar").write_bytes(tar(entries[:3], "w:gz"))
    with zipfile.ZipFile(folder / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    zipfile.ZipFile(folder / "none.zip", "w").close()
    whole = (folder / "c.zip").read_bytes()
    (folder / "cut.zip").write_bytes(whole[: len(whole) // 2])
    (folder / "cut.tar").write_bytes((folder / "a b.tar").read_bytes()[:20_000])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = sorted(map(repr, archives.explode_archives(files).collect()))
    assert sum("c.zip" in x for x in want) == sum(d.count(b"\n") for _, d in entries)
    for size in (2_000, 1 << 26):
        got = archives.read_archives(spark, str(tmp_path), piece_bytes=size)
        assert sorted(map(repr, got.collect())) == want
    pieces = [p for p in archives.plan_pieces(str(folder / "a b.tar"), 1, 1)]
    assert len(pieces) == 41 and [p[3] for p in pieces[:-1]] == [p[2] for p in pieces[1:]]


def test_package_of_over_2_gb(spark, tmp_path):
    """A sparse tar with a member of 3 GB without a line end, and a zip behind 3 GB of other bytes."""
    far = 3 << 30
    with open(tmp_path / "big.tar", "wb") as f:
        for name, size in (("core.bin", far), ("after.log", 6)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf())
            f.seek(size if size == far else 0, io.SEEK_CUR)
        f.write(b"a\nb\nc\n".ljust(512, b"\0") + bytes(1024))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as p:
        p.writestr("in.log", "far\n")
    with open(tmp_path / "far.zip", "wb") as f:
        f.seek(far)
        f.write(z.getvalue())
    got = archives.read_archives(spark, str(tmp_path)).collect()
    assert {(r.file_path, r.line_no, r.content) for r in got if not r.error} == {("after.log", 1, "a"), ("after.log", 2, "b"), ("after.log", 3, "c"), ("in.log", 1, "far")}
    assert [(r.file_path, r.line_no) for r in got if r.error] == [("core.bin", None)]


def test_forward_zip(monkeypatch):
    """An inner zip read in one pass has the members that its directory names; cut or locked ones are faults."""
    r = random.Random(5)
    entries = [(f"x/{i}.log", b"".join(b"%d %d\n" % (i, r.randrange(1 << 40)) for _ in range(r.randrange(20_000)))) for i in range(6)] + [("empty.log", b""), ("é.log", b"PK\3\4 PK")]

    class Pipe(io.BytesIO):  # no seeking: descriptors follow the members
        def seekable(self):
            return False

        def tell(self):
            raise OSError

        seek = tell

    for out in (io.BytesIO(), Pipe()):
        with zipfile.ZipFile(out, "w") as z:
            for i, (name, data) in enumerate(entries):
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED if i % 2 or isinstance(out, Pipe) else zipfile.ZIP_STORED
                with z.open(info, "w", force_zip64=i == 2) as f:
                    f.write(data)
        data = out.getvalue()
        assert [(p, f.read()) for p, f in archives.forward_zip(archives._Ahead(io.BytesIO(data)))] == entries
        assert [p for p, _ in archives.forward_zip(archives._Ahead(io.BytesIO(data)))] == [p for p, _ in entries]  # bodies left unread
        outer = tar([("in.zip", data), ("z.log", b"last")])
        whole = [(p, d, f.read()) for p, d, f in archives.walk(archives.members("o.tar.gz", io.BytesIO(outer)), "", 1, 9)]
        monkeypatch.setattr(archives, "HELD", 1000)
        assert [(p, d, f.read()) for p, d, f in archives.walk(archives.members("o.tar.gz", io.BytesIO(outer)), "", 1, 9)] == whole
        monkeypatch.undo()
        cut = tar([("in.zip", data[: len(data) // 2]), ("z.log", b"last")])
        monkeypatch.setattr(archives, "HELD", 1000)
        rows = list(archives._rows("o", lambda: archives.members("o.tar.gz", io.BytesIO(cut)), 9))  # noqa: B023
        monkeypatch.undo()
        assert rows[-1][1:5] == ("z.log", 1, 1, "last") and any(x[5] and x[1].startswith("in") for x in rows)


def test_paging_and_sub_archives(spark):
    lines = spark.range(1, 21).select(F.lit("a").alias("archive_id"), F.lit("f").alias("file_path"), F.col("id").alias("line_no"), F.lit("x").alias("content"))
    assert [(r.line_no, r.has_more) for r in text.read_lines(lines, "f", 1, 5).collect()][-1] == (5, True)
    assert sorted((r.line_no, r.has_more) for r in text.read_lines(lines, "f", 16, 10).collect())[-1] == (20, False)
    assert {r.total_lines for r in text.read_lines(lines, "f", 3, 2).collect()} == {20}
    files = spark.createDataFrame([("wrap/node-01/a.log", 1), ("wrap/node-01/sub/b.log", 2), ("wrap/node-02/c.log", 4), (".hidden/x", 9)], "file_path string, size long")
    assert [tuple(r) for r in catalog.detect_sub_archives(files).collect()] == [("node-01", "wrap/node-01", 2, 3, True), ("node-02", "wrap/node-02", 1, 4, False)]
    assert [r.name for r in catalog.list_children(files, "wrap").collect()] == ["node-01", "node-02"]
    assert {r.path for r in catalog.filter_tree(files, "B.LOG").collect()} == {"wrap", "wrap/node-01", "wrap/node-01/sub", "wrap/node-01/sub/b.log"}


def test_tables(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"id": "r", "name": "n", "pattern": "x", "severity": "FATAL"}) + "\n")
    (tmp_path / "prep.json").write_text("\n".join(json.dumps({"type": "mask", "pattern": p, "ord": o}) for p, o in (("b", 2), ("a", 1))))
    assert tables.load_rules(spark, str(tmp_path / "rules.json"))[0].enabled
    assert [r.pattern for r in tables.load_preprocess_rules(spark, str(tmp_path / "prep.json"))] == ["a", "b"]
    e = spark.createDataFrame([("a", "e1"), ("b", "e2")], "archive_id string, id string")
    r = spark.createDataFrame([("a", 90), ("b", 80)], "archive_id string, health_score int")
    tables.write_report(e, r, str(tmp_path / "out"))
    tables.write_report(e.where("archive_id = 'a'").withColumn("id", F.lit("new")), r.where("archive_id = 'a'"), str(tmp_path / "out"))
    events, reports = tables.read_report(spark, str(tmp_path / "out"), "a")
    assert [x.id for x in events.collect()] == ["new"] and reports.count() == 1
    assert tables.read_report(spark, str(tmp_path / "out"), "b")[0].first().id == "e2"
    assert sorted(x.id for x in tables.current_reports(spark, str(tmp_path / "out"))[0].collect()) == ["e2", "new"]
    bad = r.where("archive_id = 'b'").withColumn("health_score", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):  # events are written, the report is not
        tables.write_report(e.where("archive_id = 'b'").withColumn("id", F.lit("half")), bad, str(tmp_path / "out"))
    events, reports = tables.read_report(spark, str(tmp_path / "out"), "b")
    assert [x.id for x in events.collect()] == ["e2"] and reports.first().health_score == 80
    tables.write_report(e.limit(0), r.where("archive_id = 'b'"), str(tmp_path / "out"))
    events, reports = tables.read_report(spark, str(tmp_path / "out"), "b")
    assert events.count() == 0 and reports.count() == 1
    with pytest.raises(KeyError):
        tables.read_report(spark, str(tmp_path / "out"), "c")


def drained(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def alarm_files(spark, tmp_path):
    rows = [(f"n{i % 2}", "A", "critical", "t", str(i), "resolve" if i == 6 else "report", 10 * i, i) for i in range(12)]
    df = spark.createDataFrame(rows, "node_id string, alarm_type string, severity string, title string, message string, action string, s long, seq long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).select(*[c.split()[0] for c in ALARM_EVENTS.split(", ")])
    for k in range(2):
        df.where(F.floor(F.col("seq") / 6) == k).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_alarm_streams_equal_batch(spark, tmp_path):
    df, stream = alarm_files(spark, tmp_path / "alarms")
    reports = stream.where("action = 'report'")
    got = {r.seq for r in drained(spark, streams.debounce_stream(reports), "debounced", "append")}
    assert got == {r.seq for r in alarms.debounce(df.where("action = 'report'")).collect()}
    rows = drained(spark, streams.aggregate_stream(stream), "aggregated", "update")
    last = {}
    for r in rows:
        key = (r.node_id, r.episode)
        if key not in last or r["count"] >= last[key]["count"]:
            last[key] = r
    want = {(r.node_id, r.episode): (r["count"], r.status, r.message) for r in alarms.aggregate_alarms(df).collect()}
    assert {k: (r["count"], r.status, r.message) for k, r in last.items()} == want


def test_heartbeat_streams(spark, tmp_path):
    beats = spark.createDataFrame([("n1", 500), ("n1", 1500), ("n1", 5000)], "node_id string, free long").withColumn("ts", F.current_timestamp())
    beats = beats.select("node_id", F.lit("ip").alias("ip"), F.lit(1).alias("port"), "ts", F.lit("online").alias("status"), F.lit(10_000).cast("long").alias("disk_total_mb"), F.lit(0).cast("long").alias("disk_used_mb"), F.col("free").alias("disk_free_mb"), F.lit(100).cast("long").alias("mem_total_mb"), F.lit(50).cast("long").alias("mem_used_mb"))
    assert [c for c in beats.columns] == [c.split()[0] for c in HEARTBEATS.split(", ")]
    beats.write.parquet(str(tmp_path / "beats"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "beats"))
    got = drained(spark, streams.stream_signals(stream).where("alarm_type = 'DISK_FULL'"), "signals", "append")
    assert sorted(r.signal for r in got) == ["report", "resolve"]
    q = streams.offline_stream(stream, 1.0).writeStream.outputMode("update").format("memory").queryName("offline").start()
    try:
        until = time.time() + 40
        while time.time() < until and not spark.table("offline").count():
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.node_id, r.action) for r in spark.table("offline").collect()][:1] == [("n1", "report")]
