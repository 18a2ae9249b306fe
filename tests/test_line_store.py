"""Pages come from the row groups they lie in; a run replaces archives at once or not at all."""

import pytest
from pyspark.sql import functions as F

from loglode.schema import LINES
from loglode.sources import line_store as S
from loglode.sources import text


@pytest.fixture(scope="module")
def lines(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("archive_id"), F.when(F.col("id") % 4 == 0, "small.log").otherwise("huge.log").alias("file_path"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit("line "), F.md5(F.col("id").cast("string"))).alias("content"))
    return rows.withColumn("line_no", F.when(F.col("file_path") == "small.log", F.expr("(line_no - 1) div 4 + 1")).otherwise(F.expr("line_no - (line_no - 1) div 4 - 1"))).orderBy(F.rand(3))


def scanned(df):
    """Rows that the scan of a collected DataFrame put out, before any filter."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            out += node.metrics().apply("numOutputRows").value()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_pages_equal_those_of_the_lines(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    S.write_lines(lines, path, parts=6, group_bytes=1 << 18, page_rows=500)
    for file, start, limit in [("huge.log", 70_001, 50), ("huge.log", 149_990, 50), ("small.log", 0, 0), ("small.log", 49_000, 9_999), ("none.log", 1, 5)]:
        got, want = S.read_stored(spark, path, "a", file, start, limit).collect(), text.read_lines(lines, file, start, limit).orderBy("line_no").collect()
        assert got == want
    page = S.read_stored(spark, path, "a", "huge.log", 70_001, 50)
    assert 50 <= scanned(page) <= 20_000 < lines.count()
    with pytest.raises(KeyError):
        S.read_stored(spark, path, "b", "huge.log")
    assert S.stored_lines(spark, path).exceptAll(lines).isEmpty() and S.stored_lines(spark, path).count() == 200_000
    assert {tuple(r) for r in S.stored_counts(spark, path).collect()} == {("a", "huge.log", 150_000), ("a", "small.log", 50_000)}


def test_runs_replace_archives_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    with pytest.raises(KeyError):
        S.stored_lines(spark, path)
    make = lambda *rows: spark.createDataFrame(list(rows), LINES)
    S.write_lines(make(("a", "x", 1, "one"), ("b", "x", 1, "other"), ("a", "x", 2, None), (None, "x", 1, "lost")), path)
    S.write_lines(make(("a", "x", 1, "new")), path)
    monkeypatch.setattr(S, "enter_run", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        S.write_lines(make(("b", "x", 1, "half")), path)
    monkeypatch.undo()
    assert {tuple(r) for r in S.stored_lines(spark, path).collect()} == {("a", "x", 1, "new"), ("b", "x", 1, "other"), (None, "x", 1, "lost")}
    assert [tuple(r) for r in S.read_stored(spark, path, "a", "x").collect()] == [(1, "new", False, 1)]
    wide = make(("c", "x", 1, "kept"), ("c", "x", 1, "kept")).withColumn("run", F.lit("clash")).withColumn("total_lines", F.lit(9))
    S.write_lines(wide, path)
    assert S.read_stored(spark, path, "c", "x").collect() == [(1, "kept", False, 1)] * 2
    S.write_lines(make(), path)
    assert S.stored_lines(spark, path).count() == 5
