"""Metric logs as time series: parsers, time slices, anomalies, peak-preserving downsampling.

A series table is long: file_path, series, unit, idx, t, value, line_no.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import line as L
from ..schema import METRICS
from ..scratch import written
from .running import running

KEYS = ["file_path", "series"]
Limits = dict[str, tuple[float, float]]

# Fixed values: (warning, critical) of device utilisation and of time spent waiting for disks, in percent.
IOSTAT_LIMITS: Limits = {"": (85, 95)}
VMSTAT_LIMITS: Limits = {"wa": (40, 70)}


class ParserRegistry:
    """Which parser reads which file: a regex found in the path or basename, or a glob of the basename."""

    def __init__(self):
        self.entries: list[tuple[str, str, Callable[[DataFrame], DataFrame], bool]] = []
        self.limits: list[tuple[str, Limits]] = []

    def register(self, name: str, pattern: str, parser: Callable[[DataFrame], DataFrame], enabled: bool = True, limits: Limits | None = None) -> None:
        """parser: lines -> series table, built from Column expressions or mapInPandas, so a file of any size splits.

        limits: the parser's own (warning, critical) of a series, or of every series under "".
        """
        self.entries.append((name, pattern, parser, enabled))
        if enabled and limits:
            self.limits.append((pattern, limits))

    def register_whole_file(self, name: str, pattern: str, fn: Callable[[pd.DataFrame], pd.DataFrame], enabled: bool = True) -> None:
        """fn: the ordered lines of one file -> rows of the series table; for formats that need the whole file."""

        def parse(lines: DataFrame) -> DataFrame:
            return lines.groupBy("file_path").applyInPandas(lambda p: fn(p.sort_values("line_no")), METRICS)

        self.register(name, pattern, parse, enabled)

    def match(self, files: DataFrame) -> DataFrame:
        """(file_path, parser) for the distinct paths of files."""
        tests = [F.when(_names(F.col("file_path"), p), F.lit(n)) for n, p, _, on in self.entries if on] or [F.lit(None).cast("string")]
        paths = files.select("file_path").distinct()
        return paths.select("file_path", F.explode(F.array_compact(F.array(*tests))).alias("parser"))

    def parse(self, lines: DataFrame) -> DataFrame:
        """Series of all files that some parser takes."""
        out = lines.sparkSession.createDataFrame([], METRICS)
        for _, pattern, parser, on in self.entries:
            if on:
                out = out.unionByName(parser(lines.where(_names(F.col("file_path"), pattern))))
        return out

    def own_anomalies(self, metrics: DataFrame) -> DataFrame:
        """Points at or above the limits of the parsers that read their files."""
        out = threshold_anomalies(metrics.where(F.lit(False)), 0, 0)
        for pattern, limits in self.limits:
            rows = metrics.where(_names(F.col("file_path"), pattern))
            for series, (warning, critical) in limits.items():
                out = out.unionByName(threshold_anomalies(rows.where(F.col("series") == series) if series else rows, warning, critical))
        return out


def _names(path, pattern: str):
    base = F.substring_index(path, "/", -1)
    glob = base.rlike(f"^{L._glob(pattern)}$")
    try:
        re.compile(pattern)
    except re.error:
        return glob
    return path.rlike(pattern) | base.rlike(pattern) | glob


def _with_idx(rows: DataFrame) -> DataFrame:
    return running(rows, KEYS, ["line_no"], counts=["idx"])


def parse_iostat(lines: DataFrame, devices: int | None = None) -> DataFrame:
    """Device utilisation: a time line sets the time; a data line has 12 fields or more and ends with %util.

    Only time and data lines are run over, parsed once and dealt once for times and places; `devices` keeps that many
    devices of a file, the first by name.
    """
    text = F.trim("content")
    rows = lines.select("file_path", "line_no", text.alias("s"))
    time = r"^(?:Time:\s+)?(\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
    rows = rows.withColumn("t0", F.nullif(F.regexp_extract("s", time, 1), F.lit(""))).withColumn("f", F.split("s", r"\s+"))
    value = F.when(F.col("t0").isNull() & (F.size("f") >= 12) & ~F.col("s").startswith("Device") & ~F.col("s").startswith("avg-cpu"), F.element_at("f", -1).try_cast("double"))
    rows = written(rows.select("file_path", "line_no", "t0", value.alias("value"), F.get("f", F.lit(0)).alias("series")), "parsed")
    data = F.col("value").isNotNull()
    rows = rows.where("t0 IS NOT NULL OR value IS NOT NULL").select("file_path", "line_no", "t0", "value", F.when(data, F.col("series")).alias("series"), data.cast("long").alias("one"))
    rows = running(rows, ["file_path"], ["line_no"], sums={"idx": "one"}, lasts={"t": "t0"}, within=["series"]).where("value IS NOT NULL")
    if devices is not None:
        rank = F.row_number().over(Window.partitionBy("file_path").orderBy("series"))  # of a file's distinct devices
        first = rows.select("file_path", "series").distinct().withColumn("rank", rank).where(F.col("rank") <= devices)
        rows = rows.join(first, KEYS, "left_semi")
    return rows.select("file_path", "series", F.lit("%").alias("unit"), F.col("idx").cast("long"), F.coalesce("t", F.col("line_no").cast("string")).alias("t"), "value", "line_no")


def parse_vmstat(lines: DataFrame) -> DataFrame:
    """us, sy and wa of each sample (fields 5, 4 and 2 from the end of 17 or more); t is the sample's number."""
    f = F.split(F.trim("content"), r"\s+")
    number = lambda i: F.element_at("f", -i).try_cast("double")
    rows = lines.select("file_path", "line_no", f.alias("f")).where(F.size("f") >= 17)
    rows = rows.select("file_path", "line_no", number(5).alias("us"), number(4).alias("sy"), number(2).alias("wa")).dropna()
    rows = running(rows, ["file_path"], ["line_no"], counts=["idx"])
    long = rows.select("file_path", "line_no", "idx", F.expr("stack(3, 'us', us, 'sy', sy, 'wa', wa) AS (series, value)"))
    return long.select("file_path", "series", F.lit("%").alias("unit"), F.col("idx").cast("long"), F.col("idx").cast("string").alias("t"), "value", "line_no")


def parse_time_value(lines: DataFrame, series: str = "value", unit: str = "%") -> DataFrame:
    """Lines 'HH:MM:SS value'."""
    pattern = r"^\s*(\d{2}:\d{2}:\d{2})\s+([0-9.]+)\s*$"
    rows = lines.select("file_path", F.lit(series).alias("series"), F.lit(unit).alias("unit"), F.regexp_extract("content", pattern, 1).alias("t"), F.regexp_extract("content", pattern, 2).try_cast("double").alias("value"), "line_no")
    return _with_idx(rows.where("t <> '' AND value IS NOT NULL")).select(*[c.split()[0] for c in METRICS.split(", ")]).withColumn("idx", F.col("idx").cast("long"))


def threshold_anomalies(metrics: DataFrame, warning: float, critical: float) -> DataFrame:
    """Points at or above a parser's own limits."""
    severity = F.when(F.col("value") >= critical, "CRITICAL").otherwise("WARNING")
    reason = F.format_string("%s is at %.1f%s", "series", _tenth("value"), "unit")
    return metrics.where(F.col("value") >= warning).select(*KEYS, "idx", "t", "value", severity.alias("severity"), reason.alias("reason"), "line_no")


def _tenth(c: str) -> Column:
    return F.floor(F.col(c) * 10 + 0.5) / 10


def slice_window(metrics: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """From the first idx with t >= start to the last with t <= end, as texts; idx starts at 0 again.

    A bound that no point meets is ignored; if the bounds cross, nothing is cut.
    """
    if not start and not end:
        return metrics.where("file_path IS NOT NULL AND idx >= 0")
    ends = metrics.groupBy("file_path").agg(
        (F.min(F.when(F.col("t") >= start, F.col("idx"))) if start else F.lit(None).cast("long")).alias("a"),
        (F.max(F.when(F.col("t") <= end, F.col("idx"))) if end else F.lit(None).cast("long")).alias("b"),
        F.max("idx").alias("top"),
    )
    ends = ends.select("file_path", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", "top").alias("b"), "top")
    ends = ends.select("file_path", F.when(F.expr("a > b"), 0).otherwise(F.col("a")).alias("a"), F.when(F.expr("a > b"), F.col("top")).otherwise(F.col("b")).alias("b"))
    return metrics.join(ends, "file_path").where("idx BETWEEN a AND b").withColumn("idx", F.col("idx") - F.col("a")).drop("a", "b")


def detect_anomalies(metrics: DataFrame, cap: int | None = None) -> DataFrame:
    """Jumps beyond the mean change by three deviations (and over 10), and percentages of 90 or more.

    The step before each point comes from an equi-join on idx, so one very long series still splits over tasks.
    """
    prev = metrics.select(*KEYS, (F.col("idx") + 1).alias("idx"), F.col("value").alias("prev"))
    steps = metrics.join(prev, [*KEYS, "idx"]).withColumn("d", F.abs(F.col("value") - F.col("prev")))
    size = metrics.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    stats = steps.groupBy(*KEYS).agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd")).join(size, KEYS)
    stats = stats.select(*KEYS, "mu", F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")).alias("sd"))
    hot = (F.col("value") >= 90) & (F.col("unit") == "%")
    spike = (F.col("d") > F.col("mu") + 3 * F.col("sd")) & (F.col("d") > 10)
    severity = F.when((F.col("value") >= 95) | (F.col("d") >= 50), "CRITICAL").otherwise("WARNING")
    word, sign = F.when(F.col("value") < F.col("prev"), "fell to").otherwise("rose to"), F.when(F.col("value") < F.col("prev"), "-").otherwise("+")
    reason = F.format_string("%s %s %.1f%s (before: %.1f%s, change: %s%.1f)", "series", word, _tenth("value"), "unit", _tenth("prev"), "unit", sign, _tenth("d"))
    out = steps.join(stats, KEYS).where(hot | spike).select(*KEYS, "idx", "t", "value", severity.alias("severity"), reason.alias("reason"), "line_no")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("file_path").orderBy("idx", "series"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
    return out


def downsample_minmax(metrics: DataFrame, anomalies: DataFrame | None = None, target: int = 1500) -> DataFrame:
    """Per bucket and series the first minimum and first maximum, the ends, and all anomalies; idx counts anew.

    Files of at most `target` points, or a target below 4, stay as they are.
    """
    if target < 4:
        return metrics.withColumn("new_idx", F.col("idx"))
    n = metrics.groupBy("file_path").agg((F.max("idx") + 1).alias("n"))
    rows = metrics.join(n, "file_path")
    width = F.col("n") / F.lit(float(target // 2))
    guess = F.floor(F.col("idx") / width)
    bucket = guess + F.when(F.floor((guess + 1) * width) <= F.col("idx"), 1).otherwise(0) - F.when(F.floor(guess * width) > F.col("idx"), 1).otherwise(0)
    big = rows.where(F.col("n") > target).withColumn("bucket", bucket)
    picks = big.groupBy(*KEYS, "bucket").agg(F.min_by("idx", F.struct("value", "idx")).alias("lo"), F.max_by("idx", F.struct("value", -F.col("idx"))).alias("hi"))
    keep = picks.select("file_path", F.explode(F.array("lo", "hi")).alias("idx"))
    keep = keep.unionByName(n.where(F.col("n") > target).select("file_path", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx")))
    keep = keep.unionByName(rows.where(F.col("n") <= target).select("file_path", "idx"))
    if anomalies is not None:
        keep = keep.unionByName(anomalies.select("file_path", "idx"))
    keep = keep.distinct()
    keep = keep.withColumn("new_idx", (F.row_number().over(Window.partitionBy("file_path").orderBy("idx")) - 1).cast("long"))
    return metrics.join(keep, ["file_path", "idx"])


def anomalies_of(anomalies: DataFrame, name: str) -> DataFrame:
    """Anomalies whose series equals the name, starts with it, or is how it starts."""
    return anomalies.where(F.col("series").startswith(name) | F.lit(name).startswith(F.col("series")))


def anomaly_lines(anomalies: DataFrame, lines: DataFrame) -> DataFrame:
    """The line of each anomaly: by number, else the first of its file that holds the time text.

    Texts with a clock time meet only lines that hold the same clock time; others are sought in all lines of the file.
    """
    by_number = anomalies.where("line_no IS NOT NULL").join(lines.select("file_path", "line_no", "content"), ["file_path", "line_no"], "left")
    text = anomalies.where("line_no IS NULL").drop("line_no")
    clock = r"(?=(\d{2}:\d{2}:\d{2}))"
    times = text.select("file_path", "t", F.nullif(F.regexp_extract("t", clock, 1), F.lit("")).alias("clock")).distinct()
    rows = lines.select("file_path", "line_no", "content")
    timed = rows.withColumn("clock", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(clock), F.lit(1)))))
    first = timed.join(times.where("clock IS NOT NULL"), ["file_path", "clock"]).drop("clock")
    first = first.unionByName(rows.join(times.where("clock IS NULL").drop("clock"), "file_path")).where(F.col("content").contains(F.col("t")))
    first = first.groupBy("file_path", "t").agg(F.min(F.struct("line_no", "content")).alias("l")).select("file_path", "t", "l.line_no", "l.content")
    return by_number.unionByName(text.join(first, ["file_path", "t"], "left"))


def chart_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file: points before and after downsampling, whether it happened, first and last time, resolution in words."""
    a = before.groupBy("file_path").agg((F.max("idx") + 1).alias("total_points"), F.min_by("t", F.struct("idx", "series")).alias("start_t"), F.max_by("t", F.struct("idx", "series")).alias("end_t"))
    b = after.groupBy("file_path").agg(F.count_distinct("idx").alias("points"))
    out = a.join(b, "file_path").withColumn("downsampled", F.col("points") < F.col("total_points"))
    words = F.when(F.col("downsampled"), F.format_string("lows and highs (%d points)", "points")).otherwise(F.format_string("all points (%d points)", "points"))
    return out.withColumn("resolution", words)


def chart(lines: DataFrame, registry: ParserRegistry, start: str = "", end: str = "", target: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(series, anomalies): slice, then detect, then downsample; files with anomalies by their parser's limits have
    these only.

    Points are written once and read from there, and only files without such anomalies are searched for others.
    """
    m = written(slice_window(registry.parse(lines), start, end), "points")
    if not registry.limits:
        a = detect_anomalies(m)
    else:
        own = written(registry.own_anomalies(m), "own")
        rest = written(m.join(own.select("file_path").distinct(), "file_path", "left_anti"), "rest")
        a = own.unionByName(detect_anomalies(rest))
    return downsample_minmax(m, a, target), a


def by_pandas(fn: Callable[[pd.DataFrame], pd.DataFrame], lines: DataFrame) -> DataFrame:
    """A line-local parser given as a pandas function, run on batches of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return lines.mapInPandas(run, METRICS)
