"""Scalar functions over a log line, all plain Column expressions.

Word characters are ASCII: patterns use look-arounds, since the JVM's own word boundary also knows other alphabets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PreprocessRule

LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Substrings that tell a line's level, in order of precedence.
LEVEL_MARKS = [
    ("FATAL", ["FATAL", "fatal", "EMERG"]),
    ("CRITICAL", ["CRIT", "critical"]),
    ("ERROR", ["ERR", "error", "Error"]),
    ("WARN", ["WARN", "warning", "Warn"]),
    ("DEBUG", ["DEBUG", "debug", "Debug"]),
    ("TRACE", ["TRACE", "trace"]),
]

# Patterns of times, levels, variables and trace ids.
ISO = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?"
ISO_AT_START = r"^\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?"
SYSLOG = r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
LEADING_TIME = r"^(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?|\[\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?\]|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
LEVEL_WORDS = "FATAL|FTL|CRIT(?:ICAL)?|ERROR|ERR|WARN(?:ING)?|WRN|INFO|INF|DEBUG|DBG|TRACE|TRC"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX = r"0x[0-9a-fA-F]+"
QUOTED = r'"([^"\\]|\\.)*"|' + r"'([^'\\]|\\.)*'"
TRACE = "(?:trace_?id|request_?id|req_?id|span_?id)[=:]\\s*([A-Za-z0-9_-]+)"
TRACE_KEYS = ["trace_id", "traceId", "requestId"]

# Months of syslog times.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Mask rules that a new installation starts with.
DEFAULT_PREPROCESS_RULES = [
    PreprocessRule("mask", r"(?i)\b(?:token|auth_token|session_id|sess_id)=[a-zA-Z0-9_\-\.]+", "<*>", True, 10, "prep_rule_auth_token"),
    PreprocessRule("mask", r"\btenant_[0-9a-zA-Z_\-]+\b", "<*>", True, 20, "prep_rule_tenant_prefix"),
]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """The match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def detect_level(content: Column) -> Column:
    """Level by case-sensitive substrings; INFO where none is found."""
    out = F.lit("INFO")
    for level, marks in reversed(LEVEL_MARKS):
        out = F.when(_any([content.contains(m) for m in marks]), level).otherwise(out)
    return out


def template_level(content: Column) -> Column:
    """Level by the first level word after the leading timestamp."""
    word = F.upper(F.regexp_extract(strip_timestamp(content), f"(?i){LEFT}({LEVEL_WORDS}){RIGHT}", 1))
    pairs = [("WARN", ["WARN", "WARNING", "WRN"]), ("ERROR", ["ERROR", "ERR"]), ("FATAL", ["FATAL", "FTL", "CRIT", "CRITICAL"]), ("DEBUG", ["DEBUG", "DBG"]), ("TRACE", ["TRACE", "TRC"])]
    known = F.create_map(*[F.lit(x) for level, words in pairs for w in words for x in (w, level)])
    return F.coalesce(F.try_element_at(known, word), F.lit("INFO"))  # one look-up: in a chain of tests each would run the regex anew


def level_priority(level: Column) -> Column:
    return F.when(level.isin("FATAL", "CRITICAL"), 4).when(level == "ERROR", 3).when(level.isin("WARN", "WARNING"), 2).otherwise(1)


def extract_timestamp(content: Column) -> Column:
    """Time text of a line: at its start, else the first ISO time, else a syslog time, else ''."""
    return F.coalesce(_found(content, ISO_AT_START), _found(content, ISO), _found(content, SYSLOG), F.lit(""))


def parse_log_time(ts: Column) -> Column:
    """TIMESTAMP of a time text in ISO forms ('/' only with a space and no fraction needed); null for syslog times."""
    plain = ts.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$|^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(plain, F.replace(ts, F.lit("/"), F.lit("-")).try_cast("timestamp"))


def strip_timestamp(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(content), LEADING_TIME, ""))


def leading_timestamp(content: Column) -> Column:
    return F.btrim(F.regexp_extract(F.trim(content), LEADING_TIME, 1), F.lit("[]"))


def mask_variables(s: Column) -> Column:
    """Addresses, UUIDs, hex numbers, quoted strings and whole digit runs become <*>."""
    s = F.regexp_replace(s, f"{LEFT}{IPV4}{RIGHT}", "<*>")
    s = F.regexp_replace(s, f"{LEFT}{UUID}{RIGHT}", "<*>")
    s = F.regexp_replace(s, f"{LEFT}{HEX}{RIGHT}", "<*>")
    s = F.regexp_replace(s, QUOTED, '"<*>"')
    return F.regexp_replace(s, f"{LEFT}[0-9]+{RIGHT}", "<*>")


def _valid(rules: Sequence[PreprocessRule], type_: str) -> list[PreprocessRule]:
    out = []
    for r in sorted(rules, key=lambda r: r.ord):
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        if r.enabled and r.pattern and r.type == type_:
            out.append(r)
    return out


def apply_mask_rules(s: Column, rules: Sequence[PreprocessRule]) -> Column:
    """User masks in order; a pattern that does not compile is skipped."""
    for r in _valid(rules, "mask"):
        s = F.regexp_replace(s, r.pattern, (r.replacement or "<*>").replace("\\", "\\\\").replace("$", "\\$"))
    return s


def apply_level_rules(level: Column, raw: Column, s: Column, rules: Sequence[PreprocessRule]) -> Column:
    """The last rule that matches the raw or cleaned line sets the level."""
    for r in _valid(rules, "level_mapping"):
        if r.replacement.strip():
            level = F.when(raw.rlike(r.pattern) | s.rlike(r.pattern), r.replacement.strip().upper()).otherwise(level)
    return level


def preprocess(content: Column, rules: Sequence[PreprocessRule] = ()) -> Column:
    """struct(cleaned, level, ts) of a line; a blank one gives ('', INFO, '')."""
    cleaned = apply_mask_rules(mask_variables(strip_timestamp(content)), rules)
    level = apply_level_rules(template_level(content), content, cleaned, rules)
    blank = F.trim(content) == ""
    return F.struct(
        F.when(blank, "").otherwise(cleaned).alias("cleaned"),
        F.when(blank, "INFO").otherwise(level).alias("level"),
        F.when(blank, "").otherwise(leading_timestamp(content)).alias("ts"),
    )


def extract_trace_id(content: Column) -> Column:
    """Id after a word such as trace_id=, else the value of a JSON key; null where there is none."""
    keys = [_found(content, f'"{k}"[^:]*:\\s*"([^"]+)"', 1) for k in TRACE_KEYS]
    return F.coalesce(_found(content, f"(?i){LEFT}{TRACE}", 1), *keys)


def tokenize(cleaned: Column) -> Column:
    return F.array_remove(F.split(cleaned, r"[\s\x85\xA0]+"), "")


def template_id(tokens: Column) -> Column:
    return F.concat(F.lit("tpl_"), F.substring(F.md5(F.array_join(tokens, " ")), 1, 6))


def seq_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two token arrays; 0 where their lengths differ or both are empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def _glob(pattern: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)


def path_regex(pattern: str) -> str:
    """One anchored regex for a list of path patterns; '' matches everything."""
    options = []
    for p in re.split("[,;]", pattern):
        p = p.strip().lower().removeprefix("./").removeprefix("/")
        if p:
            options.append(f"(?:.*/)?{_glob(p)}" if "/" not in p else f"(?:[^/]*/)?{_glob(p)}|(?:.*/)?{re.escape(p)}")
    return f"^(?:{'|'.join(options)})$" if options else ""


def match_file_path(pattern: str, path: Column) -> Column:
    """Scope test: a name or glob of the basename, or a path, path suffix or path glob; case does not count."""
    regex = path_regex(pattern)
    if not regex:
        return F.lit(True)
    return F.lower(path).rlike(regex)


# How kernel uptime, ISO time and syslog time are written at the start of a log.
UPTIME = r"^\[\s*(\d+(?:\.\d+)?)\]"
ISO_TIME = r"(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
SYSLOG_TIME = r"^(?:<\d+>)?([A-Z][a-z]{2})\s+(\d+)\s+(\d{2}):(\d{2}):(\d{2})"


def start_score(content: Column) -> Column:
    """Seconds that order the parts of a rotated log: kernel uptime, ISO time or syslog time; null where none is found."""
    c = F.trim(content)
    uptime = _found(c, UPTIME, 1).cast("double")
    iso = F.translate(_found(c, ISO_TIME, 1), "/T", "- ").try_cast("timestamp")
    part = lambda i: _found(c, SYSLOG_TIME, i).cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(c, SYSLOG_TIME, 1)), F.lit(0))
    clock = month * 31 * 86400 + part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.coalesce(uptime, F.unix_micros(iso) / 1e6, clock.cast("double"))


def fallback_score(path: Column) -> Column:
    """Order of a part without a time: a higher number in the extension is earlier; no number is last."""
    number = _found(path, r"\.([0-9]+)$", 1).try_cast("double")
    return F.coalesce(-number, F.lit(1000.0))


def truncate_content(s: Column, n: int = 500) -> Column:
    """At most n characters, then '...'."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def parse_tags(s: Column) -> Column:
    """Tags of a JSON array, else of a list with ASCII or wide commas and semicolons; trimmed, no blanks."""
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    given = F.from_json(F.when(F.trim(s).startswith("["), s), "array<string>")
    listed = F.array_distinct(trimmed(F.split(s, "[,;，；]")))
    return F.coalesce(trimmed(given), listed, F.array().cast("array<string>"))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s\x80-\U0010ffff])", r"\\\1", text)


def contains_word(content: Column, keyword: str, case_sensitive: bool = False) -> Column:
    """keyword stands between characters other than [A-Za-z0-9_]."""
    return content.rlike(("" if case_sensitive else "(?i)") + LEFT + _quoted(keyword) + RIGHT)


def contains_fold(content: Column, keyword: str) -> Column:
    """Substring test that folds the case of ASCII letters only."""
    return content.rlike("(?i)" + _quoted(keyword)) if keyword else F.lit(True)


def prefix_before_dot(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def index_tokens(content: Column) -> Column:
    """Distinct tokens for the chunk index: 2 to 64 of [a-z0-9_-], without runs of over four digits."""
    tokens = F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9_-]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t).between(2, 64) & ~t.rlike("^[0-9]{5,}$")))


def in_scope(path: Column, sub: str) -> Column:
    return F.lit(True) if not sub else (path == sub) | path.startswith(sub.rstrip("/") + "/")


def normalize_path(path: Column, sub: str) -> Column:
    """Path relative to the sub-tree; the basename of a path outside it."""
    if not sub:
        return path
    prefix = sub.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(F.substring_index(path, "/", -1))


def is_log_file(path: Column) -> Column:
    """Known extensions or none; otherwise a name that holds log or trace."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return ext.isin(".log", ".txt", ".out", ".err", ".trace", ".json", ".csv", "") | name.contains("log") | name.contains("trace")


def archive_format(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("log")
    for suffix in reversed([".tar.gz", ".tgz", ".zip", ".7z", ".tar.bz2", ".tar", ".gz", ".bz2"]):
        out = F.when(low.endswith(suffix), suffix[1:]).otherwise(out)
    return out
