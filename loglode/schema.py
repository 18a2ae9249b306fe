"""Schemas and small value classes of the log tables."""

from __future__ import annotations

from dataclasses import dataclass, field

LINES = "archive_id string, file_path string, line_no bigint, content string"
FILES = "archive_id string, file_path string, size bigint, mod_time timestamp, line_count bigint"
EVENTS = "id string, archive_id string, rule_id string, rule_name string, severity string, storage_type string, file_path string, line_no bigint, matched_content string, suggestion string, ts string"
METRICS = "file_path string, series string, unit string, idx bigint, t string, value double, line_no bigint"
HEARTBEATS = "node_id string, ip string, port int, ts timestamp, status string, disk_total_mb bigint, disk_used_mb bigint, disk_free_mb bigint, mem_total_mb bigint, mem_used_mb bigint"
ALARM_EVENTS = "node_id string, alarm_type string, severity string, title string, message string, action string, ts timestamp, seq bigint"
RULES = "id string, name string, storage_type string, severity string, pattern string, is_regex boolean, file_path_pattern string, description string, suggestion string, enabled boolean"
PREPROCESS_RULES = "id string, type string, pattern string, replacement string, enabled boolean, ord int, created_at timestamp"


@dataclass(frozen=True)
class Rule:
    """A fault rule: a pattern looked for in every line of the files in scope."""

    id: str
    name: str
    storage_type: str
    severity: str
    pattern: str
    is_regex: bool = True
    file_path_pattern: str = ""
    description: str = ""
    suggestion: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class PreprocessRule:
    """type 'mask' replaces matches; 'level_mapping' sets the level of matching lines."""

    type: str
    pattern: str
    replacement: str = ""
    enabled: bool = True
    ord: int = 0
    id: str = ""


@dataclass(frozen=True)
class SearchQuery:
    keyword: str = ""
    regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False
    level: str = ""
    path: str = ""
    start_time: str = ""
    end_time: str = ""
    context: int = 2
    page: int = 1
    page_size: int = 50
    max_per_file: int | None = None
    max_total: int | None = None


@dataclass(frozen=True)
class RetentionConfig:
    days: int = 180
    warning_pct: float = 85.0
    emergency_pct: float = 92.0
    target_pct: float = 75.0
    enabled: bool = True
    exempt_tags: tuple[str, ...] = field(default=("retain", "keep"))
