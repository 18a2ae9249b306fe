"""Diagnosis with thousands of rules: lines and rules meet by strings, and only what meets is tested.

A plan of constant patterns grows with the rules, and every line pays for each.  Here the rules are a table.  From a
pattern's syntax tree (gram_index.text_plan) comes a cover: strings of which every line that matches has at least one.
Each string is filed under one of its grams, as long as it has (up to 16 bytes), so a rule meets few lines.  Lines look
their grams up in a bit table of fixed size, and the few that may be some rule's meet rules by an equi-join; a pair is
taken at the first string of the cover that the line has, so no pair is made twice and nothing is sorted out
afterwards.  Neither the plan nor what tasks are given grows with the rules.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import line as L
from ..schema import Rule
from ..scratch import written
from .diagnose import scan_rules
from .gram_index import COMMON, FOLD, Plan, cover_of, text_plan, texts_of

KEYED = "id string, name string, storage_type string, severity string, pattern string, is_regex boolean, file_path_pattern string, suggestion string, scope string, cover array<string>, needs array<string>, keys array<bigint>, sizes array<int>"
SIZES = (16, 8, 6, 4, 3)  # of grams, in bytes; no certain string has fewer than three
BITS = 22  # of a bit table's places
FACTOR = {n: (0x9E3779B97F4A7C15 * (2 * n + 1)) & (1 << 64) - 1 | 1 for n in (*SIZES, 0)}
FREQUENT = frozenset("".join(COMMON).encode())


def grams_at(data: np.ndarray, size: int) -> np.ndarray:
    """The key of the gram of `size` bytes at each place of data but the last 16: a product of its 64-bit words."""
    n = len(data) - 16
    word = np.ndarray(n + 8, "<u8", np.ascontiguousarray(data), strides=(1,))
    if size == 16:
        return word[:n] * np.uint64(FACTOR[16]) + word[8:] * np.uint64(FACTOR[0])
    return (word[:n] << np.uint64(64 - 8 * size)) * np.uint64(FACTOR[size])


def grams_of_string(text: str) -> tuple[int, dict[int, bytes]]:
    """The longest size of grams that the string has, and its grams by their keys."""
    raw = text.encode("utf-8", "surrogatepass")
    size = next(n for n in SIZES if n <= len(raw))
    keys = grams_at(np.frombuffer(raw + bytes(16), np.uint8), size)[: len(raw) - size + 1].view(np.int64).tolist()
    return size, {k: raw[i : i + size] for i, k in enumerate(keys)}


def _filed(text: str, weights: Mapping[int, int] | None = None) -> tuple[int, int]:
    """(size, key) of the gram a string is filed under: that of the fewest lines, or else of the fewest common letters."""
    size, grams = grams_of_string(text)
    return size, min(grams, key=lambda k: (weights.get(k, 0) if weights is not None else 0, sum(c in FREQUENT for c in grams[k]), grams[k]))


def _asked(pattern: str, is_regex: bool) -> tuple[bool, Plan]:
    """Whether the pattern is run as a regex (a bad one is taken literally), and the strings it asks for."""
    if is_regex:
        try:
            re.compile(pattern)
            return True, text_plan(pattern)
        except re.error:
            pass
    return False, texts_of({pattern.translate(FOLD)})


def needs_of(plan: Plan) -> set[str]:
    """Strings that every line has which the plan lets through."""
    if plan is True:
        return set()
    return {plan} if isinstance(plan, str) else set().union(*map(needs_of, plan[1])) if plan[0] == "and" else set()


def _all_grams(plan: Plan) -> set[str]:
    return set() if plan is True else {plan} if isinstance(plan, str) else set().union(*map(_all_grams, plan[1]))


def _all_keys(pattern: str, is_regex: bool) -> dict[int, int]:
    """key -> size of every gram that a rule might be filed under."""
    return {k: size for t in _all_grams(_asked(pattern, is_regex)[1]) for size, grams in [grams_of_string(t)] for k in grams}


def bit_tables(keys: DataFrame) -> dict[int, bytes]:
    """size -> a table of 2^BITS bits in which those of the keys (key, size) are set; half a megabyte each at most."""
    bit = F.shiftrightunsigned("key", 64 - BITS) + 1
    x = keys.groupBy("size", F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out: dict[int, bytearray] = {}
    for r in x.collect():
        at = (r["part"] - 1) * len(r["bits"])
        out.setdefault(r["size"], bytearray(1 << BITS - 3))[at : at + len(r["bits"])] = r["bits"]
    return {n: bytes(b) for n, b in sorted(out.items())}


def keys_in(texts: pa.Array, tables: dict[int, np.ndarray], piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct grams of texts, A-Z lower-cased, whose bits are set, by rows; pieces of the bytes at a time."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if at[-1] > at[0] else np.empty(0, np.uint8)
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(int(at[0]), int(at[-1]), piece):
        n = min(piece, int(at[-1]) - a)
        part = np.zeros(n + 16, np.uint8)
        own = data[a : min(a + n + 16, int(at[-1]))]
        part[: len(own)] = own + ((own >= 65) & (own <= 90)).astype(np.uint8) * np.uint8(32)
        for size, table in tables.items():
            key = grams_at(part, size)
            hit = np.flatnonzero(table[(key >> np.uint64(64 - BITS)).view(np.int64)])
            row = np.searchsorted(at, hit + a, side="right") - 1
            inside = hit + a + size <= at[row + 1]
            rows.append(row[inside])
            keys.append(key[hit[inside]])
    row, key = np.concatenate(rows), np.concatenate(keys).view(np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def with_keys(rows: DataFrame, bits: dict[int, bytes]) -> DataFrame:
    """Rows whose text has a gram that bits lets through, with the keys of all such grams."""
    schema = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").view(bool) for n, b in bits.items()}
        for b in batches:
            row, key = keys_in(b.column("text"), tables)
            found, first = np.unique(row, return_index=True)
            if len(found):
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(key))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(found)).columns, lists], names=[*b.schema.names, "keys"])

    return rows.mapInArrow(look, schema)


def _plain(rules: DataFrame) -> DataFrame:
    """Enabled rules with a pattern; a missing flag counts as true, a missing text as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    on = F.coalesce("enabled", F.lit(True)) & (F.coalesce("pattern", F.lit("")) != "")
    return rules.where(on).select(*map(text, ("id", "name", "storage_type", "severity", "pattern")), F.coalesce("is_regex", F.lit(True)).alias("is_regex"), text("file_path_pattern"), text("suggestion"))


def _texts(lines: DataFrame) -> DataFrame:
    return lines.select("archive_id", "file_path", "line_no", F.trim("content").alias("text")).where("text != ''")


def gram_weights(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n): how many lines have each gram that some rule might be filed under; counts combine before the shuffle."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = {k: n for p, r in zip(b["pattern"], b["is_regex"]) for k, n in _all_keys(p, r).items()}
            yield pd.DataFrame({"key": list(found), "size": list(found.values())})

    wanted = written(_plain(rules).select("pattern", "is_regex").mapInPandas(asked, "key long, size int").distinct(), "grams")
    met = with_keys(_texts(lines).select("text"), bit_tables(wanted)).select(F.explode("keys").alias("key"))
    return met.join(wanted.select("key").distinct(), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def rule_keys(rules: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Enabled rules with cover, needs, the grams they are filed under and the regex of their path scope; rules of any
    number, one pass in tasks."""
    names = [c.split()[0] for c in KEYED.split(", ")]
    table = _plain(rules)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans = [_asked(p, r) for p, r in zip(b["pattern"], b["is_regex"])]
            counts = [{w["key"]: w["n"] for w in ws} for ws in b["weights"]] if "weights" in b else [None] * len(b)
            b = b.assign(is_regex=[r for r, _ in plans], scope=[L.path_regex(p) for p in b["file_path_pattern"]])
            least = [w if w is None else {t: min(w.get(k, 0) for k in grams_of_string(t)[1]) for t in _all_grams(plan)} for (_, plan), w in zip(plans, counts)]
            b["cover"] = [cover_of(plan, w) for (_, plan), w in zip(plans, least)]
            b["needs"] = [sorted(needs_of(plan)) for _, plan in plans]
            filed = [[_filed(t, w) for t in cover] for cover, w in zip(b["cover"], counts)]
            b["keys"], b["sizes"] = [[k for _, k in x] for x in filed], [[n for n, _ in x] for x in filed]
            yield b[names]

    if weights is not None:

        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(p, r, k) for p, r in zip(b["pattern"], b["is_regex"]) for k in _all_keys(p, r)]
                yield pd.DataFrame(rows, columns=["pattern", "is_regex", "key"])

        each = table.select("pattern", "is_regex").distinct().mapInPandas(grams, "pattern string, is_regex boolean, key long").join(weights, "key")
        known = each.groupBy("pattern", "is_regex").agg(F.collect_list(F.struct("key", "n")).alias("weights"))
        table = table.join(known, ["pattern", "is_regex"], "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<struct<key:bigint,n:bigint>>")))
    return table.mapInPandas(key, KEYED)


def scan_rule_table(lines: DataFrame, rules: DataFrame, counted: bool = False, block: int = 64) -> DataFrame:
    """The events of diagnose.scan_rules, for a table of rules of any number (columns as schema.RULES).

    counted reads the lines once more to learn how frequent the rules' grams are, and files each rule under its rarest.
    The keyed rules are written first, so Spark knows their size and broadcasts them below its own limit only; above it
    the grams of lines are shuffled, and adaptive execution splits a gram that most lines have.  Patterns that ask for no
    string (shorter than three characters, or nothing certain) meet every line as constants, `block` rules a pass.
    Lines without text or with null content have no events; a rule id that occurs twice gives an event for each row.
    """
    keyed = written(rule_keys(rules, gram_weights(lines, rules) if counted else None), "rules")
    each = keyed.withColumn("filed", F.explode(F.arrays_zip("cover", "keys", "sizes")))
    rows = with_keys(_texts(lines), bit_tables(each.select("filed.keys", "filed.sizes").toDF("key", "size")))
    rows = rows.withColumn("key", F.explode("keys")).drop("keys")
    met = rows.join(each.select("*", F.col("filed.keys").alias("key"), F.col("filed.cover").alias("part")).drop("filed", "keys", "sizes"), "key")
    met = met.withColumn("folded", F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    first = F.element_at(F.filter("cover", lambda g: F.contains(F.col("folded"), g)), 1) == F.col("part")
    whole = F.forall("needs", lambda g: F.contains(F.col("folded"), g))
    literal = F.contains(F.col("folded"), F.translate("pattern", string.ascii_uppercase, string.ascii_lowercase))
    hits = met.where(first & whole)
    hits = hits.where(F.when(F.col("is_regex"), F.expr("text RLIKE pattern")).otherwise(literal))
    hits = hits.where((F.col("scope") == "") | F.expr("lower(file_path) RLIKE scope"))
    key = F.concat_ws("_", F.lit("evt"), F.col("archive_id"), F.substring(F.md5("file_path"), 1, 8), F.col("line_no").cast("string"), F.col("id"))
    out = hits.select(
        key.alias("id"), "archive_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity", "storage_type", "file_path", "line_no",
        L.truncate_content(F.col("text")).alias("matched_content"), "suggestion", L.extract_timestamp(F.col("text")).alias("ts"),
    )
    fields = ["id", "name", "storage_type", "severity", "pattern", "is_regex", "file_path_pattern", "suggestion"]
    rest = [Rule(**{f: r[f] for f in fields}) for r in keyed.where("size(cover) = 0").select(*fields).toLocalIterator()]
    for i in range(0, len(rest), block):
        out = out.unionByName(scan_rules(lines, rest[i : i + block]))
    return out
