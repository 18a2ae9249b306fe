"""Data skipping for any search: which chunks of lines hold the q-grams that a keyword or a regex needs.

The index has a row for each chunk with the distinct grams of its lines, A-Z lower-cased.  A search becomes a plan, a
Boolean of grams that every matching line has, read off the regex's syntax tree; chunks without them are not read.
The plan may ask for less than the regex, never for more: what the tree says nothing certain about asks for nothing,
and where nothing at all is asked for every chunk is read.  The search's own test then runs on what is left, so results
are those of the search without an index.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Mapping
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import SearchQuery
from .search import matching

Q = 3
COMMON = frozenset(" etaoinsrhl")  # characters that most lines have
MANY = 32  # strings that one part of a regex may stand for
Plan = object  # True, a gram, or ("and" | "or", parts)
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class _Unclear(Exception):
    """A construct that the reader of regexes may understand otherwise than the one that runs them."""


def both(parts, kind: str = "and") -> Plan:
    """The plan that asks for all parts ("or": for one of them)."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (not parts or True in parts):
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def texts_of(texts: set[str]) -> Plan:
    """What a line asks for that holds one of texts, as whole strings; those shorter than a gram ask for nothing."""
    return both((t if len(t) >= Q else True for t in sorted(texts)), "or")


def in_grams(plan: Plan) -> Plan:
    """A plan of strings as a plan of their grams."""
    if isinstance(plan, str):
        return both(plan[i : i + Q] for i in range(len(plan) - Q + 1))
    return plan if plan is True else both(map(in_grams, plan[1]), plan[0])


def grams_of(texts: set[str]) -> Plan:
    """What a line asks for that holds one of texts."""
    return in_grams(texts_of(texts))


def cover_of(plan: Plan, weights: Mapping[str, int] | None = None) -> list[str]:
    """Strings of which every line that the plan lets through has one, the cheapest such set; none if nothing is asked for.

    weights says how many lines have a string; without it, those of few and common characters count as frequent.
    """
    weight = (lambda g: weights.get(g, 0)) if weights is not None else (lambda g: 4.0 ** (sum(c in COMMON for c in g) - 3 * len(g)))
    if plan is True:
        return []
    if isinstance(plan, str):
        return [plan]
    kind, parts = plan
    ways = [cover_of(p, weights) for p in parts]
    if kind == "or":
        return sorted({g for w in ways for g in w}) if all(ways) else []
    return min((w for w in ways if w), key=lambda w: (sum(map(weight, w)), len(w), w), default=[])


class _Part:
    """What a part of a regex stands for: certain strings, or else what it asks for, with the strings it begins and ends with
    where those are certain."""

    def __init__(self, exact: set[str] | None = None, plan: Plan = True, head: set[str] | None = None, tail: set[str] | None = None):
        self.exact = exact if exact is None or len(exact) <= MANY else None
        self.plan = plan if self.exact is not None or exact is None else texts_of(exact)
        self.head, self.tail = head or {""}, tail or {""}

    def asked(self) -> Plan:
        return texts_of(self.exact) if self.exact is not None else self.plan


def _product(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MANY else None


def _joined(parts: list[_Part]) -> _Part:
    run: set[str] = {""}
    asked, whole, head = [], True, None
    for p in parts:
        grown = _product(run, p.exact if p.exact is not None else p.head)
        if grown is None:
            asked.append(texts_of(run))
            head = run if head is None and whole else head
            whole, run = False, p.exact if p.exact is not None else p.head
        else:
            run = grown
        if p.exact is None:
            asked += [texts_of(run), p.plan]
            head = run if head is None and whole else head
            whole, run = False, p.tail
    if whole:
        return _Part(exact=run)
    return _Part(plan=both([*asked, texts_of(run)]), head=head, tail=run)


def _read(tree) -> _Part:
    parts = []
    for op, arg in tree:
        if op is K.LITERAL:
            parts.append(_Part({chr(arg).translate(FOLD)}))
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            parts.append(_Part({chr(c).translate(FOLD) for _, c in arg}))
        elif op is K.SUBPATTERN:
            _, add, off, inner = arg
            if (add | off) & ~re.IGNORECASE:
                raise _Unclear(arg)
            parts.append(_read(inner))
        elif op is K.ATOMIC_GROUP:
            parts.append(_read(arg))
        elif op is K.BRANCH:
            ways = [_read(x) for x in arg[1]]
            exact = set().union(*(w.exact for w in ways)) if all(w.exact is not None for w in ways) else None
            parts.append(_Part(exact=exact) if exact is not None else _Part(plan=both((w.asked() for w in ways), "or")))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one = _read(inner)
            if least == most and least <= 8:
                parts += [one] * least
            elif least == 0 and most == 1 and one.exact is not None:
                parts.append(_Part(one.exact | {""}))
            elif least == 0 or one.exact and "" in one.exact:
                parts.append(_Part(plan=True))
            else:  # the first and the last time, with anything between
                parts += [one, _Part(plan=True), one] if one.exact else [one, _Part(plan=True)]
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            parts.append(_Part({""}))
        elif op in (K.IN, K.ANY, K.NOT_LITERAL, K.GROUPREF):
            parts.append(_Part(plan=True))
        else:
            raise _Unclear(op)
    return _joined(parts)


def regex_plan(pattern: str) -> Plan:
    """The grams that every line asks for in which the pattern is found."""
    return in_grams(text_plan(pattern))


def text_plan(pattern: str) -> Plan:
    """The same in strings as long as they are certain."""
    if re.search(r"\\[vQEhHRXGzbBAZ]\{|\\[vQE]|&&|\[[^\]]*\[|\\[pP]|\[\^?\]", pattern):  # read differently by the two
        return True
    try:
        tree = _parser.parse(pattern)
        if tree.state.flags & (re.VERBOSE | re.LOCALE | re.ASCII):
            return True
        return _read(tree).asked()
    except (re.error, _Unclear, OverflowError, RecursionError):
        return True


def query_plan(q: SearchQuery) -> Plan:
    return True if not q.keyword else regex_plan(q.keyword) if q.regex else grams_of({q.keyword.translate(FOLD)})


def chunk_of(chunk_lines: int) -> Column:
    return F.floor((F.col("line_no") - 1) / chunk_lines).cast("int")


def grams_in(text: Column) -> Column:
    """The distinct grams of a text, in time linear in its length (a look-ahead meets overlapping ones)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{Q}}}))"), F.lit(1)))


def chunk_gram_index(lines: DataFrame, chunk_lines: int = 15_000) -> DataFrame:
    """(archive_id, file_path, chunk, grams).

    Lines are dealt and sorted by chunk as they are, and a task walks its chunks one after another with one set of
    grams: no row for each gram is shuffled or aggregated, and what a task holds is one chunk's grams and one batch.
    """
    key = ["archive_id", "file_path", "chunk"]
    text = F.make_valid_utf8(F.translate("content", string.ascii_uppercase, string.ascii_lowercase))
    rows = lines.select("archive_id", "file_path", chunk_of(chunk_lines).alias("chunk"), text.alias("text"))
    schema = T.StructType([*rows.select(*key).schema.fields, T.StructField("grams", T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        at, grams, done, held = None, set(), [], 0
        for b in batches:
            for *place, t in zip(*(c.to_pylist() for c in b.columns)):
                if place != at:
                    if at is not None:
                        done.append((*at, sorted(grams)))
                        held += len(grams)
                        if held > 200_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], schema=types)
                            done, held = [], 0
                    at, grams = place, set()
                if t:
                    grams.update([t[i : i + Q] for i in range(len(t) - Q + 1)])
        if at is not None:
            done.append((*at, sorted(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], schema=types)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(cut, schema)


def passes(plan: Plan, has=lambda gram: F.array_contains("grams", gram)) -> Column:
    """Whether a chunk has what the plan asks for."""
    if plan is True:
        return F.lit(True)
    if isinstance(plan, str):
        return has(plan)
    out = None
    for p in plan[1]:
        x = passes(p, has)
        out = x if out is None else out & x if plan[0] == "and" else out | x
    return out


def chunks_left(index: DataFrame, q: SearchQuery) -> DataFrame:
    """(archive_id, file_path, chunk) that a search has to read; a narrow pass over the index."""
    return index.where(passes(query_plan(q))).select("archive_id", "file_path", "chunk")


def chunks_read(index: DataFrame, q: SearchQuery) -> DataFrame:
    """One row: how many chunks there are, and how many a search reads."""
    return index.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.count_if(passes(query_plan(q))), F.lit(0)).alias("read"))


def search_by_grams(lines: DataFrame, index: DataFrame, q: SearchQuery, chunk_lines: int = 15_000) -> DataFrame:
    """matching(lines, q), on the chunks that the index leaves.  Caps of the query hold for the result as a whole.

    lines with a `chunk` column, as a table partitioned by it, are pruned before they are read.
    """
    if query_plan(q) is True:
        return matching(lines, q)
    had = "chunk" in lines.columns
    out = lines if had else lines.withColumn("chunk", chunk_of(chunk_lines))
    out = matching(out.join(chunks_left(index, q), ["archive_id", "file_path", "chunk"], "left_semi"), q)
    return out if had else out.drop("chunk")
