"""Operator 13: repair of conversation structure at the least cost, by Hirschberg's divide and conquer.

A conversation is sound when the initials of its roles read `(s?(ua)+)?`.  Four states (nothing yet, after s, after u,
after a) and the edits Keep 0, Rerole 2 (to user or assistant), Delete 3 (the only edit of blank and repeated turns) and
Insert 2 (an empty user or assistant turn) reach that; a truncated turn that stays adds 1.  Of the cheapest ways the one
whose edits' initials come first in ASCII order is taken; a state and a letter fix what comes next, so that is one way.

A step is one turn with the inserts before it.  Going forward, four costs and the order of the four least audits are
all that is remembered; going backward, four costs.  Where both meet in the middle of a run of steps, the cheapest
crossing with the least audit is taken, and each half is done alike, so space is linear and no table of all turns and
states is kept.  The same holds for blocks of turns: a block is a step with a cost and an order for each pair of
states.  Turns are sorted by range, not by conversation, so one huge conversation is many blocks in many tasks; only its
blocks' 4 x 4 tables meet in one.

Turns come by turn (null first), then role, then text.  Null roles and texts are one space; roles that begin with none of
s, u, a (empty ones too) can't be kept.  A null conv_id is one conversation, reported with a null id.  Duplicate: role and text
stood earlier in the conversation, compared by 128-bit hashes.  Rows that are equal in all columns are duplicates of each other.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, delete, written

SPACE = "".join(chr(i) for i in range(256) if SPACES[i])
NEVER = 1 << 50
STATES = range(4)  # nothing yet, after s, after u, after a
ROLE = {"u": "user", "a": "assistant"}
Step = tuple  # step[a][b]: (cost, order) from state a to state b; order compares steps that leave from the same a


def _after(state: int, initial: str) -> int | None:
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def _next(state: int) -> str:
    """The only one of user and assistant that may follow."""
    return "a" if state == 2 else "u"


@functools.cache
def turn_step(kind: int) -> Step:
    """kind: 3 * (index of the initial in 'sua', else 3) + (0 sound, 1 truncated, 2 must go); 12 is the end."""
    best = [[(NEVER, "")] * 4 for _ in STATES]
    initial, fault = "sua-"[kind // 3 % 4], kind % 3

    def offer(a: int, b: int, cost: int, letters: str) -> None:
        best[a][b] = min(best[a][b], (cost, letters))

    for a in STATES:
        at = a
        for inserts in range(3):
            cost, letters = 2 * inserts, "I" * inserts
            if kind == 12:
                if at in (0, 3):
                    offer(a, at, cost, letters)
            else:
                offer(a, at, cost + 3, letters + "D")
                if fault < 2:
                    if _after(at, initial) is not None:
                        offer(a, _after(at, initial), cost + fault, letters + "K")
                    offer(a, _after(at, _next(at)), cost + 2 + fault, letters + "R")
            at = _after(at, _next(at))
    return tuple(map(tuple, best))


def forward(steps: Sequence[Step], start: int) -> tuple[list[int], list[int]]:
    """Least costs from start to each state, and the order of the least audits that have them."""
    costs, ranks = [NEVER] * 4, [0] * 4
    costs[start] = 0
    for step in steps:
        best = [min((costs[a] + step[a][b][0], ranks[a], step[a][b][1]) for a in STATES if costs[a] < NEVER) for b in STATES]
        costs = [min(x[0], NEVER) for x in best]
        order = sorted({x[1:] for x in best if x[0] < NEVER})
        ranks = [order.index(x[1:]) if x[0] < NEVER else 0 for x in best]
    return costs, ranks


def backward(steps: Sequence[Step], end: int) -> list[int]:
    """Least costs from each state to end."""
    costs = [NEVER] * 4
    costs[end] = 0
    for step in reversed(steps):
        costs = [min(min(step[a][b][0] + costs[b] for b in STATES), NEVER) for a in STATES]
    return costs


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The states before, between and after steps on the cheapest way from start to end with the least audit."""
    if len(steps) < 2:
        return [start, end] if steps else [start]
    half = len(steps) // 2
    (costs, ranks), rest = forward(steps[:half], start), backward(steps[half:], end)
    middle = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
    return crossings(steps[:half], start, middle) + crossings(steps[half:], middle, end)[1:]


@functools.lru_cache(maxsize=20_000)
def block_step(kinds: bytes) -> Step:
    """A run of turns as one step."""
    steps = [turn_step(k) for k in kinds]
    return tuple(tuple(zip(*forward(steps, a))) for a in STATES)


@functools.lru_cache(maxsize=20_000)
def block_edits(kinds: bytes, start: int, end: int) -> tuple[tuple[int, str], ...]:
    """(state before, letters) of each turn of a run."""
    at = crossings([turn_step(k) for k in kinds], start, end)
    return tuple((a, turn_step(k)[a][b][1]) for k, a, b in zip(kinds, at, at[1:]))


@dataclass
class Repair:
    turns: DataFrame  # conv_id, part, block, place (their order), edit, role, text (after the edit; null if deleted)
    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): 0 none, 1 truncated, 2 duplicate, 3 blank; the first that holds counts."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "turns")
    keys = ["conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(13), "text", "role").alias("h2")]
    place = F.struct(F.col("turn").isNotNull(), "turn", "id")
    first = rows.select(*keys, place.alias("place")).groupBy("conv_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.id").alias("first"))
    rows = rows.select("*", *keys[1:]).join(first, F.expr("conv_id <=> c AND h1 = g1 AND h2 = g2"), "left")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", 3).when(F.col("id") != F.col("first"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


BLOCK = (
    "conv_id long, part int, block long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, kinds binary, costs array<long>, ranks array<int>, roles array<string>, texts array<string>"
)


class _Block:
    def __init__(self, conv_id):
        self.conv_id, self.size, self.numbers, self.faults, self.roles, self.texts = conv_id, 0, [], [], [], []

    def row(self, part: int, block: int) -> dict:
        initials, known = [r[:1] for r in self.roles], [t for t in self.numbers if t is not None]
        kinds = bytes(3 * ("sua".find(i) % 4 if i else 3) + min(f, 2) for i, f in zip(initials, self.faults))
        step = block_step(kinds)
        return {
            "conv_id": self.conv_id, "part": part, "block": block, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
            "blank": self.faults.count(3), "duplicate": self.faults.count(2), "truncated": self.faults.count(1),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "head": initials[0], "tail": initials[-1],
            "kinds": kinds, "costs": [step[a][b][0] for a in STATES for b in STATES], "ranks": [step[a][b][1] for a in STATES for b in STATES], "roles": self.roles, "texts": self.texts,
        }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def blocks(rows: DataFrame, most_turns: int = 256, most_bytes: int = 1 << 20) -> DataFrame:
    """Runs of turns of one conversation, in order of (part, block)."""
    schema = _schema(BLOCK)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n, out, size = TaskContext.get().partitionId(), None, 0, [], 0
        for t in batches:
            for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in t.columns)):
                if now is None or conv_id != now.conv_id or len(now.roles) >= most_turns or now.size >= most_bytes:
                    if now is not None:
                        out.append(now.row(part, n))
                        n, size = n + 1, size + now.size
                    if size >= most_bytes or len(out) >= 256:
                        yield _batch(out, schema)
                        out, size = [], 0
                    now = _Block(conv_id)
                now.size += len(text)
                for into, x in ((now.numbers, turn), (now.roles, role), (now.texts, text), (now.faults, fault)):
                    into.append(x)
        if now is not None:
            yield _batch([*out, now.row(part, n)], schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCK)


PLAN = "conv_id long, part int, block long, start int, end int, last string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _planned(rows: list[dict]) -> list[dict]:
    """Where the cheapest way crosses the edges of one conversation's blocks, and on the last block its report."""
    steps = [tuple(tuple((r["costs"][4 * a + b], r["ranks"][4 * a + b]) for b in STATES) for a in STATES) for r in rows] + [turn_step(12)]
    costs, ranks = forward(steps, 0)
    end = min((0, 3), key=lambda s: (costs[s], ranks[s]))
    at = crossings(steps, 0, end)
    out = [{"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "start": at[i], "end": at[i + 1]} for i, r in enumerate(rows)]
    known = [r for r in rows if r["low"] is not None]
    split = sum(a["high"] == b["low"] for a, b in itertools.pairwise(known))  # turns that lie in two blocks
    gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(r["turns"] for r in known) + split if known else 0
    illegal = sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    out[-1] |= sums | {"last": turn_step(12)[at[-2]][end][1], "gaps": gaps, "illegal": sums["illegal"] + illegal, "cost": costs[end]}
    return out


def plan(found: DataFrame) -> DataFrame:
    """Start and end state of each block; the last block of a conversation has its report."""
    schema = _schema(PLAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(t.to_pylist() for t in batches)
        out: list[dict] = []
        for _, mine in itertools.groupby(rows, key=lambda r: r["conv_id"]):
            out += _planned(list(mine))
            if len(out) >= 1024:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    small = found.drop("kinds", "roles", "texts")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, PLAN)


TURNS = "conv_id long, part int, block long, place int, edit string, role string, text string"


def _repaired(r: dict) -> Iterator[dict]:
    edits, place = block_edits(r["kinds"], r["start"], r["end"]), itertools.count()
    row = lambda edit, role, text: {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "place": next(place), "edit": edit, "role": role, "text": text}
    for (state, letters), role, text in zip(edits, r["roles"], r["texts"]):
        for x in letters:
            initial = _next(state)
            if x == "I":
                yield row(x, ROLE[initial], "")
            elif x == "D":
                yield row(x, None, None)
                continue
            else:
                initial = role[0] if x == "K" else initial
                yield row(x, role if x == "K" else ROLE[initial], text)
            state = _after(state, initial)
    state = r["end"]
    for x in r["last"] or "":
        yield row(x, ROLE[_next(state)], "")
        state = _after(state, _next(state))


def repair(turns: DataFrame, most_turns: int = 256) -> Repair:
    """conv_id, turn, role, text -> repaired turns and a report per conversation."""
    rows = written(marked(turns), "marked")
    found = written(blocks(rows, most_turns), "blocks")
    delete(rows)
    plans = written(plan(found), "plan")
    schema = _schema(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(0, t.num_rows, 16):
                yield _batch([x for r in t.slice(i, 16).to_pylist() for x in _repaired(r)], schema)

    texts = found.select("conv_id", "part", "block", "kinds", "roles", "texts").join(plans.select("part", "block", "start", "end", "last"), ["part", "block"])
    report = plans.where("cost IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(texts.mapInArrow(run, TURNS), report)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256); turns pass in order, one at a time."""
    kinds = "conv_id long, audit string, repaired_sha256 string"
    schema = _schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in t.columns)) for t in batches)
        out = []
        for conv_id, mine in itertools.groupby(rows, key=lambda r: r[0]):
            audit, sha, more = [], hashlib.sha256(), b""
            for _, edit, role, text in mine:
                audit.append(edit)
                if edit != "D":
                    sha.update(more + f"{role}:{text}".encode())
                    more = b"\n"
            out.append({"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    order = ["conv_id", "part", "block", "place"]
    return repaired.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "edit", "role", "text").mapInArrow(run, kinds)


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage: by crc32(conv_id:turn) % 20 a row is dropped, emptied, cut, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("c")).where("c <> 0")
    said = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", said).withColumn("role", F.when(F.col("c") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("c") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repaired_digests(turns: DataFrame, broken: DataFrame) -> DataFrame:
    """A row for each conv_id of turns, from the repair of broken."""
    fixed = repair(broken)
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    report, digest = fixed.report.withColumnRenamed("conv_id", "r"), digests(fixed.turns).withColumnRenamed("conv_id", "d")
    out = ids.join(report, F.expr("conv_id <=> r"), "left").join(digest, F.expr("conv_id <=> d"), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums], *[F.coalesce(c, F.lit(x)).alias(c) for c, x in none.items()])


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_digests(turns, damaged(turns))
