"""Lines that none of many rules can match are left out by one automaton; events stay those of each rule alone."""

import random

from loglode.functions.default_rules import DEFAULT_RULES
from loglode.operators import diagnose as D
from loglode.schema import LINES, Rule

from .test_rule_index import rows

ODD = [Rule("bad", "bad regex", "Generic", "INFO", "Panic: ("), Rule("lit", "literal", "Generic", "INFO", "x509: CERT[", is_regex=False), Rule("off", "off", "Generic", "INFO", ".", enabled=False), Rule("oth", "other letters", "Generic", "INFO", "größe|ſick")]


def test_events_are_those_of_each_rule_alone(spark):
    r = random.Random(3)
    said = ["osd.7 Marked Down", "12 SLOW requests", "datanode x is dead", "drive 4 went offline", "XFS (a): error 5", "Full GC took 3.2 secs", "panic: (nil)", "X509: cert[1]", "GRÖßE", "größe", "ſick", "sick", "ok", "raft: a election timeout", "", "� pgs degraded"]
    texts = [" ".join(r.choice(said) for _ in range(r.randrange(3))) for _ in range(400)] + [None, "  ", "a\nsplit-brain"]
    lines = spark.createDataFrame([("x", f"{i % 3}.log", i, t) for i, t in enumerate(texts)], LINES)
    rules = [*DEFAULT_RULES, *ODD]
    assert D.FEW <= len(D.certain_strings([x for x in rules if x.enabled])) <= D.MOST
    got = D.scan_rules(lines, rules)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == sorted(e for x in rules for e in rows(D.scan_rules(lines, [x]))) and got.select("rule_id").distinct().count() > 10


def test_a_rule_certain_of_nothing_keeps_every_line(spark):
    assert D.certain_strings([*DEFAULT_RULES, Rule("any", "any", "Generic", "INFO", "[a-z]+")]) == []


def test_events_written_once_are_not_scanned_again(spark):
    lines = spark.createDataFrame([("x", "a.log", i, t) for i, t in enumerate(["osd.7 marked down", "ok", "split-brain"])], LINES)
    events, report = D.diagnose(lines, DEFAULT_RULES, once=True)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (events, report)]
    assert not any("RLIKE" in p and "marked down" in p for p in plans)
    want = D.diagnose(lines, DEFAULT_RULES)
    assert rows(events) == rows(want[0]) and rows(report.drop("severity_summary")) == rows(want[1].drop("severity_summary"))
