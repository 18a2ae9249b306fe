"""A table of rules gives the events of the constant scan, however many rules there are."""

import random

import pytest

from loglode.operators import rule_index as R
from loglode.operators.diagnose import scan_rules
from loglode.operators.gram_index import regex_plan
from loglode.schema import LINES, RULES, Rule

ODD = [
    Rule("a", "either", "Ceph", "FATAL", r"osd\.\d+ (marked down|failed)", suggestion="look"), Rule("b", "literal", "HDFS", "WARNING", "Missing BLOCKS", is_regex=False),
    Rule("c", "anything", "Generic", "INFO", "."), Rule("d", "short", "Generic", "INFO", "k8", is_regex=False), Rule("e", "bad regex", "Generic", "INFO", "panic: ("),
    Rule("f", "scope", "MinIO", "CRITICAL", "(?i)DRIVE", file_path_pattern="sys/*.log"), Rule("g", "off", "Generic", "FATAL", "osd", enabled=False), Rule("h", "none", "Generic", "FATAL", ""),
    Rule("a", "twice", "Ceph", "INFO", "osd.3"), Rule("i", "alternatives", "Ceph", "INFO", "drive|osd|block"), Rule("j", "other letters", "Ceph", "INFO", "größe", is_regex=False),
]
TEXTS = ["osd.3 marked down osd.3 failed", "  missing blocks: 4 ", "drive 4 offline, block lost, osd.3", "panic: (nil)", "K8 node", "", None, "   ", "ab", "GRÖßE größe 😀😀 osd", "x" * 30_000 + " drive 9"]


def table(spark, rules):
    names = [c.split()[0] for c in RULES.split(", ")]
    return spark.createDataFrame([tuple(getattr(r, n) for n in names) for r in rules], RULES)


def lines_of(spark, texts):
    return spark.createDataFrame([("x", f"{'sys' if i % 2 else 'app'}/{i % 3}.log", i, t) for i, t in enumerate(texts)], LINES)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("counted", [False, True])
def test_odd_rules_and_lines(spark, counted):
    lines = lines_of(spark, TEXTS)
    got = rows(R.scan_rule_table(lines, table(spark, ODD), counted, block=1))
    assert got == rows(scan_rules(lines, ODD)) and len(got) > 15
    assert rows(R.scan_rule_table(lines, table(spark, []), counted)) == rows(R.scan_rule_table(lines.limit(0), table(spark, ODD), counted)) == []


def test_missing_values_of_rules(spark):
    lines = lines_of(spark, TEXTS)
    bare = spark.createDataFrame([("z", None, None, None, "osd", None, None, None, None, None), ("y", None, None, None, None, None, None, None, None, None)], RULES)
    assert rows(R.scan_rule_table(lines, bare)) == rows(scan_rules(lines, [Rule("z", "", "", "", "osd")])) != []


def test_two_thousand_rules_in_a_plan_of_one_size(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    words = [word() for _ in range(60)]
    shape = [lambda a, b: f"{a} {b}", lambda a, b: f"{a}.*{b}", lambda a, b: f"(?:{a}|{b}) {a}", lambda a, b: f"{a} [0-9]+ {b}?"]
    rules = [Rule(f"r{i}", f"n{i}", "Generic", "INFO", shape[i % 4](rnd.choice(words), rnd.choice(words)), is_regex=i % 4 > 0) for i in range(2000)]
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.9 else str(rnd.randrange(9)) for _ in range(12)) for _ in range(400)]
    lines = lines_of(spark, texts)
    got = R.scan_rule_table(lines, table(spark, rules))
    want = [row for i in range(0, 2000, 200) for row in scan_rules(lines, rules[i : i + 200]).collect()]
    assert rows(got) == sorted(map(repr, want)) and len(want) > 1000
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(got) - size(R.scan_rule_table(lines, table(spark, rules[:20])))) < 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "SortMerge" not in plan


def test_covers_are_sound_and_cheap():
    assert R.cover_of(regex_plan("error|zzz fault")) != [] and len(R.cover_of(regex_plan("error|zzz fault"))) == 2
    assert R.cover_of(regex_plan("a.c")) == [] and R.cover_of(regex_plan("error|.")) == []
    assert R.cover_of(regex_plan("osd down"), {"osd": 1, "sd ": 9, "d d": 9, " do": 9, "dow": 9, "own": 9}) == ["osd"]
    assert R.needs_of(regex_plan("osd(1|2)x")) <= {"osd"} | R._all_grams(regex_plan("osd(1|2)x"))


def test_rules_meet_few_of_the_lines_that_share_their_rarest_letters(spark):
    sentence = "the thing that was heard in the entrance of the theatre then"
    words = sentence.split()
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(300)] + [sentence.upper(), "x" * 70 + sentence]
    lines = lines_of(spark, texts)
    rules = [Rule("a", "sentence", "Generic", "INFO", sentence, is_regex=False), Rule("b", "blanks", "Generic", "INFO", sentence.replace(" ", " +"))]
    keyed = R.rule_keys(table(spark, rules)).collect()
    assert [len(r["keys"]) for r in keyed] == [1, 1]
    met = R.with_keys(R._texts(lines), {n: b for n, b in R.bit_tables(R.rule_keys(table(spark, rules[:1])).selectExpr("keys[0] AS key", "sizes[0] AS size")).items()})
    assert met.count() < 30  # all 302 lines have each gram of three letters
    assert rows(R.scan_rule_table(lines, table(spark, rules))) == rows(scan_rules(lines, rules))


def test_grams_at_the_edges_of_lines_and_pieces():
    texts = ["abc", "", None, "xABCDEFGHIJKLMNOP", "ab", "cdefghijklmnop", "größe", "gr" + "ö" * 40 + "ße"]
    wanted = ["abc", "abcdefghijklmnop", "größe", "öß", "öööööööö"]
    tables = {}
    for t in wanted:
        size, grams = R.grams_of_string(t)
        bits = tables.setdefault(size, R.np.zeros(1 << R.BITS, bool))
        for k in grams:
            bits[(k % (1 << 64)) >> 64 - R.BITS] = True
    keys = {t: set(R.grams_of_string(t)[1]) for t in wanted}
    for piece in (1, 7, 1 << 18):
        got = {}
        for row, key in zip(*(x.tolist() for x in R.keys_in(R.pa.array(["zz", *texts])[1:], tables, piece))):
            got.setdefault(row, []).append(key)
        assert all(sorted(set(v)) == v for v in got.values())
        has = lambda i, t: keys[t] <= set(got.get(i, []))
        assert [has(i, t) for i, t in [(0, "abc"), (3, "abcdefghijklmnop"), (6, "größe"), (7, "öß"), (7, "öööööööö")]] == [True] * 5
        assert set(got) == {0, 3, 6, 7}
