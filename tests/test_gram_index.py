"""Plans of q-grams: sound for every regex tried, useful for the usual ones; pruned searches equal unpruned ones."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglode.operators import gram_index as G
from loglode.operators import search
from loglode.schema import SearchQuery

from .test_operators import lines_of


def holds(plan, text):
    if plan is True:
        return True
    if isinstance(plan, str):
        return plan in text.translate(G.FOLD)
    return (all if plan[0] == "and" else any)(holds(p, text) for p in plan[1])


@pytest.mark.parametrize(
    "pattern, plan",
    [
        ("reset", ("and", ("res", "ese", "set"))), ("a.b", True), ("abc|abd", ("or", ("abc", "abd"))), ("foo|ba", True), ("(?:con|dis)nect", ("or", (("and", ("con", "onn", "nne", "nec", "ect")), ("and", ("dis", "isn", "sne", "nec", "ect"))))),
        ("ABC.*xyz", ("and", ("abc", "xyz"))), ("ab?cd", ("or", (("and", ("abc", "bcd")), "acd"))), ("abc*", True), ("[xy]ab", ("or", ("xab", "yab"))), (r"\bdisk\b", ("and", ("dis", "isk"))),
        ("(abc", True), (r"\Qa.b\E", True), ("[a-z&&[^b]]abc", True), (r"x\vabc", True), ("(?x)a b c", True), (r"(?=abc)d", True), ("", True), ("(?i)Disk", ("and", ("dis", "isk"))), ("a{3}", "aaa"), (r"(\w+)abc\1", "abc"),
    ],
)
def test_plans(pattern, plan):
    assert G.regex_plan(pattern) == plan


def test_repeats_ask_for_what_stands_beside_them():
    plan = G.regex_plan("ab(?:cd)+ef")
    assert holds(plan, "abcdcdef") and not holds(plan, "abcd") and not holds(plan, "cdef") and not holds(plan, "ab ef")


PIECES = st.recursive(
    st.sampled_from(["a", "b", "C", "ab", ".", r"\d", "[ab]", "[^a]", r"\b", "^", "$", "x-y", r"\."]),
    lambda x: st.one_of(
        st.lists(x, min_size=1, max_size=4).map("".join), st.lists(x, min_size=2, max_size=3).map(lambda p: "(?:" + "|".join(p) + ")"),
        st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "{0,2}", "+?", "{2,}"])).map(lambda p: f"(?:{p[0]}){p[1]}"), x.map(lambda p: f"({p})"), x.map(lambda p: f"(?={p})"),
    ),
    max_leaves=8,
)


@settings(max_examples=1500, deadline=None)
@given(PIECES, st.randoms(use_true_random=False))
def test_plans_ask_for_no_more_than_the_regex(pattern, r):
    try:
        test = re.compile("(?i)" + pattern)
    except re.error:
        return
    plan = G.regex_plan(pattern)
    for _ in range(40):
        text = "".join(r.choice("abcCABxy-.1 ") for _ in range(r.randrange(12)))
        if test.search(text):
            assert holds(plan, text)


def test_pruned_search_equals_the_plain_one(spark):
    r = random.Random(2)
    words = ["conn_reset", "Timeout", "ok", "disk-7", "É", "trace"]
    text = "\n".join(f"f{i % 3}.log|{' '.join(r.choice(words) for _ in range(3))}" for i in range(300)) + "\nf1.log|conn_RESETS once\nf2.log|\nf2.log|ab"
    lines = lines_of(spark, text)
    index = G.chunk_gram_index(lines, 10).persist()
    total = index.count()
    asked = [SearchQuery(keyword="resets"), SearchQuery(keyword="reset", whole_word=True), SearchQuery(keyword="(resets|nothing) on", regex=True), SearchQuery(keyword="RESETS", case_sensitive=True), SearchQuery(keyword="a.", regex=True), SearchQuery(), SearchQuery(keyword="É"), SearchQuery(keyword="É timeout É"), SearchQuery(keyword="zzz")]
    for q in asked:
        key = lambda d: sorted(tuple(x) for x in d.select("file_path", "line_no", "content").collect())
        assert key(G.search_by_grams(lines, index, q, 10)) == key(search.matching(lines, q))
    assert G.chunks_read(index, asked[0]).first()[:] == (total, 1)
    assert G.chunks_read(index, asked[4]).first()[:] == (total, total)
    assert G.chunks_read(index.where("false"), asked[0]).first()[:] == (0, 0)
    index.unpersist()


def test_index_is_brute_force_without_a_row_for_each_gram(spark):
    texts = ["Disk 7 FAILED", None, "", "ab", "É😀😀x", "disk 7 failed", "a\rbc"] * 9
    rows = [("x", f"f{i % 2}.log", i // 2 + 1, t) for i, t in enumerate(texts)] + [("y", "only-null.log", 1, None)]
    index = G.chunk_gram_index(spark.createDataFrame(rows, "archive_id string, file_path string, line_no long, content string"), 10)
    want = {}
    for a, f, n, t in rows:
        low = (t or "").translate(G.FOLD)
        want.setdefault((a, f, (n - 1) // 10), set()).update(low[i : i + 3] for i in range(len(low) - 2))
    assert {tuple(r)[:3]: r.grams for r in index.collect()} == {k: sorted(g) for k, g in want.items()}
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # as rows, the grams of 6 GB were more than a task's memory
