"""Every query against its SQL, and the shapes of plans that must hold at scale."""

import pytest

from loglode.functions.default_rules import DEFAULT_RULES
from loglode.operators import diagnose, search
from loglode.plans import registry
from loglode.plans.views import Views
from loglode.schema import SearchQuery

from .compare import connection, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_scan_is_one_narrow_pass(spark, sf_dir):
    lines = Views(spark, sf_dir).chat_lines()
    plan = plan_of(diagnose.scan_rules(lines, DEFAULT_RULES))
    assert "Join" not in plan and "Cartesian" not in plan and "Exchange" not in plan and "Python" not in plan


def test_search_filter_is_narrow_and_context_is_an_equi_join(spark, sf_dir):
    lines = Views(spark, sf_dir).chat_lines()
    hits = search.matching(lines, SearchQuery(keyword="the", path="1"))
    assert "Exchange" not in plan_of(hits)
    plan = plan_of(search.with_context(lines, hits))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_search_reads_the_lines_once(spark, sf_dir):
    lines = Views(spark, sf_dir).event_lines()
    q = SearchQuery(keyword="value=1", level="ERROR", context=1, page_size=5)
    lazy, once = search.search(lines, q), search.search(lines, q, once=True)
    rows = lambda df: sorted(map(repr, df.collect()))
    for part in ("hits", "file_summaries", "histogram", "facets", "traces"):
        assert rows(getattr(once, part)) == rows(getattr(lazy, part)) != []
        read = getattr(once, part).inputFiles()
        assert any("/hits-" in f for f in read) and (part == "hits" or not any("events" in f for f in read))
    assert "content" not in "".join(x for x in plan_of(once.traces).split("\n") if "ReadSchema" in x)
    nothing = search.search(lines, SearchQuery(keyword="no such word"), once=True)
    assert nothing.hits.count() == nothing.histogram.count() == nothing.traces.count() == 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
