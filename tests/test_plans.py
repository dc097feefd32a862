"""Plans of joins on sessions: none may collect a row for every session in the driver."""

import re

import pytest

from loomlog.plans import catalog


@pytest.mark.parametrize("name", ["E17_archetype", "E19_signal_read", "I8_context_trend", "I9_context_histogram", "I16_category_mix", "I17_failure_trend", "I18_worst_tools", "I22_gallery_summary", "I24_delegation", "I25_subagent_cost", "I27_panels"])
def test_joins_on_sessions_are_not_broadcast(spark, tiny, name):
    plan = catalog.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[(?:coalesce\()?session_id\S*\]", plan)


def test_uses_of_blocks_are_dealt_to_tasks_before_they_are_permuted(spark, tiny):
    """Beside the draws, in one stage, the permutation of op8 ran in as few tasks as the draws have."""
    from loomlog.llm import mixing

    plan = mixing.op8_mix_sources(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[sid\S*, j\S*\]", plan)


def test_no_filter_permutes_uses_of_blocks_once_more(spark, tiny):
    """A test for null on the block of a use went down to the draws, where it permuted every use a second time, row by row."""
    from loomlog.llm import mixing

    plan = mixing.op8_mix_sources(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" in plan and not [line for line in plan.splitlines() if "Filter" in line and "raise_error" in line]


def test_assembled_analytics_read_the_rollup_once(spark, tiny):
    """G8 read it three times, and counted distinct sessions by shuffling a row for each session and split."""
    from loomlog.operators.analytics import CLASSES, Filter, assembled
    from loomlog.sources.views import Inputs

    x = Inputs(spark, tiny)
    plan = assembled(x)._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "FileScan parquet" in line and "cache_write" in line]) == 1
    assert not re.findall(r"Exchange hashpartitioning\((?!session_id)[^\n]*session_id", plan)
    none = assembled(x, Filter(username="nobody")).collect()
    assert {(r["part"], r["hit_rate"]) for r in none} == {("total", None), ("cache", 0.0)} and all(r[c] is None for r in none for c in (*CLASSES, "cost", "savings"))
