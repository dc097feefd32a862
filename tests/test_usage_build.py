"""The daily rollup and context health are built from one shuffle of the usage rows, and store no ledger on their way."""

import re

from loomlog.operators.rollups import usage_daily
from loomlog.operators.signals import context_health
from loomlog.sources import shared
from loomlog.sources.views import Inputs


def test_rollup_and_context_shuffle_usage_once_and_store_no_ledger(spark, tiny):
    x = Inputs(spark, tiny)
    for built in (usage_daily(x.priced_usage), context_health(x.own_usage)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "SortAggregate" not in plan
    held, names = dict(shared._STORED), lambda: {k[-1] for k in shared._STORED}
    shared._STORED.clear()
    try:
        assert Inputs(spark, tiny).usage_daily.count() and "usage_daily" in names() and "ledger" not in names()
    finally:
        shared._STORED.update(held)
