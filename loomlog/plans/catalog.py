"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.pricing import rates_sql
from loomlog.operators import analytics, sessions, transcript
from loomlog.plans import derivations, panels
from loomlog.sources import logs, raw
from loomlog.sources.views import Inputs, prefix

FAMILIES = [raw.QUERIES, logs.QUERIES, analytics.QUERIES, derivations.QUERIES, panels.QUERIES, sessions.QUERIES, transcript.QUERIES]


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which every reader spells alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf, f=f: _plain(f(Inputs(spark, sf)))) for family in FAMILIES for name, (f, _) in family.items()}


def oracle_sql() -> dict[str, str]:
    return {name: prefix(rates_sql()) + sql for family in FAMILIES for name, (_, sql) in family.items() if sql}
