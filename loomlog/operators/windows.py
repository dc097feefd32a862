"""The values of all panels for several windows in one pass, by one clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import quality
from loomlog.operators import signals
from loomlog.operators.quantiles import quantiles
from loomlog.sources.views import Inputs

#: Days of each window up to the end of the clock's day (None: all), and its bucket.
WINDOWS = {"7d": (7, "day"), "30d": (30, "day"), "90d": (90, "week"), "1y": (365, "week"), "all": (None, "week")}
GRADES = ("A", "B", "C", "D", "F")


def _placed(df: DataFrame, at: Column, clock: str) -> DataFrame:
    """df with (win, bucket): a row for each window that its instant lies in, so that one grouping serves all windows."""
    end = F.date_trunc("day", F.lit(clock).cast("timestamp")) + F.expr("INTERVAL 1 DAY")
    each = []
    for name, (days, unit) in WINDOWS.items():
        inside = (at < end) if days is None else (at < end) & (at >= end - F.make_dt_interval(F.lit(days)))
        each.append(F.when(inside, F.struct(F.lit(name).alias("win"), F.to_date(F.date_trunc(unit, at)).alias("bucket"))))
    return df.withColumn("_w", F.explode(F.filter(F.array(*each), lambda w: w.isNotNull()))).select("*", "_w.win", "_w.bucket").drop("_w")


def _long(panel: str, df: DataFrame, names: list[str]) -> DataFrame:
    """(panel, win, bucket, metric, value): a row for each value that is not null, rounded to nine digits."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 9).alias("value")) for n in names]))
    return df.select(F.lit(panel).alias("panel"), "win", "bucket", values.alias("_v")).select("panel", "win", "bucket", "_v.metric", "_v.value").where("value IS NOT NULL")


def _summed(panel: str, placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return _long(panel, placed.groupBy("win", "bucket").agg(*[c.alias(n) for n, c in sums.items()]), list(sums))


def _sessions(x: Inputs, clock: str) -> DataFrame:
    return _placed(signals.current(x), F.col("started_at"), clock)


def _starts(x: Inputs) -> DataFrame:
    """When every session started; merged in joins, as a broadcast would hold them all in the driver."""
    return x.sessions.select("session_id", "started_at").hint("merge")


def _quality(x: Inputs, clock: str) -> DataFrame:
    o, g = F.coalesce("sig_outcome", F.lit("unknown")), F.coalesce("sig_grade", F.lit(""))
    counts = {"sessions": F.count("*"), "wall_hours": F.sum("minutes") / 60} | {k: F.count_if(o == k) for k in ("completed", "abandoned", "errored")}
    counts |= {f"grade_{k}": F.count_if(g == k) for k in GRADES} | {k: F.count_if(F.col("archetype") == k) for k in quality.ARCHETYPES}
    return _summed("quality", _sessions(x, clock), counts)


def _hygiene(x: Inputs, clock: str) -> DataFrame:
    asked = x.sessions.where("NOT signals_stale").select("session_id", "started_at").join(signals.hygiene(x.messages).hint("merge"), "session_id")
    return _summed("hygiene", _placed(asked, F.col("started_at"), clock), {k: F.sum(k) for k in ("prompts", "short", "no_code", "duplicate")} | {"unstructured": F.count_if("unstructured")})


def _context(x: Inputs, clock: str) -> DataFrame:
    held = x.context_health.join(_starts(x), "session_id")
    return _summed("context", _placed(held, F.col("started_at"), clock), {"resets": F.sum("context_resets"), "peak": F.max("peak_context")})


def _economics(x: Inputs, clock: str) -> DataFrame:
    own = signals.current(x).select("session_id", F.coalesce("sig_outcome", F.lit("")).alias("o"), "relationship_type")
    used = x.usage_daily.where("day IS NOT NULL").join(own.hint("merge"), "session_id")
    cost = lambda test: F.sum(F.when(test, F.col("cost")).otherwise(0.0))
    asked = F.sum(F.expr("input + cache_read + cache_write"))
    sums = {"cost": F.sum("cost"), "savings": F.sum("savings"), "tokens": F.sum(F.expr("input + output + cache_read + cache_write")), "hit_rate": F.try_divide(F.sum("cache_read"), asked)}
    sums |= {"cost_completed": cost(F.col("o") == "completed"), "cost_abandoned": cost(F.col("o") == "abandoned"), "cost_subagents": cost(F.col("relationship_type") == "subagent")}
    return _summed("economics", _placed(used, F.col("day").cast("timestamp"), clock), sums)


def _velocity(x: Inputs, clock: str) -> DataFrame:
    active = _placed(x.activity_hourly, F.col("day").cast("timestamp"), clock)
    rates = {"active_hours": F.sum("active_seconds") / 3600, "messages": F.sum("messages"), "tool_calls": F.sum("tool_calls")}
    waits = quantiles(_placed(x.turns, F.col("prompt_at"), clock), "response_secs", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ("win", "bucket"))
    return _summed("velocity", active, rates).unionByName(_long("velocity", waits, ["p50", "p90", "p99"]))


def _tools(x: Inputs, clock: str) -> DataFrame:
    called = x.tool_rollup.join(_starts(x), "session_id")
    return _summed("tools", _placed(called, F.col("started_at"), clock), {"calls": F.sum("calls"), "failures": F.sum("failures")})


def _churn(x: Inputs, clock: str) -> DataFrame:
    edited = x.file_churn.join(_starts(x), "session_id")
    return _summed("churn", _placed(edited, F.col("started_at"), clock), {"edits": F.sum("edits"), "paths": F.count("*")})


PANELS = {"quality": _quality, "hygiene": _hygiene, "context": _context, "economics": _economics, "velocity": _velocity, "tools": _tools, "churn": _churn}


def window_values(x: Inputs, clock: str, panels: tuple[str, ...] = tuple(PANELS)) -> DataFrame:
    """(panel, win, bucket, metric, value) of the quality core and the panels asked for, for every window, by whole UTC days.

    Each panel reads its table once: a row is placed in all windows that hold it, at most len(WINDOWS) times and after
    its columns have been cut to what is summed, and adds up partially before the shuffle. Empty buckets have no rows.
    All panels read the versions of the tables that x holds. Unknown panels are an error; repeated ones count once.
    """
    if unknown := set(panels) - set(PANELS):
        raise ValueError(f"unknown panels {sorted(unknown)}, known are {sorted(PANELS)}")
    return reduce(DataFrame.unionByName, [PANELS[p](x, clock) for p in dict.fromkeys(("quality", *panels))])
