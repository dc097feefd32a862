"""Insights: distributions over the session cohort, and trends on a bucket grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.functions import quality
from loomlog.operators import signals
from loomlog.operators.quantiles import quantiles
from loomlog.operators.trees import depths
from loomlog.sources.views import Inputs, as_of

MAX_BUCKETS = 120
RANGES = {"7d": (7, "day"), "30d": (30, "day"), "90d": (90, "week"), "year": (365, "week"), "all": (None, "week")}


def rate(a: Column, b: Column, digits: int = 9) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def _filled(df: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Counts for every canonical key, zero where none."""
    spine = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, place int")
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "key", "left").select("key", "place", F.coalesce("n", F.lit(0)).alias("n"))


def grade_distribution(x: Inputs) -> DataFrame:
    """H1: sessions by grade, missing and stale signals as ''."""
    return _filled(signals.current(x).select(F.coalesce("sig_grade", F.lit("")).alias("g")), "g", ["A", "B", "C", "D", "F", ""])


def outcome_distribution(x: Inputs) -> DataFrame:
    return _filled(signals.current(x).select(F.coalesce("sig_outcome", F.lit("unknown")).alias("o")), "o", quality.OUTCOMES)


def archetype_distribution(x: Inputs) -> DataFrame:
    """H2."""
    return _filled(x.sessions.select(quality.archetype().alias("a")), "a", quality.ARCHETYPES)


def running(spans: DataFrame, by: list[str]) -> DataFrame:
    """Open spans at each instant, with all that start there counted before any that end.

    Deltas are summed by instant first. The prefix sum has two levels, by hour and within an hour, so that no task holds
    more than one hour of instants or one row an hour, also where there is no key to partition by.
    """
    starts = spans.select(*by, F.col("started_at").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = spans.select(*by, F.col("ended_at").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    at = starts.unionAll(ends).groupBy(*by, "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("day", F.date_trunc("hour", "t"))
    days = at.groupBy(*by, "day").agg(F.sum(F.expr("up - down")).alias("net"))
    base = days.select(*by, "day", (F.sum("net").over(W.partitionBy(*by).orderBy("day")) - F.col("net")).alias("base"))
    inner = W.partitionBy(*by, "day").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    return at.join(base, [*by, "day"]).withColumn("open", F.col("base") + F.sum(F.expr("up - down")).over(inner) + F.col("down"))


def concurrency(x: Inputs) -> DataFrame:
    """H3-H5: fleet peak and its earliest instant, the busiest user's peak, and the mean number of open sessions."""
    spans = x.sessions.where("ended_at > started_at")
    peak = running(spans, []).agg(F.max(F.struct("open", (-F.unix_micros("t")).alias("t"))).alias("p")).select(F.col("p.open").alias("fleet_peak"), F.timestamp_micros(-F.col("p.t")).alias("fleet_peak_at"))
    users = running(spans, ["user_id"]).groupBy("user_id").agg(F.max("open").alias("open")).join(x.users, "user_id")
    busiest = users.orderBy(F.desc("open"), "username").limit(1).select(F.col("username").alias("busiest_user"), F.col("open").alias("busiest_user_peak"))
    secs = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    avg = spans.agg(F.sum(secs("started_at", "ended_at")).alias("total"), F.min("started_at").alias("lo"), F.max("ended_at").alias("hi"), F.count("*").alias("sessions"))
    avg = avg.select(F.when(F.col("hi") > F.col("lo"), F.round(F.col("total") / secs("lo", "hi"), 9)).otherwise(F.col("sessions").cast("double")).alias("avg_concurrent"), "sessions")
    return _one_row(avg, peak, busiest)


def _one_row(*dfs: DataFrame) -> DataFrame:
    """Frames of at most one row each, side by side."""
    one = [df.withColumn("_1", F.lit(1)) for df in dfs]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_1", "left"), one).drop("_1")


def velocity(x: Inputs) -> DataFrame:
    """H6: exact latency percentiles, opening replies apart, and rates by active minute."""
    millis = lambda df: df.select(*[F.round(F.col(c) * 1000).cast("long").alias(c) for c in df.columns])
    every = millis(quantiles(x.turns, "response_secs", {"response_p50": 0.5, "response_p90": 0.9}))
    first = millis(quantiles(x.turns.where("turn = 1"), "response_secs", {"first_response_p50": 0.5}))
    n = x.turns.groupBy("session_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("turns"), F.count("*").alias("sessions"))
    a = x.activity_hourly.agg(F.sum("active_seconds").alias("active_seconds"), F.sum("messages").alias("m"), F.sum("tool_calls").alias("c"))
    a = a.select("active_seconds", rate(F.col("m") * 60, F.col("active_seconds")).alias("msgs_per_min"), rate(F.col("c") * 60, F.col("active_seconds")).alias("tools_per_min"))
    return _one_row(n, every, first, a)


def top_tools(x: Inputs, n: int = 10) -> DataFrame:
    """H7: the most called tools; share and totals are of all calls, listed or not, and `clipped` tells whether some are not listed."""
    by = x.tool_rollup.groupBy("tool_name").agg(F.sum("calls").alias("calls"), F.sum("failures").alias("failures"))
    every = by.agg(F.sum("calls").alias("total_calls"), F.sum("failures").alias("total_failures"), (F.count("*") > n).alias("clipped"))  # one row
    top = by.orderBy(F.desc("calls"), "tool_name").limit(n).withColumn("_1", F.lit(1))
    return top.join(F.broadcast(every.withColumn("_1", F.lit(1))), "_1").drop("_1").withColumn("share", rate(F.col("calls"), F.col("total_calls")))


def prompt_hygiene(x: Inputs) -> DataFrame:
    """H8: sums over sessions with a current signal."""
    fresh = x.sessions.where("NOT signals_stale").select("session_id")
    return signals.hygiene(x.messages).join(fresh, "session_id").agg(*[F.sum(c).alias(c) for c in ("prompts", "short", "no_code", "duplicate")], F.count("*").alias("sessions"), F.count_if("unstructured").alias("unstructured"))


def hot_files(x: Inputs, n: int | None = 10) -> DataFrame:
    """H9: paths edited more than once in a project, the most edited first, with its name and whether some are not listed."""
    c = x.file_churn.join(x.sessions.select("session_id", "project_id").hint("merge"), "session_id")
    by = c.groupBy("project_id", F.col("churn_path").alias("path")).agg(F.sum("edits").alias("edits"), F.countDistinct("session_id").alias("sessions")).where("edits > 1")
    if n is None:
        return by
    many = by.agg((F.count("*") > n).alias("clipped")).withColumn("_1", F.lit(1))  # one row
    top = by.orderBy(F.desc("edits"), "project_id", "path").limit(n).withColumn("_1", F.lit(1)).join(F.broadcast(many), "_1").drop("_1")
    return top.join(x.projects.select("project_id", F.col("display_name").alias("project")), "project_id")


def context_distribution(x: Inputs) -> DataFrame:
    """Discrete percentiles of peak context, and resets."""
    c = x.context_health
    ranks = quantiles(c, "peak_context", {"p50": 0.5, "p90": 0.9}, discrete=True)
    return _one_row(c.agg(F.count("*").alias("sessions"), F.max("peak_context").alias("max"), F.sum("context_resets").alias("resets"), F.count_if(F.col("context_resets") > 0).alias("sessions_with_reset")), ranks)


# Trends ------------------------------------------------------------------------------------------------------------


def grid(x: Inputs, span: str = "all") -> DataFrame:
    """Bucket starts up to now, the last 120 at most, with a label; 'all' starts with the earliest session."""
    days, unit = RANGES[span]
    lo = as_of() - F.make_dt_interval(F.lit(days)) if days else None
    if lo is None:
        first = x.sessions.agg(F.min("started_at").alias("lo"))
        base = first.select(F.coalesce("lo", as_of() - F.make_dt_interval(F.lit(7))).alias("lo"))
    else:
        base = x.spark.range(1).select(lo.alias("lo"))
    step = F.expr("INTERVAL 7 DAYS" if unit == "week" else "INTERVAL 1 DAY")
    all_ = base.select(F.sequence(F.date_trunc(unit, F.least("lo", as_of())), F.date_trunc(unit, as_of()), step).alias("b"))
    last = all_.select(F.explode(F.slice("b", F.greatest(F.lit(1), F.size("b") - (MAX_BUCKETS - 1)), F.lit(MAX_BUCKETS))).alias("bucket"))
    return last.select(F.to_date("bucket").alias("bucket"), F.date_format("bucket", "MMM d").alias("label"))


def _week(c: str) -> Column:
    return F.to_date(F.date_trunc("week", F.col(c)))


def _started(x: Inputs, sessions: DataFrame) -> DataFrame:
    """The sessions that started on the grid, with their bucket."""
    g = grid(x).agg(F.min("bucket").alias("lo"))
    df = sessions.where(F.col("started_at") < as_of()).withColumn("bucket", _week("started_at"))
    return df.join(F.broadcast(g), F.col("bucket") >= F.col("lo")).drop("lo")


def cohort(x: Inputs) -> DataFrame:
    """Sessions that started on the grid, with bucket and shape."""
    return _started(x, signals.shaped(x))


def judged(x: Inputs) -> DataFrame:
    """The cohort with current signals."""
    return _started(x, signals.current(x))


def _placed(x: Inputs, rows: DataFrame, *columns: str) -> DataFrame:
    """rows(session_id, ...) of the cohort's sessions, with these columns of theirs; merged, as both sides grow with the sessions."""
    return rows.join(cohort(x).select("session_id", *columns).hint("merge"), "session_id")


def _on_grid(x: Inputs, df: DataFrame, zero: list[str]) -> DataFrame:
    """df for every bucket of the grid, 0 where it has none."""
    return grid(x).select("bucket").join(df, "bucket", "left").fillna(0, zero)


def dated_usage(x: Inputs) -> DataFrame:
    """Rows of the daily rollup on the grid, with their bucket."""
    g = grid(x).agg(F.min("bucket").alias("lo"))
    df = x.usage_daily.where(F.col("day") < as_of()).withColumn("bucket", _week("day"))
    return df.join(F.broadcast(g), F.col("bucket") >= F.col("lo")).drop("lo")


def _folded(df: DataFrame, key: str, value: str, n: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, key, share): the n keys of most value, the rest as 'other', each as a share of its bucket."""
    total = df.where(~F.col(key).isin(*skip)) if skip else df
    rank = total.groupBy(key).agg(F.sum(value).alias("v")).withColumn("r", F.row_number().over(W.orderBy(F.desc("v"), key))).where(F.col("r") <= n).select(F.col(key).alias("_k"))
    out = df.join(F.broadcast(rank), F.col(key) == F.col("_k"), "left").groupBy("bucket", F.coalesce("_k", F.lit("other")).alias("key")).agg(F.sum(value).alias("v"))
    return out.select("bucket", "key", rate(F.col("v"), F.sum("v").over(W.partitionBy("bucket"))).alias("share"))


def _mix(x: Inputs) -> DataFrame:
    toks = F.expr("input + output + cache_read + cache_write")
    name = F.when(F.col("model") == "", "unknown").otherwise(F.col("model"))
    return dated_usage(x).groupBy("bucket", name.alias("model")).agg(F.sum(toks).alias("toks")).where("toks > 0")


def fleet_mix(x: Inputs) -> DataFrame:
    """Token share by (bucket, model), six models and the rest."""
    return _folded(_mix(x), "model", "toks", 6)


def newest_model(x: Inputs) -> DataFrame:
    """The model whose first day in the whole history is latest, if that falls after the grid's first bucket."""
    first = x.usage_daily.where("day IS NOT NULL AND model <> ''").groupBy("model").agg(F.min("day").alias("first"), F.sum(F.expr("input + output + cache_read + cache_write")).alias("toks"))
    lo = grid(x).agg(F.min("bucket").alias("lo"))
    later = first.where(F.col("first").cast("timestamp") < as_of()).join(F.broadcast(lo), F.col("first") >= F.date_add("lo", 7))
    return later.orderBy(F.desc("first"), F.desc("toks"), "model").limit(1).select("model", "first")


def grade_trend(x: Inputs) -> DataFrame:
    """I4: share of every grade and the mean points of the graded, by bucket."""
    g = F.coalesce("sig_grade", F.lit(""))
    names = {"A": "a", "B": "b", "C": "c", "D": "d", "F": "f", "": "unscored"}
    df = judged(x).groupBy("bucket").agg(*[rate(100 * F.count_if(g == k), F.count("*")).alias(n) for k, n in names.items()], F.round(F.avg(quality.grade_points(F.nullif(g, F.lit("")))), 9).alias("gpa"))
    return _on_grid(x, df, list(names.values()))


def outcome_trend(x: Inputs) -> DataFrame:
    """I5."""
    o = F.coalesce("sig_outcome", F.lit("unknown"))
    df = judged(x).groupBy("bucket").agg(F.count_if(o == "completed").alias("completed"), F.count_if(o == "abandoned").alias("abandoned"), F.count("*").alias("total"))
    df = df.withColumns({"completed_rate": rate(100 * F.col("completed"), F.col("total")), "abandoned_rate": rate(100 * F.col("abandoned"), F.col("total"))})
    return _on_grid(x, df, [c for c in df.columns if c != "bucket"])


def archetype_trend(x: Inputs) -> DataFrame:
    """I6."""
    df = cohort(x).groupBy("bucket").agg(*[rate(100 * F.count_if(F.col("archetype") == a), F.count("*")).alias(a) for a in quality.ARCHETYPES])
    return _on_grid(x, df, quality.ARCHETYPES)


def hygiene_trend(x: Inputs) -> DataFrame:
    """Rates by prompt; unstructured starts by session with a signal."""
    c = cohort(x).where("NOT signals_stale").select("session_id", "bucket").join(signals.hygiene(x.messages), "session_id", "left")
    df = c.groupBy("bucket").agg(*[rate(100 * F.sum(k), F.sum("prompts")).alias(k) for k in ("short", "no_code", "duplicate")], rate(100 * F.count_if("unstructured"), F.count("*")).alias("unstructured"))
    return _on_grid(x, df, ["short", "no_code", "duplicate", "unstructured"])


def context_trend(x: Inputs) -> DataFrame:
    """I8."""
    df = _placed(x, x.context_health, "bucket").groupBy("bucket").agg(F.sum("context_resets").alias("resets"))
    return _on_grid(x, df, ["resets"])


def context_histogram(x: Inputs) -> DataFrame:
    """Peak context by octave from 8k to 1.024M tokens, both tails folded in."""
    c = _placed(x, x.context_health)
    octave = F.least(F.lit(6), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("peak_context"), F.lit(1)) / 8000)))).cast("int")
    got = c.groupBy(octave.alias("i")).agg(F.count("*").alias("n"))
    spine = x.spark.range(7).select(F.col("id").cast("int").alias("i"), F.expr("8000 * shiftleft(1L, CAST(id AS INT))").alias("lo"))
    return spine.join(F.broadcast(got), "i", "left").select("lo", (F.col("lo") * 2).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def economics(x: Inputs) -> DataFrame:
    """Cost by outcome of its session, and the cache hit rate with a flag whether there was anything to measure."""
    sig = signals.current(x).select("session_id", F.coalesce("sig_outcome", F.lit("")).alias("o"))
    df = dated_usage(x).join(sig.hint("merge"), "session_id").groupBy("bucket").agg(
        *[F.round(F.sum(F.when(F.col("o") == o, F.col("cost")).otherwise(0.0)), 9).alias(f"cost_{o}") for o in ("completed", "abandoned")], F.round(F.sum("cost"), 9).alias("cost"),
        rate(F.sum("cache_read"), F.sum(F.expr("input + cache_read + cache_write"))).alias("hit_rate"), (F.sum(F.expr("input + cache_read + cache_write")) > 0).alias("measured"),
    )
    return _on_grid(x, df, ["cost_completed", "cost_abandoned", "cost", "hit_rate"]).fillna(False, ["measured"])


def savings_trend(x: Inputs) -> DataFrame:
    """As priced by row, by bucket."""
    return _on_grid(x, dated_usage(x).groupBy("bucket").agg(F.round(F.sum("savings"), 9).alias("savings")), ["savings"])


def latency_trend(x: Inputs) -> DataFrame:
    """Exact percentiles by the prompt's bucket."""
    t = x.turns.withColumn("bucket", _week("prompt_at"))
    df = quantiles(t, "response_secs", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ("bucket",))
    return _on_grid(x, df.select("bucket", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")]), ["p50", "p90", "p99"])


def active_trend(x: Inputs) -> DataFrame:
    """I13."""
    h = x.activity_hourly.withColumn("bucket", _week("day"))
    df = h.groupBy("bucket").agg(F.round(F.sum("active_seconds") / 3600, 9).alias("active_hours"), rate(60 * F.sum("messages"), F.sum("active_seconds")).alias("msgs_per_min"), rate(60 * F.sum("tool_calls"), F.sum("active_seconds")).alias("tools_per_min"))
    return _on_grid(x, df, ["active_hours", "msgs_per_min", "tools_per_min"])


def wall_trend(x: Inputs) -> DataFrame:
    """I14."""
    return _on_grid(x, cohort(x).groupBy("bucket").agg(F.round(F.sum("minutes") / 60, 9).alias("wall_hours")), ["wall_hours"])


def _tools(x: Inputs) -> DataFrame:
    return _placed(x, x.tool_rollup, "bucket")


def tool_scatter(x: Inputs, n: int = 60) -> DataFrame:
    """Reliability of the most called tools."""
    by = _tools(x).groupBy("tool_name").agg(F.min("category").alias("category"), F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.countDistinct("session_id").alias("sessions"))
    return by.orderBy(F.desc("calls"), "tool_name").limit(n)


def category_mix(x: Inputs) -> DataFrame:
    """I16."""
    return _folded(_tools(x), "category", "calls", 6, skip=("other",))


def failure_trend(x: Inputs) -> DataFrame:
    """I17."""
    df = _tools(x).groupBy("bucket").agg(F.sum("calls").alias("calls"), rate(100 * F.sum("failures"), F.sum("calls")).alias("failure_rate"))
    return _on_grid(x, df, ["calls", "failure_rate"])


def worst_tools(x: Inputs, n: int = 3, least_calls: int = 50) -> DataFrame:
    """Failure rate by bucket of the tools of most failures among the scatter's, ties by name."""
    worst = tool_scatter(x).where((F.col("calls") >= least_calls) & (F.col("failures") > 0)).orderBy(F.desc("failures"), "tool_name").limit(n).select("tool_name")
    return _tools(x).join(F.broadcast(worst), "tool_name", "left_semi").groupBy("tool_name", "bucket").agg(rate(100 * F.sum("failures"), F.sum("calls")).alias("failure_rate"))


def churn_trend(x: Inputs) -> DataFrame:
    """Edits and files by bucket, of files edited more than once in the window."""
    c = _placed(x, x.file_churn, "bucket", "project_id")
    by = c.groupBy("bucket", "project_id", "churn_path").agg(F.sum("edits").alias("edits")).withColumn("all", F.sum("edits").over(W.partitionBy("project_id", "churn_path"))).where("all > 1")
    return _on_grid(x, by.groupBy("bucket").agg(F.sum("edits").alias("edits"), F.count("*").alias("files")), ["edits", "files"])


def churn_tree(x: Inputs, n: int = 150) -> DataFrame:
    """Hot files under their project and folder; the totals count what the limit leaves out."""
    hot = hot_files(x, None).withColumns({"all_edits": F.sum("edits").over(W.partitionBy()), "all_files": F.count("*").over(W.partitionBy())})
    top = hot.orderBy(F.desc("edits"), "project_id", "path").limit(n).join(x.projects, "project_id")
    label = F.when(F.col("kind") == "remote", F.col("display_name")).otherwise(F.concat("display_name", F.lit(" ("), "kind", F.lit(")")))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return top.select(label.alias("project"), F.when(folder == "", "(root)").otherwise(folder).alias("folder"), "path", "edits", "sessions", "all_edits", "all_files")


def gallery(x: Inputs) -> DataFrame:
    """Every session with a span."""
    cost = x.usage_daily.groupBy("session_id").agg(F.sum("cost").alias("cost"))
    df = judged(x).where("ended_at >= started_at").join(cost.hint("merge"), "session_id", "left")
    return df.select("session_id", F.round(F.col("minutes") * 60, 3).alias("duration_s"), F.round(F.coalesce("cost", F.lit(0.0)), 9).alias("cost"), "archetype", F.coalesce("sig_grade", F.lit("")).alias("grade"), F.coalesce("sig_outcome", F.lit("unknown")).alias("outcome"))


def gallery_summary(x: Inputs) -> DataFrame:
    """Medians, and the priciest session with its duration."""
    g = gallery(x)
    med = lambda df, c, name: quantiles(df, c, {name: 0.5}).select(F.round(name, 6).alias(name))
    top = g.agg(F.count("*").alias("sessions"), F.max(F.struct("cost", "duration_s")).alias("p")).select("sessions", F.col("p.cost").alias("priciest"), F.col("p.duration_s").alias("priciest_duration"))
    return _one_row(top, med(g, "duration_s", "median_duration"), med(g, "cost", "median_cost"), med(g.where("outcome = 'completed'"), "duration_s", "median_completed"))


def rhythm(x: Inputs) -> DataFrame:
    """Messages and tool calls by weekday (Monday 0) and hour, all 168 cells."""
    h = x.activity_hourly.groupBy(F.weekday("day").alias("weekday"), "hour").agg(F.sum(F.expr("messages + tool_calls")).alias("n"))
    spine = x.spark.range(168).select(F.expr("CAST(id DIV 24 AS INT)").alias("weekday"), F.expr("CAST(id % 24 AS INT)").alias("hour"))
    return spine.join(F.broadcast(h), ["weekday", "hour"], "left").fillna(0, ["n"])


def delegation(x: Inputs) -> DataFrame:
    """Share of root sessions with subagents by bucket, and how many have 1, 2-3, 4-7, 8 or more."""
    kids = x.sessions.where("relationship_type = 'subagent'").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count("*").alias("kids"))
    roots = cohort(x).where("relationship_type = ''").select("session_id", "bucket").join(kids.hint("merge"), "session_id", "left").fillna(0, ["kids"])
    k = F.col("kids")
    df = roots.groupBy("bucket").agg(rate(100 * F.count_if(k > 0), F.count("*")).alias("share"), F.count_if(k == 1).alias("one"), F.count_if((k >= 2) & (k <= 3)).alias("few"), F.count_if((k >= 4) & (k <= 7)).alias("several"), F.count_if(k >= 8).alias("many"))
    return _on_grid(x, df, ["share", "one", "few", "several", "many"])


def subagent_cost(x: Inputs) -> DataFrame:
    """I25."""
    df = dated_usage(x).join(x.sessions.select("session_id", "relationship_type").hint("merge"), "session_id").groupBy("bucket").agg(rate(100 * F.sum(F.when(F.col("relationship_type") == "subagent", F.col("cost")).otherwise(0.0)), F.sum("cost"), 6).alias("share"))
    return _on_grid(x, df, ["share"])


def deepest_tree(x: Inputs) -> DataFrame:
    """Sessions by depth over all edge types, roots at 1."""
    return depths(x.sessions.select(F.col("session_id").alias("node"), F.col("parent_session_id").alias("up"))).groupBy("depth").agg(F.count("*").alias("sessions"))


PANELS = {
    "quality": (grade_trend, outcome_trend, archetype_trend), "mix": (fleet_mix,), "hygiene": (hygiene_trend,), "context": (context_trend,), "economics": (economics, savings_trend),
    "velocity": (latency_trend, active_trend, wall_trend), "tools": (tool_scatter, category_mix, failure_trend), "churn": (churn_trend, churn_tree), "delegation": (delegation, subagent_cost),
}


def insights(x: Inputs, panels: tuple[str, ...] = tuple(PANELS)) -> dict[str, DataFrame]:
    """The quality core and the panels asked for, lazily, all over the same snapshot and clock."""
    if unknown := set(panels) - set(PANELS):
        raise ValueError(f"unknown panels {sorted(unknown)}, known are {sorted(PANELS)}")
    return {f.__name__: f(x) for name in dict.fromkeys(("quality", *panels)) for f in PANELS[name]}
