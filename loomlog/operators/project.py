"""Projection: dedup, patching, per-turn and session totals, prompt facts, paths and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.functions import quality


def dedup_usage(usage: DataFrame) -> DataFrame:
    """The first row in source order of each non-empty dedup_key of a session; rows whose key is empty or null all stay.

    Rows of one source position are ordered by their content, so that reruns keep the same one. One scan, one window.
    """
    rank = F.row_number().over(W.partitionBy("session_id", "dedup_key").orderBy("source_offset", "source_index", "model", "input", "output", F.col("occurred_at").asc_nulls_first()))
    return usage.withColumn("_n", rank).where("coalesce(dedup_key, '') = '' OR _n = 1").drop("_n")


def dedup_calls(calls: DataFrame) -> DataFrame:
    """Replays collapse to the first by (ordinal, index); calls without an id never collapse into each other."""
    own = F.when(F.col("call_uid").isNull(), F.concat_ws(":", "message_ordinal", "call_index"))
    key = ["session_id", "call_uid", own, "tool_name", F.coalesce("input", F.lit("")), F.coalesce("status", F.lit(""))]
    return calls.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("message_ordinal", "call_index"))).where("_n = 1").drop("_n")


def patch_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the status of the first result of their id; one result patches every call that shares the id."""
    first = results.groupBy("session_id", "call_uid").agg(F.min_by("status", "seq").alias("result_status"))
    return calls.join(first, ["session_id", "call_uid"], "left")


def turn_usage(ledger: DataFrame) -> DataFrame:
    """Token classes and cost by (session, message); rows of no message are left out."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read", "reasoning")]
    return ledger.where("message_ordinal IS NOT NULL").groupBy("session_id", "message_ordinal").agg(*sums, F.round(F.sum("cost"), 9).alias("cost"))


def session_totals(ledger: DataFrame) -> DataFrame:
    """Absolute totals of a session, undated rows included."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read")]
    return ledger.groupBy("session_id").agg(F.count("*").alias("events"), *sums, F.round(F.sum("cost"), 9).alias("cost"), F.round(F.sum("savings"), 9).alias("savings"))


def prompt_facts(messages: DataFrame) -> DataFrame:
    """Facts of every user message that has text."""
    t = F.col("content")
    return messages.where("role = 'user' AND content <> ''").select(
        "session_id", "ordinal", quality.prompt_short(t).alias("short"), quality.prompt_no_code(t).alias("no_code"),
        quality.prompt_greeting(t).alias("greeting"), quality.prompt_digest(t).alias("digest"),
    )


def duplicate_prompts(facts: DataFrame) -> DataFrame:
    """Facts with `duplicate`: an earlier, not short, prompt of the session has the same digest."""
    seen = F.row_number().over(W.partitionBy("session_id", "digest", "short").orderBy("ordinal"))
    return facts.withColumn("duplicate", ~F.col("short") & (seen > 1))


def relative_path(path: Column, cwd: Column) -> Column:
    """C11: path below cwd, null if it is elsewhere or cwd itself; slashes go one way, a drive letter's case is ignored."""
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^([A-Za-z]):", "$1:")
    p, base = clean(path), F.regexp_replace(clean(cwd), "/+$", "")
    drive = lambda c: F.concat(F.lower(F.regexp_extract(c, "^([A-Za-z]:)", 1)), F.regexp_replace(c, "^[A-Za-z]:", ""))
    rest = F.substr(drive(p), F.length(base) + 2)
    return F.when((base != "") & F.startswith(drive(p), F.concat(drive(base), F.lit("/"))) & (rest != ""), rest)


def sanitized(text: Column) -> Column:
    """C14: text fit for any store: broken UTF-8 and NUL become U+FFFD."""
    return F.replace(F.make_valid_utf8(text), F.lit("\0"), F.lit("�"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def link_subagents(sessions: DataFrame) -> DataFrame:
    """(session_id, parent_session_id) by source ids within (user, agent); `<parent>/subagents/<x>` counts as its parent.

    The self equi-join links both arrival orders alike: whichever side comes last finds the other.
    """
    parent = F.coalesce("parent_source_id", F.when(F.col("source_session_id").contains("/subagents/"), F.substring_index("source_session_id", "/subagents/", 1)))
    kids = sessions.select("session_id", "user_id", "agent", parent.alias("p")).where("p IS NOT NULL")
    heads = sessions.select(F.col("session_id").alias("parent_session_id"), "user_id", "agent", F.col("source_session_id").alias("p"))
    return kids.join(heads, ["user_id", "agent", "p"]).where("session_id <> parent_session_id").select("session_id", "parent_session_id")


def facet_counts(sessions: DataFrame) -> DataFrame:
    """Sessions by (kind, key) for agent, machine, user and project, in one pass."""
    kinds = F.stack(F.lit(4), *[x for c in ("agent", "machine", "user_id", "project_id") for x in (F.lit(c), F.col(c).cast("string"))]).alias("kind", "key")
    return sessions.select(kinds).groupBy("kind", "key").agg(F.count("*").alias("sessions"))


def latest_announced(announced: DataFrame) -> DataFrame:
    """One row a session from repeated announcements: terminal sticks, the latest known place wins."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return announced.groupBy("session_id").agg(F.bool_or("terminal").alias("terminal"), last("cwd"), last("git_branch"), last("machine"))
