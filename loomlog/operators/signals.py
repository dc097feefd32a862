"""Per-session signals: tool health, prompt hygiene, context and thinking, and the verdict over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.functions import quality
from loomlog.operators.project import duplicate_prompts, prompt_facts
from loomlog.sources.views import Inputs, as_of

IDLE_MINUTES = 30
RESET_FLOOR = 20_000
#: Bytes of a thinking trace for a token, by agent format.
BYTES_PER_TOKEN = {"format_a": 10.7, "format_b": 14.2, "format_c": 4.0}


def tool_health(tool_calls: DataFrame) -> DataFrame:
    """E2-E7 in one pass over a session's ordered, deduplicated calls."""
    w = W.partitionBy("session_id").orderBy("message_ordinal", "call_index")
    bad = F.coalesce(F.col("status") == "error", F.lit(False))
    seq = tool_calls.withColumn("pos", F.row_number().over(w)).withColumn("bad", bad)
    seq = seq.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("session_id", "bad").orderBy("message_ordinal", "call_index")))
    seq = seq.withColumn("retry", F.coalesce((F.lag("tool_name").over(w) == F.col("tool_name")) & (F.lag("input").over(w) == F.col("input")), F.lit(False)))
    path = F.when(F.col("category") == "edit", F.col("file_path"))
    runs = seq.groupBy("session_id", "bad", "island").agg(
        F.count("*").alias("n"), F.count_if("retry").alias("retries"), F.max("pos").alias("last"), F.bool_or(F.coalesce("status", F.lit("")) == "").alias("pending"),
        F.count(path).alias("edits"), F.collect_set(path).alias("paths"),
    )
    return runs.groupBy("session_id").agg(
        F.sum("n").alias("tool_calls"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("tool_failures"), F.sum("retries").alias("tool_retries"),
        (F.sum("edits") - F.size(F.array_distinct(F.flatten(F.collect_list("paths"))))).alias("edit_churn"),
        F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("streak"), F.bool_or("pending").alias("pending"),
        (F.max("last") - F.coalesce(F.max(F.when(~F.col("bad"), F.col("last"))), F.lit(0))).alias("tail_failures"),
    )


def last_words(messages: DataFrame) -> DataFrame:
    """The last ordinal with text by role, or -1."""
    last = lambda role: F.coalesce(F.max(F.when((F.col("role") == role) & (F.col("content_length") > 0), F.col("ordinal"))), F.lit(-1))
    return messages.groupBy("session_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def session_facts(x: Inputs) -> DataFrame:
    idle = F.coalesce(F.col("terminal") | (F.col("ended_at") < as_of() - F.expr(f"INTERVAL {IDLE_MINUTES} MINUTES")), F.lit(False))
    base = x.sessions.select("session_id", "user_message_count", idle.alias("idle"))
    out = base.join(tool_health(x.tool_calls), "session_id", "left").join(last_words(x.messages), "session_id", "left")
    return out.fillna(0, ["tool_calls", "tool_failures", "tool_retries", "edit_churn", "streak", "tail_failures"]).fillna(-1, ["last_user", "last_assistant"]).fillna(False, ["pending"])


def session_signals(x: Inputs) -> DataFrame:
    """E13-E15 over the facts: outcome, confidence, score and grade of every session."""
    out = session_facts(x).withColumns({"outcome": quality.outcome(0), "confidence": quality.outcome(1)})
    return out.withColumn("score", quality.score()).withColumn("grade", quality.grade(F.col("score")))


def shaped(x: Inputs) -> DataFrame:
    """Sessions with their archetype and minutes."""
    return x.sessions.withColumns({"archetype": quality.archetype(), "minutes": quality.minutes()})


def current(x: Inputs) -> DataFrame:
    """Sessions with the columns of their signal, null where it is stale.

    Signals are as many as sessions, so they are merged: by the size of its files a few columns of them look small
    enough to be broadcast, and the driver would hold a row for every session.
    """
    names = {"outcome": "sig_outcome", "grade": "sig_grade", "score": "sig_score"}
    held = shaped(x).join(x.signals.select("session_id", *names).withColumnsRenamed(names).hint("merge"), "session_id", "left")
    return held.withColumns({c: F.when(~F.col("signals_stale"), F.col(c)) for c in names.values()})


def signal_read(x: Inputs) -> DataFrame:
    return current(x).select("session_id", F.coalesce("sig_outcome", F.lit("unknown")).alias("outcome"), F.coalesce("sig_grade", F.lit("")).alias("grade"), "sig_score")


def hygiene(messages: DataFrame) -> DataFrame:
    """Prompts of a session, and how many are short, without code context or repeated; whether the opener says little."""
    facts = duplicate_prompts(prompt_facts(messages))
    return facts.groupBy("session_id").agg(
        F.count("*").alias("prompts"), F.count_if("short").alias("short"), F.count_if("no_code").alias("no_code"), F.count_if("duplicate").alias("duplicate"),
        F.min_by(F.col("short") | F.col("greeting"), "ordinal").alias("unstructured"),
    )


def context_health(ledger: DataFrame) -> DataFrame:
    """Peak context of a session and its resets: a drop to half or less from at least the floor."""
    w = W.partitionBy("session_id").orderBy(F.col("source_offset").asc_nulls_last(), "source_index", "ctx")  # ctx settles rows of one place
    seq = ledger.withColumn("ctx", F.expr("input + cache_read + cache_write")).withColumn("prev", F.lag("ctx").over(w))
    reset = (F.col("prev") >= RESET_FLOOR) & (F.col("ctx") <= 0.5 * F.col("prev"))
    return seq.groupBy("session_id").agg(F.max("ctx").alias("peak_context"), F.count_if(reset).alias("context_resets"))


def thinking(messages: DataFrame, agent: str = "format_a") -> DataFrame:
    """Assistant turns, thinking turns, and the mean of the top tenth and the peak of their tokens."""
    turns = messages.where("role = 'assistant'").withColumn("tok", F.col("thinking_bytes") / BYTES_PER_TOKEN[agent])
    thought = turns.where("thinking_bytes > 0")
    n = F.count("*").over(W.partitionBy("session_id"))
    top = thought.withColumn("k", F.greatest(F.lit(1), F.ceil(0.1 * n))).withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("tok"), "ordinal")))
    tail = top.groupBy("session_id").agg(F.count("*").alias("thinking_turns"), F.round(F.avg(F.when(F.col("r") <= F.col("k"), F.col("tok")))).cast("long").alias("tail_tokens"), F.round(F.max("tok")).cast("long").alias("peak_tokens"))
    out = turns.groupBy("session_id").agg(F.count("*").alias("assistant_turns")).join(tail, "session_id", "left").fillna(0, ["thinking_turns"])
    return out.withColumn("band", F.when(F.col("thinking_turns") == 0, "off").otherwise(quality.thinking_band(F.col("tail_tokens"))))


def score_breakdown(x: Inputs) -> DataFrame:
    """One row for each penalty that counts."""
    return x.signals.select("session_id", F.inline(quality.breakdown()))


def settle_due(x: Inputs, limit: int = 500) -> DataFrame:
    """Stale sessions that are idle or terminal, oldest first, one bounded batch."""
    idle = F.col("terminal") | (F.col("ended_at") < as_of() - F.expr(f"INTERVAL {IDLE_MINUTES} MINUTES"))
    return x.sessions.where("signals_stale").where(idle).orderBy(F.col("ended_at").asc_nulls_last(), "session_id").limit(limit).select("session_id", "ended_at")
