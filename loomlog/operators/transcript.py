"""Transcript reads: windows of messages, their extras, and bounded pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.operators.project import content_hash, turn_usage
from loomlog.operators.sessions import titles
from loomlog.operators.signals import current
from loomlog.sources.views import Inputs

USER_TAIL, CAP, OUTLINE = 50, 600, 512
#: Fixed values of the byte budget: overhead of a message and bytes a byte may take when escaped.
OVERHEAD, ESCAPED = 1024, 6


def messages_with_usage(x: Inputs) -> DataFrame:
    """K1: messages with their turn's tokens; context counts input and both cache classes."""
    u = turn_usage(x.ledger).select("session_id", F.col("message_ordinal").alias("ordinal"), "input", "output", F.expr("input + cache_read + cache_write").alias("context"))
    return x.messages.join(u, ["session_id", "ordinal"], "left").select("session_id", "ordinal", "role", "content_length", "input", "output", "context")


def tail_window(messages: DataFrame, users: int = USER_TAIL, cap: int = CAP) -> DataFrame:
    """K2: of each session the messages from the users-th last user message on, the last `cap` at most, and how many come before."""
    back = W.partitionBy("session_id").orderBy(F.desc("ordinal"))
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(back.rowsBetween(W.unboundedPreceding, -1))
    df = messages.withColumn("later_users", F.coalesce(n, F.lit(0))).withColumn("r", F.row_number().over(back)).withColumn("all", F.count("*").over(W.partitionBy("session_id")))
    kept = df.where((F.col("later_users") < users) & (F.col("r") <= cap))
    return kept.withColumn("earlier", F.col("all") - F.count("*").over(W.partitionBy("session_id"))).select("session_id", "ordinal", "role", "earlier")


def after_window(messages: DataFrame, session_id: int, cursor: int, cap: int = CAP) -> DataFrame:
    """K3: what follows a cursor, one row beyond the cap if more is there."""
    return messages.where((F.col("session_id") == session_id) & (F.col("ordinal") > cursor)).orderBy("ordinal").limit(cap + 1).select("session_id", "ordinal", "role")


def after_windows(messages: DataFrame, cursors: DataFrame, cap: int = CAP) -> DataFrame:
    """K3 for many readers: what follows the cursor of each row of cursors(session_id, cursor), one row beyond the cap if more is there.

    `more` tells that rows are left beyond the cap; readers of one session are told apart by their cursor.
    """
    follow = messages.join(cursors.distinct(), "session_id").where("ordinal > cursor")
    w = W.partitionBy("session_id", "cursor").orderBy("ordinal")
    ranked = follow.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap + 1)
    return ranked.select("session_id", "cursor", "ordinal", "role", (F.max("r").over(W.partitionBy("session_id", "cursor")) > cap).alias("more"))


def page(x: Inputs, session_id: int, budget: int) -> DataFrame:
    """K6 of one session, from the stored transcript: its files and row groups are sorted by session, so few are read."""
    return budget_page(x.transcript.where(F.col("session_id") == session_id), budget)


def _pages_of_longest(x: Inputs) -> DataFrame:
    """The first page of the session that has most messages, the smallest of equals."""
    at = x.transcript.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max_by("session_id", F.struct("n", -F.col("session_id")))).first()[0]
    return page(x, at, 16_000) if at is not None else page(x, -1, 16_000)


def extras(x: Inputs, lo: int, hi: int) -> DataFrame:
    """K4: tool calls of the messages from lo to hi."""
    return x.calls.where(F.col("message_ordinal").between(lo, hi)).select("session_id", "message_ordinal", "call_index", "tool_name", "status")


def outline(messages: DataFrame) -> DataFrame:
    """K5."""
    return messages.select("session_id", "ordinal", "role", F.left("content", F.lit(OUTLINE)).alias("preview"))


def budget_page(messages: DataFrame, budget: int) -> DataFrame:
    """K6: leading messages of each session within a byte budget; the first one always, cut if it alone is too large."""
    w = W.partitionBy("session_id").orderBy("ordinal")
    size = OVERHEAD + ESCAPED * F.octet_length("content")
    df = messages.withColumn("size", size).withColumn("used", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("r", F.row_number().over(w))
    kept = df.where((F.col("used") <= budget) | (F.col("r") == 1))
    text = F.when(F.col("size") > budget, F.left("content", F.lit(max(0, budget - OVERHEAD) // ESCAPED))).otherwise(F.col("content"))
    return kept.select("session_id", "ordinal", text.alias("content"), (F.col("size") > budget).alias("cut"))


def by_hash(messages: DataFrame, sha: str) -> DataFrame:
    """K7: messages whose text has the hash, computed again rather than trusted."""
    return messages.where(content_hash(F.col("content")) == sha).select("session_id", "ordinal", "content")


def duplicate_call_ids(calls: DataFrame) -> DataFrame:
    """K8."""
    return calls.where("call_uid IS NOT NULL").groupBy("session_id", "call_uid").agg(F.count("*").alias("n")).where("n > 1")


def subagents(x: Inputs) -> DataFrame:
    """K9: direct subagents with their verdict and title."""
    kids = current(x).where("relationship_type = 'subagent'").select("parent_session_id", "session_id", F.coalesce("sig_grade", F.lit("")).alias("grade"), F.coalesce("sig_outcome", F.lit("unknown")).alias("outcome"))
    return kids.join(titles(x), "session_id")


def audit(x: Inputs) -> DataFrame:
    """Messages, calls, cost and verdict of every session in one row, all from one snapshot."""
    m = x.messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    c = x.calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    u = x.usage_daily.groupBy("session_id").agg(F.round(F.sum("cost"), 9).alias("cost"))
    s = current(x).select("session_id", F.coalesce("sig_grade", F.lit("")).alias("grade"))
    return s.join(m, "session_id", "left").join(c, "session_id", "left").join(u, "session_id", "left").fillna(0, ["messages", "calls", "cost"])


def reply_marks(messages: DataFrame) -> DataFrame:
    """Seconds from the last user message to the first reply after it."""
    w = W.partitionBy("session_id").orderBy("ordinal")
    turn = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    df = messages.where("role IN ('user', 'assistant')").withColumn("turn", turn).where("turn > 0")
    first = F.row_number().over(W.partitionBy("session_id", "turn", "role").orderBy("ordinal"))
    df = df.withColumn("asked", F.max(F.when(F.col("role") == "user", F.unix_micros("ts"))).over(W.partitionBy("session_id", "turn"))).withColumn("n", first)
    secs = (F.unix_micros("ts") - F.col("asked")) / 1e6
    return df.where("role = 'assistant' AND n = 1").where(secs >= 0).select("session_id", "ordinal", secs.alias("latency"))


_SHA = "(SELECT sha256(content) FROM messages ORDER BY session_id, ordinal LIMIT 1)"


def _first_hash(x: Inputs) -> DataFrame:
    """Messages with the text of the very first one."""
    first = x.messages.agg(F.min_by(content_hash(F.col("content")), F.struct("session_id", "ordinal")).alias("s"))  # one row
    return x.messages.join(F.broadcast(first), content_hash(F.col("content")) == F.col("s")).select("session_id", "ordinal", "content")


QUERIES = {
    "K1_messages": (messages_with_usage, " SELECT m.session_id, ordinal, role, content_length, u.input, u.output, u.context FROM messages m LEFT JOIN (SELECT session_id, message_ordinal, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(input + cache_read + cache_write)::BIGINT AS context FROM ledger WHERE message_ordinal IS NOT NULL GROUP BY 1, 2) u ON m.session_id = u.session_id AND m.ordinal = u.message_ordinal"),
    "K2_tail_window": (lambda x: tail_window(x.messages, 2, 5), ", t AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lu, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS r, count(*) OVER (PARTITION BY session_id) AS a FROM messages) SELECT session_id, ordinal, role, a - count(*) OVER (PARTITION BY session_id) AS earlier FROM t WHERE lu < 2 AND r <= 5"),
    "K3_after_window": (lambda x: after_window(x.messages, 7, 1), " SELECT session_id, ordinal, role FROM messages WHERE session_id = 7 AND ordinal > 1 ORDER BY ordinal LIMIT 601"),
    "K2_default_tail": (lambda x: tail_window(x.messages), ", t AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lu, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS r, count(*) OVER (PARTITION BY session_id) AS a FROM messages) SELECT session_id, ordinal, role, a - count(*) OVER (PARTITION BY session_id) AS earlier FROM t WHERE lu < 50 AND r <= 600"),
    "K3_after_cursors": (lambda x: after_windows(x.messages, x.messages.select("session_id", (F.col("session_id") % 3 - 1).alias("cursor")), 2),
        """, c AS (SELECT DISTINCT session_id, session_id % 3 - 1 AS cursor FROM messages), t AS (SELECT m.session_id, cursor, ordinal, role, row_number() OVER (PARTITION BY m.session_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY m.session_id) AS n FROM messages m JOIN c ON m.session_id = c.session_id AND ordinal > cursor)
 SELECT session_id, cursor, ordinal, role, n > 2 AS more FROM t WHERE r <= 3"""),
    "K6_longest_page": (_pages_of_longest, """, l AS (SELECT session_id FROM messages GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1), s AS (SELECT m.*, 1024 + 6 * strlen(content) AS size FROM messages m JOIN l USING (session_id)), t AS (SELECT *, sum(size) OVER w AS used, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ordinal))
 SELECT session_id, ordinal, CASE WHEN size > 16000 THEN left(content, 2496) ELSE content END AS content, size > 16000 AS cut FROM t WHERE used <= 16000 OR r = 1"""),
    "K4_extras": (lambda x: extras(x, 1, 2), " SELECT session_id, message_ordinal, call_index, tool_name, status FROM calls WHERE message_ordinal BETWEEN 1 AND 2"),
    "K5_outline": (lambda x: outline(x.messages), " SELECT session_id, ordinal, role, left(content, 512) AS preview FROM messages"),
    "K6_budget_page": (lambda x: budget_page(x.messages, 4000), ", s AS (SELECT *, 1024 + 6 * strlen(content) AS size FROM messages), t AS (SELECT *, sum(size) OVER w AS used, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)) SELECT session_id, ordinal, CASE WHEN size > 4000 THEN left(content, 496) ELSE content END AS content, size > 4000 AS cut FROM t WHERE used <= 4000 OR r = 1"),
    "K7_by_hash": (_first_hash, f" SELECT session_id, ordinal, content FROM messages WHERE sha256(content) = {_SHA}"),
    "K8_duplicate_ids": (lambda x: duplicate_call_ids(x.calls), " SELECT session_id, call_uid, count(*) AS n FROM calls WHERE call_uid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"),
    "K9_subagents": (subagents, r", ti AS (SELECT s.session_id, coalesce(s.title, left(trim(regexp_replace(c, '\s+', ' ', 'g')), 240), '') AS title FROM sessions s LEFT JOIN (SELECT session_id, arg_min(content, ordinal) AS c FROM messages WHERE role = 'user' AND content <> '' GROUP BY 1) USING (session_id)) SELECT parent_session_id, session_id, coalesce(sig_grade, '') AS grade, coalesce(sig_outcome, 'unknown') AS outcome, ti.title FROM graded JOIN ti USING (session_id) WHERE relationship_type = 'subagent'"),
    "K10_audit": (audit, " SELECT g.session_id, coalesce(sig_grade, '') AS grade, coalesce(messages, 0) AS messages, coalesce(calls, 0) AS calls, coalesce(cost, 0) AS cost FROM graded g LEFT JOIN (SELECT session_id, count(*) AS messages FROM messages GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS calls FROM calls GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, round(sum(cost), 9) AS cost FROM ledger GROUP BY 1) USING (session_id)"),
    "K11_reply_marks": (lambda x: reply_marks(x.messages), ", t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS turn FROM messages WHERE role IN ('user', 'assistant')), n AS (SELECT *, max(epoch_us(ts)) FILTER (role = 'user') OVER (PARTITION BY session_id, turn) AS asked, row_number() OVER (PARTITION BY session_id, turn, role ORDER BY ordinal) AS n FROM t WHERE turn > 0) SELECT session_id, ordinal, (epoch_us(ts) - asked) / 1e6 AS latency FROM n WHERE role = 'assistant' AND n = 1 AND epoch_us(ts) >= asked"),
}
