"""Queries of the projection, rollups and signals, with their SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import pricing, quality
from loomlog.operators import project, rollups, signals
from loomlog.sources import raw
from loomlog.sources.appendlog import AppendLog
from loomlog.sources.shared import shared_dir
from loomlog.sources.views import Inputs, as_of
from loomlog.streaming import rederive, settle
from loomlog.streaming.drain import Drain


def _models(x):
    df = x.usage.groupBy("model").agg(F.count("*").alias("n"))
    return df.select("model", "n", pricing.normalize_model(F.concat(F.lit(" "), F.upper("model"), F.when(F.col("n") % 2 == 0, "-20250807").otherwise(""))).alias("normal"))


def _rates(x):
    cols = ["r_in", "r_out", "r_cw", "r_cr"]
    at = x.usage.select("model", "occurred_at").distinct()
    return pricing.with_rates(at).groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in cols], F.count("*").alias("n"))


def _prompts(x):
    return project.duplicate_prompts(project.prompt_facts(x.messages))


def _patched(x):
    results = x.calls.where("status IS NOT NULL AND call_uid IS NOT NULL").select("session_id", "call_uid", "status", F.expr("message_ordinal * 10 + call_index").alias("seq"))
    return project.patch_results(x.calls.select("session_id", "call_uid", "message_ordinal", "call_index"), results)


def _links(x):
    s = x.sessions
    kids = s.select("session_id", (F.col("user_id") % 7).alias("user_id"), "agent", "source_session_id", F.when(F.col("session_id") % 3 == 1, F.concat(F.lit("src-"), F.col("session_id") - 1)).alias("parent_source_id"))
    kids = kids.withColumn("source_session_id", F.when(F.col("session_id") % 3 == 2, F.concat(F.lit("src-"), F.col("session_id") - 2, F.lit("/subagents/x"))).otherwise(F.col("source_session_id")))
    return project.link_subagents(kids)


def _relative(x):
    df = x.calls.where("file_path IS NOT NULL").join(x.sessions.select("session_id", "cwd"), "session_id")
    return df.groupBy("file_path", "cwd").agg(F.count("*").alias("n")).withColumn("rel", project.relative_path(F.col("file_path"), F.col("cwd")))


def _announced(x):
    df = x.sessions.select(F.col("user_id").alias("session_id"), F.col("session_id").alias("at"), "terminal", "cwd", "git_branch", "machine")
    return project.latest_announced(df)


def _sanitized(x):
    """Texts with a NUL and a byte that is no UTF-8."""
    dirty = F.concat(F.col("content").cast("binary"), F.lit(bytearray(b"\x00x\xffy"))).cast("string")
    return x.messages.select("session_id", "ordinal", F.sha2(project.sanitized(dirty).cast("binary"), 256).alias("sha"))


def _incremental(x):
    """Rollups of all sessions but every 97th, then of these, then the churn of those that moved; rows, sums and what the second step wrote."""
    tables = {"ledger": x.ledger, "calls": x.calls, "messages": x.messages, "sessions": x.sessions}
    ids = x.sessions.select("session_id").union(x.calls.select("session_id")).union(x.messages.select("session_id")).distinct()
    moved = x.sessions.withColumn("cwd", F.when(F.col("session_id") % 50 == 0, "/home/u").otherwise(F.col("cwd")))
    derive = lambda keep, **new: rollups.derived(**{k: v.where(keep) for k, v in (tables | new).items()})
    late, gone = "session_id % 97 = 0", "session_id % 50 = 0"
    first = derive(f"NOT {late}")
    schemas = {t: ", ".join(f"`{n}` {k}" for n, k in df.dtypes) for t, df in first.items()}
    store = rollups.SessionStore(x.spark, f"{shared_dir(x.spark)}/rollups-{uuid.uuid4().hex}", schemas)
    store.upsert(ids.where(f"NOT {late}"), first)
    store.upsert(ids.where(late), derive(late))
    wrote = {t: store.last_written(t) for t in schemas}
    store.upsert(ids.where(gone), {"file_churn": derive(gone, sessions=moved)["file_churn"]})
    sums = {"usage_daily": F.sum("input"), "tool_rollup": F.sum("calls"), "file_churn": F.sum(F.char_length("churn_path") * F.col("edits")), "turns": F.sum("turn"), "activity_hourly": F.sum("messages")}
    each = [store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), v.cast("long").alias("total"), F.lit(wrote[t]).cast("long").alias("written")) for t, v in sums.items()]
    return functools.reduce(DataFrame.unionAll, each)


def _due(x):
    s = x.sessions.select("session_id", F.col("message_count").alias("raw_bytes"), F.expr("message_count - session_id % 2 AS parsed_bytes"), F.expr("20 - session_id % 3 AS epoch"), F.when(F.col("session_id") % 5 == 0, 20).alias("failed_epoch"), F.when(F.col("session_id") % 5 == 0, F.col("message_count")).alias("failed_bytes"), F.when(F.col("session_id") % 7 == 0, F.col("ended_at")).alias("retry_at"))
    return rederive.due(s, 20, F.lit("2026-01-01 00:00:00").cast("timestamp")).select("session_id", "raw_bytes")


def _drained(x):
    """L1: the lines of all messages, appended to a log and drained in pages of 40 sessions; what was derived, parsed and how many pages it took."""
    log = AppendLog(x.spark, f"{shared_dir(x.spark)}/log-{uuid.uuid4().hex}")
    log.append(raw.chunks(x.messages).select("session_id", F.col("ordinal").alias("seq"), "byte_offset", "data"))
    derive = lambda lines: {"sizes": lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"))}
    d = Drain(log, f"{shared_dir(x.spark)}/drained-{uuid.uuid4().hex}", {"sizes": "session_id long, lines long, bytes long"}, derive, page=40)
    d.run()
    return d.store.read("sizes").join(d.state().select("session_id", "parsed_bytes"), "session_id").withColumn("pages", F.lit(len(d.pages)).cast("long"))


def _graded(x):
    """Stale sessions that are idle or terminal, graded page by page into a store of their own."""
    schema = "session_id long, outcome string, confidence string, score int, grade string"
    store = rollups.SessionStore(x.spark, f"{shared_dir(x.spark)}/graded-{uuid.uuid4().hex}", {"signals": schema})
    idle = F.col("terminal") | (F.col("ended_at") < as_of() - F.expr(f"INTERVAL {signals.IDLE_MINUTES} MINUTES"))
    grade = lambda ids: signals.session_signals(Inputs(x.spark, x.sf_dir, ids)).select("session_id", "outcome", "confidence", "score", "grade")
    sizes = settle.grade_stale(x.sessions.where("signals_stale").where(idle).select("session_id", "ended_at"), grade, store, "signals")
    return store.read("signals").withColumn("pages", F.lit(len(sizes)).cast("long"))


def _bands(x):
    return signals.thinking(x.messages).groupBy("band").agg(F.count("*").alias("sessions"))


_VERB = rf"(?i)\b(?:{'|'.join(quality.CHANGE_VERBS)})\b"
_ANCHOR = rf"(?i)\b[\w.-]+\.(?:{'|'.join(quality.FILE_EXTENSIONS)})\b|\b(?:{'|'.join(quality.BARE_FILES)})\b|(?:^|[^\w.])\.(?:{'|'.join(quality.DOT_FILES)})\b|[\w.-]+/[\w.-]+/[\w./-]+"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x{{A0}}\x{{85}}]+'), lambda w: w <> '')"
_FACTS = f""", p AS (SELECT session_id, ordinal, content, {_WORDS.format('content')} AS w FROM messages WHERE role = 'user' AND content <> ''),
 f AS (SELECT session_id, ordinal, len(w) < 4 AS short,
   regexp_matches(content, '{_VERB}') AND NOT (regexp_matches(content, '{_ANCHOR}') OR length(content) - length(replace(content, '`', '')) >= 2) AS no_code,
   len(w) > 0 AND len(list_filter(w, lambda t: lower(trim(t, '.,!?;:')) NOT IN ({', '.join(repr(w) for w in quality.PLEASANTRIES)}))) = 0 AS greeting,
   sha256(array_to_string({_WORDS.format('lower(content)')}, ' ')) AS digest FROM p),
 h AS (SELECT *, NOT short AND row_number() OVER (PARTITION BY session_id, digest, short ORDER BY ordinal) > 1 AS duplicate FROM f)"""
_SUM4 = "sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_write)::BIGINT AS cache_write, sum(cache_read)::BIGINT AS cache_read"
_THINK = """, a AS (SELECT *, thinking_bytes / 10.7::DOUBLE AS tok FROM messages WHERE role = 'assistant'),
 t AS (SELECT session_id, tok, row_number() OVER (PARTITION BY session_id ORDER BY tok DESC, ordinal) AS r, greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY session_id))) AS k FROM a WHERE thinking_bytes > 0),
 u AS (SELECT session_id, count(*) AS thinking_turns, round(avg(tok) FILTER (r <= k))::BIGINT AS tail_tokens, round(max(tok))::BIGINT AS peak_tokens FROM t GROUP BY 1),
 th AS (SELECT session_id, assistant_turns, coalesce(thinking_turns, 0) AS thinking_turns, tail_tokens, peak_tokens,
  CASE WHEN coalesce(thinking_turns, 0) = 0 THEN 'off' WHEN tail_tokens <= 128 THEN 'low' WHEN tail_tokens <= 512 THEN 'medium' WHEN tail_tokens <= 2048 THEN 'high' ELSE 'xhigh' END AS band
  FROM (SELECT session_id, count(*) AS assistant_turns FROM a GROUP BY 1) LEFT JOIN u USING (session_id))"""
TURNS_SQL = """, mt AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS turn FROM messages),
 tt AS (SELECT session_id, turn, min(ts) FILTER (role = 'user') AS prompt_at, arg_min(ts, ordinal) FILTER (role = 'assistant' AND ts IS NOT NULL) AS reply_at FROM mt WHERE turn > 0 GROUP BY 1, 2),
 session_turns AS (SELECT session_id, turn::BIGINT AS turn, prompt_at, (epoch_us(reply_at) - epoch_us(prompt_at)) / 1e6 AS response_secs FROM tt WHERE reply_at >= prompt_at)"""
HOURLY_SQL = """, tm AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, ordinal)) / 1e6 AS gap FROM messages WHERE ts IS NOT NULL),
 ha AS (SELECT session_id, ts::DATE AS day, hour(ts) AS hour, count(*) AS messages, sum(CASE WHEN gap > 0 AND gap <= 300 THEN gap ELSE 0 END) AS active_seconds FROM tm GROUP BY 1, 2, 3),
 hb AS (SELECT m.session_id, m.ts::DATE AS day, hour(m.ts) AS hour, count(*) AS tool_calls FROM tool_calls c JOIN messages m ON c.session_id = m.session_id AND c.message_ordinal = m.ordinal WHERE m.ts IS NOT NULL GROUP BY 1, 2, 3),
 hourly AS (SELECT session_id, day, hour, messages, coalesce(tool_calls, 0) AS tool_calls, active_seconds FROM ha LEFT JOIN hb USING (session_id, day, hour))"""
_REL = "CASE WHEN cwd IS NOT NULL AND starts_with(file_path, concat(cwd, '/')) AND length(file_path) > length(cwd) + 1 THEN substr(file_path, length(cwd) + 2) END"
CHURN_SQL = f""", ce AS (SELECT * FROM calls WHERE category = 'edit' AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, call_uid, CASE WHEN call_uid IS NULL THEN concat(message_ordinal, ':', call_index) END, tool_name, coalesce(input, ''), coalesce(status, '') ORDER BY message_ordinal, call_index) = 1),
 churn AS (SELECT session_id, coalesce({_REL}, file_path) AS churn_path, count(*) AS edits FROM ce LEFT JOIN sessions USING (session_id) GROUP BY 1, 2)"""
CONTEXT_SQL = """, cx AS (SELECT session_id, input + cache_read + cache_write AS ctx, lag(input + cache_read + cache_write) OVER (PARTITION BY session_id ORDER BY source_offset NULLS LAST, source_index, input + cache_read + cache_write) AS prev FROM ledger),
 ctxh AS (SELECT session_id, max(ctx) AS peak_context, count(*) FILTER (prev >= 20000 AND ctx <= 0.5 * prev) AS context_resets FROM cx GROUP BY 1)"""
HYGIENE_SQL = _FACTS + """, hyg AS (SELECT session_id, count(*) AS prompts, count(*) FILTER (short) AS short, count(*) FILTER (no_code) AS no_code, count(*) FILTER (duplicate) AS duplicate,
 arg_min(short OR greeting, ordinal) AS unstructured FROM h GROUP BY 1)"""
_PENALTY = [("errored ending", "NULL", "CASE WHEN outcome = 'errored' THEN 30 ELSE 0 END"), ("abandoned", "NULL", "CASE WHEN outcome = 'abandoned' THEN 15 ELSE 0 END"), ("tool failure", "tool_failures", "least(3 * tool_failures, 30)"), ("retry", "tool_retries", "least(5 * tool_retries, 25)"), ("churned edit", "edit_churn", "least(4 * edit_churn, 20)"), ("failure streak", "NULL", "CASE WHEN streak >= 3 THEN 10 ELSE 0 END")]
_many = lambda s: s[:-1] + "ies" if s.endswith("y") else s + "s"

QUERIES = {
    "C1_usage_dedup": (lambda x: project.dedup_usage(x.usage).groupBy("model").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.countDistinct("session_id").alias("sessions")), " SELECT model, count(*) AS n, sum(input)::BIGINT AS input, count(DISTINCT session_id) AS sessions FROM deduped GROUP BY 1"),
    "C2_result_patch": (_patched, """, r AS (SELECT session_id, call_uid, arg_min(status, message_ordinal * 10 + call_index) AS result_status FROM calls WHERE status IS NOT NULL AND call_uid IS NOT NULL GROUP BY 1, 2)
      SELECT c.session_id, c.call_uid, c.message_ordinal, c.call_index, result_status FROM calls c LEFT JOIN r USING (session_id, call_uid)"""),
    "C3_cost": (lambda x: x.ledger.select("session_id", "source_offset", "source_index", F.round("cost", 9).alias("cost")), " SELECT session_id, source_offset, source_index, round(cost, 9) AS cost FROM ledger"),
    "C4_model_normalize": (_models, ", m AS (SELECT model, count(*) AS n FROM usage GROUP BY 1), d AS (SELECT *, lower(trim(concat(' ', upper(model), CASE n % 2 WHEN 0 THEN '-20250807' ELSE '' END))) AS low FROM m) SELECT model, n, regexp_replace(low, '-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', '') AS normal FROM d"),
    "C5_cache_savings": (lambda x: x.ledger.groupBy("model").agg(F.round(F.sum("savings"), 9).alias("savings")), " SELECT model, round(sum(savings), 9) AS savings FROM ledger GROUP BY 1"),
    "C6_rate_windows": (_rates, """, a AS (SELECT DISTINCT model, occurred_at FROM usage) SELECT a.model, round(avg(r_in), 6) AS r_in, round(avg(r_out), 6) AS r_out, round(avg(r_cw), 6) AS r_cw, round(avg(r_cr), 6) AS r_cr, count(*) AS n
      FROM a LEFT JOIN rates r ON regexp_replace(lower(trim(a.model)), '-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', '') = r.model AND coalesce(a.occurred_at >= r.from_ts, true) AND (a.occurred_at IS NOT NULL OR r.from_ts IS NULL) AND coalesce(a.occurred_at < r.until_ts, true) GROUP BY 1"""),
    "C7_turn_usage": (lambda x: project.turn_usage(x.ledger), f" SELECT session_id, message_ordinal, {_SUM4}, sum(reasoning)::BIGINT AS reasoning, round(sum(cost), 9) AS cost FROM ledger WHERE message_ordinal IS NOT NULL GROUP BY 1, 2"),
    "C8_session_totals": (lambda x: project.session_totals(x.ledger), f" SELECT session_id, count(*) AS events, {_SUM4}, round(sum(cost), 9) AS cost, round(sum(savings), 9) AS savings FROM ledger GROUP BY 1"),
    "C9_prompt_facts": (lambda x: project.prompt_facts(x.messages), _FACTS + " SELECT session_id, ordinal, short, no_code, greeting, digest FROM f"),
    "C10_duplicate_prompts": (_prompts, _FACTS + " SELECT * FROM h"),
    "C11_relative_path": (_relative, f" SELECT file_path, cwd, count(*) AS n, {_REL} AS rel FROM calls JOIN sessions USING (session_id) WHERE file_path IS NOT NULL GROUP BY 1, 2"),
    "C12_content_hash": (lambda x: x.messages.select("session_id", "ordinal", project.content_hash(F.col("content")).alias("sha")), " SELECT session_id, ordinal, sha256(content) AS sha FROM messages"),
    "C13_subagent_links": (_links, """, k AS (SELECT session_id, user_id % 7 AS u, agent, CASE session_id % 3 WHEN 1 THEN concat('src-', session_id - 1) WHEN 2 THEN concat('src-', session_id - 2) END AS p,
      CASE WHEN session_id % 3 <> 2 THEN source_session_id ELSE concat('src-', session_id - 2, '/subagents/x') END AS src FROM sessions)
      SELECT a.session_id, b.session_id AS parent_session_id FROM k a JOIN k b ON a.u = b.u AND a.agent = b.agent AND a.p = b.src WHERE a.session_id <> b.session_id"""),
    "C14_sanitize": (_sanitized, " SELECT session_id, ordinal, sha256(concat(content, chr(65533), 'x', chr(65533), 'y')) AS sha FROM messages"),
    "C15_facet_counts": (lambda x: project.facet_counts(x.sessions), " " + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c}::VARCHAR AS key, count(*) AS sessions FROM sessions GROUP BY 2" for c in ("agent", "machine", "user_id", "project_id"))),
    "A12_session_announce": (_announced, """ SELECT user_id AS session_id, bool_or(terminal) AS terminal, arg_max(cwd, session_id) FILTER (cwd IS NOT NULL) AS cwd, arg_max(git_branch, session_id) AS git_branch, arg_max(machine, session_id) AS machine FROM sessions GROUP BY 1"""),
    "D1_usage_daily": (lambda x: x.usage_daily.select("session_id", "day", "model", "input", "output", "cache_write", "cache_read", F.round("cost", 9).alias("cost")), f" SELECT session_id, occurred_at::DATE::VARCHAR AS day, model, {_SUM4}, round(sum(cost), 9) AS cost FROM ledger GROUP BY 1, 2, 3"),
    "D2_tool_rollup": (lambda x: x.tool_rollup, " SELECT session_id, tool_name, CASE category WHEN '' THEN 'other' ELSE category END AS category, count(*) AS calls, count(*) FILTER (status = 'error') AS failures FROM tool_calls GROUP BY 1, 2, 3"),
    "D3_file_churn": (lambda x: x.file_churn, CHURN_SQL + " SELECT * FROM churn"),
    "D4_session_turns": (lambda x: x.turns, TURNS_SQL + " SELECT * FROM session_turns"),
    "D5_activity_hourly": (lambda x: x.activity_hourly, HOURLY_SQL + " SELECT * REPLACE (day::VARCHAR AS day) FROM hourly"),
    "D6_incremental": (_incremental, TURNS_SQL + HOURLY_SQL + CHURN_SQL.replace("LEFT JOIN sessions USING (session_id)", "LEFT JOIN (SELECT session_id, CASE session_id % 50 WHEN 0 THEN '/home/u' ELSE cwd END AS cwd FROM sessions) USING (session_id)") + f""",
      old AS (SELECT session_id FROM calls c LEFT JOIN sessions s USING (session_id) WHERE category = 'edit' AND file_path IS NOT NULL AND session_id % 97 = 0 GROUP BY session_id, coalesce({_REL}, file_path)),
      da AS (SELECT session_id, sum(input) AS input FROM ledger GROUP BY session_id, occurred_at::DATE, model), ta AS (SELECT session_id, count(*) AS calls FROM tool_calls GROUP BY session_id, tool_name, CASE category WHEN '' THEN 'other' ELSE category END)
      SELECT 'usage_daily' AS name, count(*) AS n, sum(input)::BIGINT AS total, count(*) FILTER (session_id % 97 = 0) AS written FROM da UNION ALL SELECT 'tool_rollup', count(*), sum(calls)::BIGINT, count(*) FILTER (session_id % 97 = 0) FROM ta
      UNION ALL SELECT 'file_churn', count(*), sum(length(churn_path) * edits)::BIGINT, (SELECT count(*) FROM old) FROM churn UNION ALL SELECT 'turns', count(*), sum(turn)::BIGINT, count(*) FILTER (session_id % 97 = 0) FROM session_turns
      UNION ALL SELECT 'activity_hourly', count(*), sum(messages)::BIGINT, count(*) FILTER (session_id % 97 = 0) FROM hourly"""),
    "L2_due": (_due, " SELECT session_id, raw_bytes FROM (SELECT session_id, message_count AS raw_bytes, message_count - session_id % 2 AS parsed_bytes, 20 - session_id % 3 AS epoch, CASE session_id % 5 WHEN 0 THEN 20 END AS failed_epoch, CASE session_id % 7 WHEN 0 THEN ended_at END AS retry_at FROM sessions) WHERE coalesce(retry_at <= TIMESTAMP '2026-01-01', false) OR (failed_epoch IS NULL AND retry_at IS NULL AND (raw_bytes > parsed_bytes OR epoch < 20))"),
    "L1_drain": (_drained, """, ln AS (SELECT session_id, unnest(string_split(content, chr(10))) AS line, strlen(content) + 1 AS n, ordinal FROM messages), tr AS (SELECT session_id, trim(line) AS line FROM ln),
      sz AS (SELECT session_id, count(*) AS lines, sum(strlen(line))::BIGINT AS bytes FROM tr WHERE line <> '' GROUP BY 1)
      SELECT session_id, lines, bytes, parsed_bytes, (SELECT ceil(count(DISTINCT session_id) / 40)::BIGINT FROM messages) AS pages FROM sz JOIN (SELECT session_id, sum(strlen(content) + 1)::BIGINT AS parsed_bytes FROM messages GROUP BY 1) USING (session_id)"""),
    "L5_graded": (_graded, """, du AS (SELECT session_id FROM sessions WHERE signals_stale AND (terminal OR ended_at < TIMESTAMP '2027-01-01' - INTERVAL 30 MINUTE))
      SELECT session_id, outcome, confidence, score, grade, (SELECT ceil(count(*) / 500)::BIGINT FROM du) AS pages FROM signals JOIN du USING (session_id)"""),
    "L4_backoff": (lambda x: x.sessions.select("session_id", rederive.backoff_seconds(F.col("session_id") % 12 + 1).alias("wait")), " SELECT session_id, least(3600, 30 * (1 << (session_id % 12)::INT))::BIGINT AS wait FROM sessions"),
    "E1_replay_dedup": (lambda x: x.tool_calls.groupBy("session_id").agg(F.count("*").alias("calls")), " SELECT session_id, count(*) AS calls FROM tool_calls GROUP BY 1"),
    "E2_tool_health": (lambda x: signals.tool_health(x.tool_calls), " SELECT session_id, tool_calls, tool_failures, tool_retries, edit_churn, coalesce(longest, 0) AS streak, pending, tail_failures FROM tagg LEFT JOIN streak USING (session_id)"),
    "E8_last_words": (lambda x: signals.last_words(x.messages), " SELECT session_id, last_user, last_assistant FROM magg"),
    "E9_hygiene": (lambda x: signals.hygiene(x.messages), HYGIENE_SQL + " SELECT * FROM hyg"),
    "E10_context_health": (lambda x: x.context_health, CONTEXT_SQL + " SELECT * FROM ctxh"),
    "E11_thinking": (lambda x: signals.thinking(x.messages), _THINK + " SELECT * FROM th"),
    "E12_thinking_bands": (_bands, _THINK + " SELECT band, count(*) AS sessions FROM th GROUP BY 1"),
    "E13_outcome": (lambda x: x.signals.select("session_id", "outcome", "confidence"), " SELECT session_id, outcome, confidence FROM signals"),
    "E14_score": (lambda x: x.signals.select("session_id", "score"), " SELECT session_id, score FROM signals"),
    "E15_grade": (lambda x: x.signals.select("session_id", "grade", quality.grade_points(F.col("grade")).alias("points")), " SELECT session_id, grade, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 WHEN 'F' THEN 0 END AS points FROM signals"),
    "E16_score_breakdown": (signals.score_breakdown, ", b AS (" + " UNION ALL ".join(f"SELECT session_id, " + (f"'{n}'" if c == "NULL" else f"concat({c}, CASE {c} WHEN 1 THEN ' {n}' ELSE ' {_many(n)}' END)") + f" AS label, ({p})::BIGINT AS points FROM scored WHERE score IS NOT NULL" for n, c, p in _PENALTY) + ") SELECT * FROM b WHERE points > 0"),
    "E17_archetype": (lambda x: signals.shaped(x).select("session_id", "archetype"), " SELECT session_id, archetype FROM shape"),
    "E18_settle_due": (signals.settle_due, " SELECT session_id, ended_at FROM sessions WHERE signals_stale AND (terminal OR ended_at < TIMESTAMP '2027-01-01' - INTERVAL 30 MINUTE) ORDER BY ended_at NULLS LAST, session_id LIMIT 500"),
    "E19_signal_read": (signals.signal_read, " SELECT session_id, coalesce(sig_outcome, 'unknown') AS outcome, coalesce(sig_grade, '') AS grade, sig_score FROM graded"),
}
