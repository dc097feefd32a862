"""Insight queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import insights as I
from loomlog.operators.windows import WINDOWS, window_values
from loomlog.plans.derivations import CHURN_SQL, CONTEXT_SQL, HOURLY_SQL, HYGIENE_SQL, TURNS_SQL
from loomlog.sources.views import AS_OF

_GRID = f""", b AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(started_at) FROM sessions))::TIMESTAMP, date_trunc('week', TIMESTAMP '{AS_OF}')::TIMESTAMP, INTERVAL 7 DAY)) AS t),
 grid AS (SELECT t::DATE AS bucket FROM b ORDER BY t DESC LIMIT 120),
 coh AS (SELECT *, date_trunc('week', started_at)::DATE AS bucket FROM graded WHERE started_at < TIMESTAMP '{AS_OF}' AND date_trunc('week', started_at)::DATE >= (SELECT min(bucket) FROM grid)),
 du AS (SELECT *, date_trunc('week', occurred_at)::DATE AS bucket FROM ledger WHERE occurred_at < TIMESTAMP '{AS_OF}' AND date_trunc('week', occurred_at)::DATE >= (SELECT min(bucket) FROM grid))"""


def _trend(body: str, zeros: list[str], keep: str = "", extra: str = "") -> str:
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in zeros) + (", " + keep if keep else "")
    return extra + _GRID + f", q AS ({body}) SELECT g.bucket::VARCHAR AS bucket, {cols} FROM grid g LEFT JOIN q ON g.bucket = q.bucket"


def _folded(source: str, key: str, value: str, skip: str = "") -> str:
    return f""", src AS ({source}), top AS (SELECT {key} AS k FROM src WHERE {key} <> '{skip}' GROUP BY 1 ORDER BY sum({value}) DESC, 1 LIMIT 6),
     z AS (SELECT bucket, coalesce(k, 'other') AS key, sum({value}) AS v FROM src LEFT JOIN top ON {key} = k GROUP BY 1, 2)
     SELECT bucket::VARCHAR AS bucket, key, round(v / sum(v) OVER (PARTITION BY bucket), 9) AS share FROM z"""


def _filled(keys: list[str], source: str) -> str:
    values = ", ".join(f"('{k}', {i})" for i, k in enumerate(keys))
    return f", k AS (SELECT * FROM (VALUES {values}) v(key, place)), c AS ({source}) SELECT k.key, place::INTEGER AS place, coalesce(n, 0) AS n FROM k LEFT JOIN c ON k.key = c.key"


_pct = lambda test, name: f"round(100.0 * count(*) FILTER ({test}) / count(*), 9) AS {name}"
_SPANS = ", sp AS (SELECT * FROM sessions WHERE ended_at > started_at), ev AS (SELECT user_id, started_at AS t, 1 AS d FROM sp UNION ALL SELECT user_id, ended_at, -1 FROM sp)"
_CALLS = "tr AS (SELECT session_id, tool_name, CASE category WHEN '' THEN 'other' ELSE category END AS category, count(*) AS calls, count(*) FILTER (status = 'error') AS failures FROM tool_calls GROUP BY 1, 2, 3), ct AS (SELECT tr.*, bucket FROM tr JOIN coh USING (session_id))"
_HOT = CHURN_SQL + ", hot AS (SELECT project_id, churn_path AS path, sum(edits)::BIGINT AS edits, count(DISTINCT session_id) AS sessions FROM churn JOIN sessions USING (session_id) GROUP BY 1, 2 HAVING sum(edits) > 1)"
_TOKS = "input + output + cache_read + cache_write"
_GALLERY = f"""{_GRID}, sc AS (SELECT session_id, sum(cost) AS cost FROM ledger GROUP BY 1),
 gal AS (SELECT session_id, round(minutes * 60, 3) AS duration_s, round(coalesce(cost, 0), 9) AS cost, archetype, coalesce(sig_grade, '') AS grade, coalesce(sig_outcome, 'unknown') AS outcome FROM coh LEFT JOIN sc USING (session_id) WHERE ended_at >= started_at)"""

#: The clock of the pass over several windows; every window up to it has sessions.
CLOCK = "2024-06-15 12:00:00"
_COUNTS = {f"grade_{g}": f"count(*) FILTER (sig_grade = '{g}')" for g in "ABCDF"} | {a: f"count(*) FILTER (archetype = '{a}')" for a in ("quick", "standard", "deep", "marathon", "automation")}
_OUTCOMES = {o: f"count(*) FILTER (coalesce(sig_outcome, 'unknown') = '{o}')" for o in ("completed", "abandoned", "errored")}
_COST_OF = lambda test: f"sum(CASE WHEN {test} THEN cost ELSE 0 END)"
#: By panel: its rows with an instant `t`, and its values.
_PARTS = {
    "quality": [("SELECT *, started_at AS t FROM graded", {"sessions": "count(*)", "wall_hours": "sum(minutes) / 60"} | _OUTCOMES | _COUNTS)],
    "hygiene": [("SELECT h.*, started_at AS t FROM hyg h JOIN sessions s USING (session_id) WHERE NOT signals_stale", {k: f"sum({k})" for k in ("prompts", "short", "no_code", "duplicate")} | {"unstructured": "count(*) FILTER (unstructured)"})],
    "context": [("SELECT c.*, started_at AS t FROM ctxh c JOIN sessions USING (session_id)", {"resets": "sum(context_resets)", "peak": "max(peak_context)"})],
    "economics": [(
        "SELECT l.*, coalesce(sig_outcome, '') AS o, relationship_type, occurred_at::DATE::TIMESTAMP AS t FROM ledger l JOIN graded USING (session_id) WHERE occurred_at IS NOT NULL",
        {"cost": "sum(cost)", "savings": "sum(savings)", "tokens": f"sum({_TOKS})", "hit_rate": "sum(cache_read) / nullif(sum(input + cache_read + cache_write), 0)"}
        | {"cost_completed": _COST_OF("o = 'completed'"), "cost_abandoned": _COST_OF("o = 'abandoned'"), "cost_subagents": _COST_OF("relationship_type = 'subagent'")},
    )],
    "velocity": [
        ("SELECT *, day::TIMESTAMP AS t FROM hourly", {"active_hours": "sum(active_seconds) / 3600", "messages": "sum(messages)", "tool_calls": "sum(tool_calls)"}),
        ("SELECT *, prompt_at AS t FROM session_turns", {f"p{p}": f"quantile_cont(response_secs, 0.{p})" for p in (50, 90, 99)}),
    ],
    "tools": [("SELECT c.status, started_at AS t FROM tool_calls c JOIN sessions USING (session_id)", {"calls": "count(*)", "failures": "count(*) FILTER (status = 'error')"})],
    "churn": [("SELECT c.*, started_at AS t FROM churn c JOIN sessions USING (session_id)", {"edits": "sum(edits)", "paths": "count(*)"})],
}


def _values(panels: list[str]) -> str:
    end = "TIMESTAMP '2024-06-16'"
    wins = ", ".join(f"('{n}', {f'{end} - INTERVAL {d} DAY' if d else chr(39) + '1900-01-01' + chr(39) + '::TIMESTAMP'}, '{u}')" for n, (d, u) in WINDOWS.items())
    each = []
    for p in panels:
        for rows, values in _PARTS[p]:
            body = f"SELECT win, CASE unit WHEN 'day' THEN t::DATE ELSE date_trunc('week', t)::DATE END AS bucket, {', '.join(f'round(({v})::DOUBLE, 9) AS {n}' for n, v in values.items())} FROM ({rows}) r JOIN wn ON t >= lo AND t < {end} GROUP BY 1, 2"
            each.append(f"SELECT '{p}' AS panel, win, bucket::VARCHAR AS bucket, unnest([{', '.join(repr(n) for n in values)}]) AS metric, unnest([{', '.join(values)}]) AS value FROM ({body})")
    return TURNS_SQL + HOURLY_SQL + CHURN_SQL + CONTEXT_SQL + HYGIENE_SQL + f", wn AS (SELECT * FROM (VALUES {wins}) w(win, lo, unit)) SELECT * FROM ({' UNION ALL '.join(each)}) WHERE value IS NOT NULL"


QUERIES = {
    "H1_grades": (I.grade_distribution, _filled(["A", "B", "C", "D", "F", ""], "SELECT coalesce(sig_grade, '') AS key, count(*) AS n FROM graded GROUP BY 1")),
    "H1_outcomes": (I.outcome_distribution, _filled(["completed", "abandoned", "errored", "unknown"], "SELECT coalesce(sig_outcome, 'unknown') AS key, count(*) AS n FROM graded GROUP BY 1")),
    "H2_archetypes": (I.archetype_distribution, _filled(["quick", "standard", "deep", "marathon", "automation"], "SELECT archetype AS key, count(*) AS n FROM shape GROUP BY 1")),
    "H3_concurrency": (I.concurrency, _SPANS + """, r AS (SELECT t, sum(d) OVER (ORDER BY t, d DESC) AS n FROM ev), u AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d DESC) AS n FROM ev),
      bu AS (SELECT username, max(n) AS n FROM u JOIN users USING (user_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
      SELECT (SELECT max(n) FROM r)::BIGINT AS fleet_peak, (SELECT min(t) FROM r WHERE n = (SELECT max(n) FROM r)) AS fleet_peak_at, (SELECT username FROM bu) AS busiest_user, (SELECT n FROM bu)::BIGINT AS busiest_user_peak,
        round(sum(epoch_us(ended_at) - epoch_us(started_at)) / (epoch_us(max(ended_at)) - epoch_us(min(started_at))), 9) AS avg_concurrent, count(*) AS sessions FROM sp"""),
    "H6_velocity": (I.velocity, TURNS_SQL + HOURLY_SQL + """ SELECT round(quantile_cont(response_secs, 0.5) * 1000)::BIGINT AS response_p50, round(quantile_cont(response_secs, 0.9) * 1000)::BIGINT AS response_p90,
      round(quantile_cont(response_secs, 0.5) FILTER (turn = 1) * 1000)::BIGINT AS first_response_p50, count(*) AS turns, count(DISTINCT session_id) AS sessions, (SELECT sum(active_seconds) FROM hourly) AS active_seconds,
      (SELECT round(sum(messages) * 60 / sum(active_seconds), 9) FROM hourly) AS msgs_per_min, (SELECT round(sum(tool_calls) * 60 / sum(active_seconds), 9) FROM hourly) AS tools_per_min FROM session_turns"""),
    "H7_top_tools": (I.top_tools, ", t AS (SELECT tool_name, count(*) AS calls, count(*) FILTER (status = 'error') AS failures FROM tool_calls GROUP BY 1) SELECT *, (SELECT sum(calls) FROM t)::BIGINT AS total_calls, (SELECT sum(failures) FROM t)::BIGINT AS total_failures, (SELECT count(*) FROM t) > 10 AS clipped, round(calls / (SELECT sum(calls) FROM t), 9) AS share FROM t ORDER BY calls DESC, tool_name LIMIT 10"),
    "H8_prompt_hygiene": (I.prompt_hygiene, HYGIENE_SQL + " SELECT sum(prompts)::BIGINT AS prompts, sum(short)::BIGINT AS short, sum(no_code)::BIGINT AS no_code, sum(duplicate)::BIGINT AS duplicate, count(*) AS sessions, count(*) FILTER (unstructured) AS unstructured FROM hyg JOIN sessions USING (session_id) WHERE NOT signals_stale"),
    "H9_hot_files": (I.hot_files, _HOT + " SELECT project_id, path, edits, sessions, (SELECT count(*) FROM hot) > 10 AS clipped, display_name AS project FROM hot JOIN projects USING (project_id) ORDER BY edits DESC, project_id, path LIMIT 10"),
    "H10_context": (I.context_distribution, CONTEXT_SQL + " SELECT count(*) AS sessions, quantile_disc(peak_context, 0.5) AS p50, quantile_disc(peak_context, 0.9) AS p90, max(peak_context) AS max, sum(context_resets)::BIGINT AS resets, count(*) FILTER (context_resets > 0) AS sessions_with_reset FROM ctxh"),
    "I1_grid": (I.grid, _GRID + " SELECT bucket::VARCHAR AS bucket, strftime(bucket, '%b %-d') AS label FROM grid"),
    "I2_fleet_mix": (I.fleet_mix, _GRID + _folded(f"SELECT bucket, CASE model WHEN '' THEN 'unknown' ELSE model END AS model, sum({_TOKS}) AS toks FROM du GROUP BY 1, 2 HAVING sum({_TOKS}) > 0", "model", "toks", "~")),
    "I3_newest_model": (I.newest_model, _GRID + f", f AS (SELECT model, min(occurred_at::DATE) AS first, sum({_TOKS}) AS toks FROM ledger WHERE occurred_at IS NOT NULL AND model <> '' GROUP BY 1) SELECT model, first::VARCHAR AS first FROM f WHERE first < TIMESTAMP '{AS_OF}' AND first >= (SELECT min(bucket) FROM grid) + 7 ORDER BY f.first DESC, toks DESC, model LIMIT 1"),
    "I4_grade_trend": (I.grade_trend, _trend("SELECT bucket, " + ", ".join(_pct(f"coalesce(sig_grade, '') = '{k}'", n) for k, n in (("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("F", "f"), ("", "unscored"))) + ", round(avg(CASE sig_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 WHEN 'F' THEN 0 END), 9) AS gpa FROM coh GROUP BY 1", ["a", "b", "c", "d", "f", "unscored"], "gpa")),
    "I5_outcome_trend": (I.outcome_trend, _trend("SELECT bucket, count(*) FILTER (sig_outcome = 'completed') AS completed, count(*) FILTER (sig_outcome = 'abandoned') AS abandoned, count(*) AS total, " + _pct("sig_outcome = 'completed'", "completed_rate") + ", " + _pct("sig_outcome = 'abandoned'", "abandoned_rate") + " FROM coh GROUP BY 1", ["completed", "abandoned", "total", "completed_rate", "abandoned_rate"])),
    "I6_archetype_trend": (I.archetype_trend, _trend("SELECT bucket, " + ", ".join(_pct(f"archetype = '{a}'", a) for a in ("quick", "standard", "deep", "marathon", "automation")) + " FROM coh GROUP BY 1", ["quick", "standard", "deep", "marathon", "automation"])),
    "I7_hygiene_trend": (I.hygiene_trend, _trend("SELECT bucket, " + ", ".join(f"round(100.0 * sum({k}) / sum(prompts), 9) AS {k}" for k in ("short", "no_code", "duplicate")) + ", " + _pct("unstructured", "unstructured") + " FROM coh LEFT JOIN hyg USING (session_id) WHERE NOT signals_stale GROUP BY 1", ["short", "no_code", "duplicate", "unstructured"], extra=HYGIENE_SQL)),
    "I8_context_trend": (I.context_trend, _trend("SELECT bucket, sum(context_resets)::BIGINT AS resets FROM coh JOIN ctxh USING (session_id) GROUP BY 1", ["resets"], extra=CONTEXT_SQL)),
    "I9_context_histogram": (I.context_histogram, CONTEXT_SQL + _GRID + ", o AS (SELECT least(6, greatest(0, floor(log2(greatest(peak_context, 1) / 8000))))::INT AS i, count(*) AS n FROM coh JOIN ctxh USING (session_id) GROUP BY 1) SELECT 8000 * (1::BIGINT << r.i::INT) AS lo, 16000 * (1::BIGINT << r.i::INT) AS hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS i) r LEFT JOIN o ON r.i = o.i"),
    "I10_economics": (I.economics, _trend("SELECT bucket, round(sum(CASE WHEN sig_outcome = 'completed' THEN cost ELSE 0 END), 9) AS cost_completed, round(sum(CASE WHEN sig_outcome = 'abandoned' THEN cost ELSE 0 END), 9) AS cost_abandoned, round(sum(cost), 9) AS cost, round(sum(cache_read) / sum(input + cache_read + cache_write), 9) AS hit_rate, sum(input + cache_read + cache_write) > 0 AS measured FROM du JOIN graded USING (session_id) GROUP BY 1", ["cost_completed", "cost_abandoned", "cost", "hit_rate"], "coalesce(measured, false) AS measured")),
    "I11_savings_trend": (I.savings_trend, _trend("SELECT bucket, round(sum(savings), 9) AS savings FROM du GROUP BY 1", ["savings"])),
    "I12_latency_trend": (I.latency_trend, _trend("SELECT date_trunc('week', prompt_at)::DATE AS bucket, " + ", ".join(f"round(quantile_cont(response_secs, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM session_turns GROUP BY 1", ["p50", "p90", "p99"], extra=TURNS_SQL)),
    "I13_active_trend": (I.active_trend, _trend("SELECT date_trunc('week', day)::DATE AS bucket, round(sum(active_seconds) / 3600, 9) AS active_hours, round(60 * sum(messages) / sum(active_seconds), 9) AS msgs_per_min, round(60 * sum(tool_calls) / sum(active_seconds), 9) AS tools_per_min FROM hourly GROUP BY 1", ["active_hours", "msgs_per_min", "tools_per_min"], extra=HOURLY_SQL)),
    "I14_wall_trend": (I.wall_trend, _trend("SELECT bucket, round(sum(minutes) / 60, 9) AS wall_hours FROM coh GROUP BY 1", ["wall_hours"])),
    "I15_tool_scatter": (I.tool_scatter, _GRID + ", " + _CALLS + " SELECT tool_name, min(category) AS category, sum(calls)::BIGINT AS calls, sum(failures)::BIGINT AS failures, count(DISTINCT session_id) AS sessions FROM ct GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 60"),
    "I16_category_mix": (I.category_mix, _GRID + ", " + _CALLS + _folded("SELECT * FROM ct", "category", "calls", "other")),
    "I17_failure_trend": (I.failure_trend, _trend("SELECT bucket, sum(calls)::BIGINT AS calls, round(100.0 * sum(failures) / sum(calls), 9) AS failure_rate FROM (SELECT bucket, 1 AS calls, CASE WHEN status = 'error' THEN 1 ELSE 0 END AS failures FROM tool_calls JOIN coh USING (session_id)) GROUP BY 1", ["calls", "failure_rate"])),
    "I18_worst_tools": (I.worst_tools, _GRID + ", " + _CALLS + ", wt AS (SELECT tool_name FROM ct GROUP BY 1 HAVING sum(calls) >= 50 AND sum(failures) > 0 ORDER BY sum(failures) DESC, 1 LIMIT 3) SELECT tool_name, bucket::VARCHAR AS bucket, round(100.0 * sum(failures) / sum(calls), 9) AS failure_rate FROM ct WHERE tool_name IN (SELECT tool_name FROM wt) GROUP BY 1, 2"),
    "I19_churn_trend": (I.churn_trend, _trend("SELECT bucket, sum(edits)::BIGINT AS edits, count(*) AS files FROM (SELECT *, sum(edits) OVER (PARTITION BY project_id, churn_path) AS a FROM (SELECT bucket, project_id, churn_path, sum(edits) AS edits FROM churn JOIN coh USING (session_id) GROUP BY 1, 2, 3)) WHERE a > 1 GROUP BY 1", ["edits", "files"], extra=CHURN_SQL)),
    "I20_churn_tree": (I.churn_tree, _HOT + """, top AS (SELECT *, (SELECT sum(edits) FROM hot)::BIGINT AS all_edits, (SELECT count(*) FROM hot) AS all_files FROM hot ORDER BY edits DESC, project_id, path LIMIT 150)
      SELECT CASE kind WHEN 'remote' THEN display_name ELSE concat(display_name, ' (', kind, ')') END AS project, CASE regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN '' THEN '(root)' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder, path, edits, sessions, all_edits, all_files FROM top JOIN projects USING (project_id)"""),
    "I21_gallery": (I.gallery, _GALLERY + " SELECT * FROM gal"),
    "I22_gallery_summary": (I.gallery_summary, _GALLERY + " SELECT count(*) AS sessions, round(quantile_cont(duration_s, 0.5), 6) AS median_duration, round(quantile_cont(cost, 0.5), 6) AS median_cost, round(quantile_cont(duration_s, 0.5) FILTER (outcome = 'completed'), 6) AS median_completed, max([cost, duration_s])[1] AS priciest, max([cost, duration_s])[2] AS priciest_duration FROM gal"),
    "I23_rhythm": (I.rhythm, HOURLY_SQL + ", s AS (SELECT (i // 24)::INT AS weekday, (i % 24)::INT AS hour FROM (SELECT unnest(range(168)) AS i)), c AS (SELECT (isodow(day) - 1)::INT AS weekday, hour::INT AS hour, sum(messages + tool_calls)::BIGINT AS n FROM hourly GROUP BY 1, 2) SELECT s.weekday, s.hour, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (weekday, hour)"),
    "I24_delegation": (I.delegation, _trend("SELECT bucket, " + _pct("k > 0", "share") + ", count(*) FILTER (k = 1) AS one, count(*) FILTER (k BETWEEN 2 AND 3) AS few, count(*) FILTER (k BETWEEN 4 AND 7) AS several, count(*) FILTER (k >= 8) AS many FROM (SELECT bucket, (SELECT count(*) FROM sessions s WHERE s.parent_session_id = c.session_id AND s.relationship_type = 'subagent') AS k FROM coh c WHERE relationship_type = '') GROUP BY 1", ["share", "one", "few", "several", "many"])),
    "I25_subagent_cost": (I.subagent_cost, _trend("SELECT bucket, round(100.0 * sum(CASE WHEN relationship_type = 'subagent' THEN cost ELSE 0 END) / sum(cost), 6) AS share FROM du JOIN sessions USING (session_id) GROUP BY 1", ["share"])),
    "I26_tree_depth": (I.deepest_tree, ", z AS (SELECT session_id, 1 AS depth FROM sessions WHERE parent_session_id IS NULL UNION ALL SELECT s2.session_id, 2 FROM sessions s2 JOIN sessions s1 ON s2.parent_session_id = s1.session_id WHERE s1.parent_session_id IS NULL UNION ALL SELECT s3.session_id, 3 FROM sessions s3 JOIN sessions s2 ON s3.parent_session_id = s2.session_id JOIN sessions s1 ON s2.parent_session_id = s1.session_id) SELECT depth, count(*) AS sessions FROM z GROUP BY 1"),
    "I1_days": (lambda x: I.grid(x, "30d"), f" SELECT strftime(t, '%Y-%m-%d') AS bucket, strftime(t, '%b %-d') AS label FROM (SELECT unnest(generate_series(TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY, TIMESTAMP '{AS_OF}', INTERVAL 1 DAY)) AS t)"),
    "I27_panels": (lambda x: window_values(x, CLOCK), _values(list(_PARTS))),
    "I28_selection": (lambda x: window_values(x, CLOCK, ("churn", "tools", "churn")), _values(["quality", "churn", "tools"])),
}
