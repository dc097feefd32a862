"""Session feed, search, facets and trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.operators.signals import current
from loomlog.operators.trees import subtree_sums
from loomlog.sources.views import Inputs

SORTS = {"project": "project_id", "agent": "agent", "branch": "git_branch", "user": "user_id", "messages": "message_count", "tokens": "tokens", "cost": "cost", "updated": "ended_at"}
SNIPPET, BEFORE, LONG = 160, 240, 720


@dataclass(frozen=True)
class Feed:
    """What narrows the feed. Empty sessions and subagents are hidden unless asked for."""

    project_id: int | None = None
    agent: str | None = None
    machine: str | None = None
    user_id: int | None = None
    since: str | None = None
    grade: str | None = None
    outcome: str | None = None
    search: str | None = None
    empty: bool = False
    subagents: bool = False


def matching(x: Inputs, f: Feed) -> DataFrame:
    """Sessions of the feed; a drill on 'unscored' or 'unknown' takes missing and stale signals too."""
    s = x.sessions
    for column in ("project_id", "agent", "machine", "user_id"):
        value = getattr(f, column)
        s = s if value is None else s.where(F.col(column) == value)
    s = s if f.since is None else s.where(F.col("ended_at") >= F.lit(f.since).cast("timestamp"))
    s = s if f.empty else s.where("message_count > 0")
    s = s if f.subagents else s.where("relationship_type <> 'subagent'")
    for value, column, nothing in ((f.grade, "sig_grade", "unscored"), (f.outcome, "sig_outcome", "unknown")):
        if value is not None:
            known = current(x).select("session_id", F.coalesce(column, F.lit("")).alias("v"))
            if value == nothing:
                s = s.join(known.where(~F.col("v").isin("", nothing)).select("session_id"), "session_id", "left_anti")
            else:
                s = s.join(known.where(F.col("v") == value).select("session_id"), "session_id", "left_semi")
    return s if f.search is None else s.join(search(x, f.search).select("session_id"), "session_id", "left_semi")


def grams(messages: DataFrame) -> DataFrame:
    """(session_id, gram): hashes of the runs of three letters, in lower case, that a session's messages hold; once each."""
    letters = messages.select("session_id", F.split(F.lower("content"), "").alias("c"))
    runs = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.xxhash64(F.element_at("c", i), F.element_at("c", i + 1), F.element_at("c", i + 2)))
    return letters.where(F.size("c") > 2).select("session_id", F.explode(F.array_distinct(runs)).alias("gram")).distinct()


def _candidates(x: Inputs, needle: str, asked: int = 8, used: int = 4) -> DataFrame | None:
    """Sessions that hold the rarest of some runs of the needle, out of the index; None for needles that are too short for it.

    The index is sorted by gram, so the few grams that are asked for are read from the row groups that hold them.
    """
    runs = sorted(r["gram"] for r in grams(x.spark.createDataFrame([(0, needle)], "session_id long, content string")).collect())
    if not runs:
        return None
    hashes = runs[:asked]  # in the order of hashes, so as good as drawn
    count = {r["gram"]: r["n"] for r in x.grams.where(F.col("gram").isin(hashes)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rarest = sorted(hashes, key=lambda h: count.get(h, 0))[:used]
    return x.grams.where(F.col("gram").isin(rarest)).groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("session_id")


def search(x: Inputs, text: str) -> DataFrame:
    """Messages that hold the text literally, whatever its case; at most its first 200 bytes count.

    Sessions are looked up in an index of trigrams, which follows its messages session by session, and their messages
    are then compared as a whole. Needles of one or two letters compare all messages.
    """
    needle = text.encode()[:200].decode(errors="ignore").lower()
    held = _candidates(x, needle)
    messages = x.messages if held is None else x.messages.join(held, "session_id", "left_semi")
    return messages.where(F.lower("content").contains(needle)).withColumn("at", F.locate(needle, F.lower("content")))


def snippets(x: Inputs, text: str) -> DataFrame:
    """A window around the first match of each session, blanks squeezed, with ellipses where it is cut."""
    hit = search(x, text).groupBy("session_id").agg(F.min_by(F.struct("content", "at"), "ordinal").alias("m")).select("session_id", "m.*")
    start = F.greatest(F.lit(1), F.col("at") - (SNIPPET - len(text)) // 2)
    cut = F.substring("content", start, F.lit(SNIPPET))
    body = F.trim(F.regexp_replace(cut, r"\s+", " "))
    return hit.select("session_id", F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + SNIPPET <= F.char_length("content"), "…").otherwise("")).alias("snippet"))


def titles(x: Inputs, of: DataFrame | None = None) -> DataFrame:
    """The session's own title, else its first user message without a leading <...>...</...> wrapper, 240 letters.

    of: (session_id) of the few sessions that are asked for; their messages alone are read into the aggregate.
    """
    messages, asked = (x.messages, x.sessions) if of is None else (t.join(F.broadcast(of.select("session_id")), "session_id", "left_semi") for t in (x.messages, x.sessions))
    first = messages.where("role = 'user' AND content <> ''").groupBy("session_id").agg(F.min_by("content", "ordinal").alias("c"))
    text = F.left(F.trim(F.regexp_replace(F.regexp_replace("c", r"^\s*<([a-z-]+)>[^<]*</[a-z-]+>\s*", ""), r"\s+", " ")), F.lit(240))
    return asked.select("session_id", "title").join(first, "session_id", "left").select("session_id", F.coalesce("title", text, F.lit("")).alias("title"))


def with_totals(x: Inputs, s: DataFrame) -> DataFrame:
    t = x.usage_daily.groupBy("session_id").agg(F.sum(F.expr("input + output + cache_read + cache_write")).alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"))
    return s.join(t, "session_id", "left").fillna(0, ["tokens", "cost"])


def page(df: DataFrame, sort: str = "updated", descending: bool = True, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """Rows of one page plus one, which tells that more follow; strictly after (value, id) of the last row seen."""
    if sort not in SORTS or not 1 <= limit <= 200:
        raise ValueError(f"sort is one of {sorted(SORTS)}, limit from 1 to 200")
    key = F.col(SORTS[sort])
    if after is not None:
        value, last = F.lit(after[0]).cast(df.schema[SORTS[sort]].dataType), after[1]
        beyond = key < value if descending else key > value
        df = df.where(beyond | ((key == value) & (F.col("session_id") < last if descending else F.col("session_id") > last)))
    order = [key.desc_nulls_last(), F.desc("session_id")] if descending else [key.asc_nulls_last(), F.asc("session_id")]
    return df.orderBy(*order).limit(limit + 1)


def feed(x: Inputs, f: Feed = Feed(), **paging) -> DataFrame:
    """The global feed; titles are joined to the page's rows only."""
    rows = page(with_totals(x, matching(x, f)), **paging)
    cols = ["session_id", "project_id", "user_id", "agent", "message_count", "tokens", "cost", "ended_at"]
    return rows.select(*cols).join(titles(x, rows), "session_id")


def id_feed(x: Inputs, before: int | None = None, limit: int = 100) -> DataFrame:
    """Newest ids first, below a cursor."""
    s = x.sessions if before is None else x.sessions.where(F.col("session_id") < before)
    return s.orderBy(F.desc("session_id")).limit(limit + 1).select("session_id", "agent")


def recency(x: Inputs, limit: int = 20, offset: int = 0) -> DataFrame:
    """Last active first."""
    return x.sessions.orderBy(F.col("ended_at").desc_nulls_last(), F.desc("session_id")).offset(offset).limit(limit).select("session_id", "ended_at")


def counts(x: Inputs) -> DataFrame:
    """Sessions, and how many are empty."""
    return x.sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("message_count") == 0).alias("empty"))


def tree_rollup(x: Inputs) -> DataFrame:
    """Size and cost of the subtree of subagents below every session, itself included."""
    cost = x.usage_daily.groupBy(F.col("session_id").alias("node")).agg(F.sum("cost").alias("cost"))
    nodes = x.sessions.select(F.col("session_id").alias("node"), F.when(F.col("relationship_type") == "subagent", F.col("parent_session_id")).alias("up"), F.lit(1).cast("long").alias("sessions"))
    out = subtree_sums(nodes.join(cost, "node", "left").fillna(0.0, ["cost"]), ["sessions", "cost"])
    return out.select(F.col("node").alias("session_id"), "sessions", F.round("cost", 9).alias("cost"))


def window_page(x: Inputs, since: str, until: str, n: int = 100) -> DataFrame:
    """The last active sessions of a window, and one row for the remainder, so that the rows add up to the headline."""
    inside = (F.col("occurred_at") >= F.lit(since).cast("timestamp")) & (F.col("occurred_at") < F.lit(until).cast("timestamp"))
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")]
    by = x.ledger.where(inside).groupBy("session_id").agg(*sums, F.sum("cost").alias("cost"), F.max("occurred_at").alias("last"))
    top = by.orderBy(F.desc("last"), F.desc("session_id")).limit(n)
    edge = top.agg(F.min(F.struct("last", "session_id")).alias("edge"))
    tagged = by.join(F.broadcast(edge), F.struct("last", "session_id") >= F.col("edge"), "left")
    key = F.when(F.col("edge").isNotNull(), F.col("session_id"))
    return tagged.groupBy(key.alias("session_id")).agg(F.count("*").alias("sessions"), *sums, F.round(F.sum("cost"), 9).alias("cost"))


def facets(x: Inputs, n: int = 50) -> DataFrame:
    """The most frequent values of each kind, with their label."""
    from loomlog.operators.project import facet_counts

    top = facet_counts(x.sessions).withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("sessions"), "key"))).where(F.col("r") <= n)
    names = x.users.select(F.lit("user_id").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("username").alias("label"))
    names = names.unionAll(x.projects.select(F.lit("project_id"), F.col("project_id").cast("string"), "display_name"))
    return top.join(names, ["kind", "key"], "left").select("kind", "key", "sessions", F.coalesce("label", "key").alias("label"))


def project_facets(x: Inputs, project_id: int) -> DataFrame:
    """Distinct agents, machines and branches of a project."""
    s = x.sessions.where(F.col("project_id") == project_id)
    return s.select(F.stack(F.lit(3), *[c for k in ("agent", "machine", "git_branch") for c in (F.lit(k), F.col(k))]).alias("kind", "value")).distinct()


def projects_index(x: Inputs) -> DataFrame:
    """Every project with its sessions, cost and last activity; projects without any come last."""
    by = with_totals(x, x.sessions).groupBy("project_id").agg(F.count("*").alias("sessions"), F.round(F.sum("cost"), 9).alias("cost"), F.max("ended_at").alias("last_active"))
    return x.projects.join(by, "project_id", "left").fillna(0, ["sessions", "cost"]).orderBy(F.col("last_active").desc_nulls_last(), "project_id")


def published(x: Inputs) -> DataFrame:
    """J17."""
    return x.sessions.where("published").join(x.projects, "project_id").select("session_id", "display_name").orderBy(F.lower("display_name"), "session_id")


_TOT = ", tot AS (SELECT session_id, sum(input + output + cache_read + cache_write)::BIGINT AS tokens, round(sum(cost), 9) AS cost FROM ledger GROUP BY 1), st AS (SELECT s.*, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost FROM sessions s LEFT JOIN tot USING (session_id))"
_TITLE = r", ti AS (SELECT s.session_id, coalesce(s.title, left(trim(regexp_replace(regexp_replace(c, '^\s*<([a-z-]+)>[^<]*</[a-z-]+>\s*', ''), '\s+', ' ', 'g')), 240), '') AS title FROM sessions s LEFT JOIN (SELECT session_id, arg_min(content, ordinal) AS c FROM messages WHERE role = 'user' AND content <> '' GROUP BY 1) USING (session_id))"
_FEED = "session_id, project_id, user_id, agent, message_count, tokens, cost, ended_at, title"
_VISIBLE = "message_count > 0 AND relationship_type <> 'subagent'"
_NEEDLE = "the tion"


def _feed_sql(where: str, order: str, limit: int = 51) -> str:
    return _TOT + _TITLE + f" SELECT {_FEED} FROM (SELECT * EXCLUDE (title) FROM st WHERE {_VISIBLE} AND {where} ORDER BY {order} LIMIT {limit}) JOIN ti USING (session_id)"


QUERIES = {
    "J1_filtered": (lambda x: matching(x, Feed(project_id=4, agent="high", since="2024-01-01 00:00:00")).select("session_id"), f" SELECT session_id FROM sessions WHERE {_VISIBLE} AND project_id = 4 AND agent = 'high' AND ended_at >= TIMESTAMP '2024-01-01'"),
    "J2_grade_drill": (lambda x: matching(x, Feed(grade="B", empty=True, subagents=True)).select("session_id"), " SELECT session_id FROM graded WHERE sig_grade = 'B'"),
    "J2_unknown_drill": (lambda x: matching(x, Feed(outcome="unknown", empty=True, subagents=True)).agg(F.count("*").alias("n")), " SELECT count(*) AS n FROM graded WHERE coalesce(sig_outcome, 'unknown') = 'unknown'"),
    "J3_search": (lambda x: search(x, _NEEDLE).groupBy("session_id").agg(F.count("*").alias("hits")), f" SELECT session_id, count(*) AS hits FROM messages WHERE contains(lower(content), '{_NEEDLE}') GROUP BY 1"),
    "J4_snippet": (lambda x: snippets(x, "the"), rf""", m AS (SELECT session_id, arg_min(content, ordinal) AS c FROM messages WHERE contains(lower(content), 'the') GROUP BY 1), w AS (SELECT *, greatest(1, position('the' IN lower(c)) - 78) AS s FROM m)
      SELECT session_id, concat(CASE WHEN s > 1 THEN '…' ELSE '' END, trim(regexp_replace(substring(c, s, 160), '\s+', ' ', 'g')), CASE WHEN s + 160 <= length(c) THEN '…' ELSE '' END) AS snippet FROM w"""),
    "J5_titles": (titles, _TITLE + " SELECT * FROM ti"),
    "J6_sort_cost": (lambda x: feed(x, sort="cost"), _feed_sql("true", "cost DESC NULLS LAST, session_id DESC")),
    "J7_keyset": (lambda x: feed(x, sort="messages", descending=False, after=(100, 1200)), _feed_sql("(message_count > 100 OR (message_count = 100 AND session_id > 1200))", "message_count, session_id")),
    "J8_feed": (feed, _feed_sql("true", "ended_at DESC NULLS LAST, session_id DESC")),
    "J9_id_feed": (lambda x: id_feed(x, 9000), " SELECT session_id, agent FROM sessions WHERE session_id < 9000 ORDER BY 1 DESC LIMIT 101"),
    "J10_recency": (lambda x: recency(x, 20, 40), " SELECT session_id, ended_at FROM sessions ORDER BY ended_at DESC NULLS LAST, session_id DESC LIMIT 20 OFFSET 40"),
    "J11_counts": (counts, " SELECT count(*) AS sessions, count(*) FILTER (message_count = 0) AS empty FROM sessions"),
    "J12_tree_rollup": (tree_rollup, ", k AS (SELECT parent_session_id AS p, session_id AS k FROM sessions WHERE relationship_type = 'subagent'), p AS (SELECT session_id AS root, session_id FROM sessions UNION ALL SELECT p, k FROM k UNION ALL SELECT a.p, b.k FROM k a JOIN k b ON a.k = b.p), c AS (SELECT session_id, sum(cost) AS cost FROM ledger GROUP BY 1) SELECT root AS session_id, count(*) AS sessions, round(coalesce(sum(cost), 0), 9) AS cost FROM p LEFT JOIN c USING (session_id) GROUP BY 1"),
    "J13_window_page": (lambda x: window_page(x, "2024-01-01 00:00:00", "2025-01-01 00:00:00"), """, b AS (SELECT session_id, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(cost) AS cost,
      row_number() OVER (ORDER BY max(occurred_at) DESC, session_id DESC) AS r FROM ledger WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2025-01-01' GROUP BY 1)
      SELECT CASE WHEN r <= 100 THEN session_id END AS session_id, count(*) AS sessions, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum(cost), 9) AS cost FROM b GROUP BY 1"""),
    "J14_facets": (facets, ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c}::VARCHAR AS key, count(*) AS sessions FROM sessions GROUP BY 2" for c in ("agent", "machine", "user_id", "project_id")) + "), n AS (SELECT 'user_id' AS kind, user_id::VARCHAR AS key, username AS label FROM users UNION ALL SELECT 'project_id', project_id::VARCHAR, display_name FROM projects), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sessions DESC, key) AS r FROM c) SELECT r.kind, r.key, sessions, coalesce(label, r.key) AS label FROM r LEFT JOIN n ON r.kind = n.kind AND r.key = n.key WHERE r <= 50"),
    "J15_project_facets": (lambda x: project_facets(x, 3), " " + " UNION ".join(f"SELECT '{c}' AS kind, {c} AS value FROM sessions WHERE project_id = 3" for c in ("agent", "machine", "git_branch"))),
    "J16_projects": (projects_index, _TOT + " SELECT p.*, coalesce(sessions, 0) AS sessions, coalesce(cost, 0) AS cost, last_active FROM projects p LEFT JOIN (SELECT project_id, count(*) AS sessions, round(sum(cost), 9) AS cost, max(ended_at) AS last_active FROM st GROUP BY 1) USING (project_id)"),
    "J17_published": (published, " SELECT session_id, display_name FROM sessions JOIN projects USING (project_id) WHERE published"),
}
