"""Session-grain rollups, derived from the projection, and the store that keeps them by session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.operators.project import dedup_calls, relative_path
from loomlog.sources.versions import Version, Versions

IDLE_GAP = 300


def usage_daily(ledger: DataFrame) -> DataFrame:
    """Tokens, cost and savings by (session, UTC day or null, model)."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read", "reasoning", "cost", "savings")]
    return ledger.groupBy("session_id", F.to_date("occurred_at").alias("day"), "model").agg(*sums)


def tool_rollup(tool_calls: DataFrame) -> DataFrame:
    """Calls and failures by (session, tool, category), replays once."""
    category = F.when(F.col("category") == "", "other").otherwise(F.col("category")).alias("category")
    return tool_calls.groupBy("session_id", "tool_name", category).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("failures"))


def file_churn(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """D3: edits by (session, path); the filter comes before the dedup, and the path is relative to cwd where it can be."""
    edits = dedup_calls(calls.where("category = 'edit' AND file_path IS NOT NULL")).join(sessions.select("session_id", "cwd"), "session_id", "left")
    path = F.coalesce(relative_path(F.col("file_path"), F.col("cwd")), "file_path")
    return edits.groupBy("session_id", path.alias("churn_path")).agg(F.count("*").alias("edits"))


def turns(messages: DataFrame) -> DataFrame:
    """A turn runs from a user message to the next; its reply is the first timestamped assistant message."""
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("session_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow))
    by = messages.withColumn("turn", n).where("turn > 0").groupBy("session_id", "turn").agg(
        F.min(F.when(F.col("role") == "user", F.col("ts"))).alias("prompt_at"),
        F.min_by("ts", F.when((F.col("role") == "assistant") & F.col("ts").isNotNull(), F.col("ordinal"))).alias("reply_at"),
    )
    return by.where("reply_at >= prompt_at").select("session_id", "turn", "prompt_at", F.expr("(unix_micros(reply_at) - unix_micros(prompt_at)) / 1e6").alias("response_secs"))


def activity_hourly(messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Messages, tool calls and active seconds by (session, UTC day, hour); pauses over five minutes are not active."""
    w = W.partitionBy("session_id").orderBy("ts", "ordinal")
    timed = messages.where("ts IS NOT NULL").withColumn("gap", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w))
    gap = F.col("gap") / 1e6
    hour = [F.to_date("ts").alias("day"), F.hour("ts").alias("hour")]
    a = timed.groupBy("session_id", *hour).agg(F.count("*").alias("messages"), F.sum(F.when((gap > 0) & (gap <= IDLE_GAP), gap).otherwise(0.0)).alias("active_seconds"))
    owner = messages.select("session_id", F.col("ordinal").alias("message_ordinal"), F.col("ts").alias("mts"))
    b = tool_calls.drop("ts").join(owner, ["session_id", "message_ordinal"]).where("mts IS NOT NULL").withColumnRenamed("mts", "ts").groupBy("session_id", *hour).agg(F.count("*").alias("tool_calls"))
    return a.join(b, ["session_id", "day", "hour"], "left").fillna(0, ["tool_calls"])


class SessionStore:
    """Tables of rows derived from sessions; deriving sessions again writes the rows of these alone.

    An upsert adds a small folder of rows and a list of the sessions they stand for, even those that have no rows any
    more. Readers take, for each session, the rows of the upsert that saw most of it (`seen`, say the bytes of its log;
    the later one of equals), and the base's for all others. After `fold` upserts of a table they are folded into a new
    base, sorted by session, so that a session lies in few files. Versions are published whole: a reader never sees
    half of an upsert, and of two writers at a time none is lost.
    """

    SPINE = "session_id long, seen long"

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], fold: int = 8, sort: dict[str, str] | None = None):
        """sort names the column that a table's base is sorted by, where that is not session_id, say the key of an index."""
        self.spark, self.schemas, self.fold, self.sort = spark, schemas, fold, sort or {}
        self.versions = Versions(spark, path, {**schemas, "sessions": self.SPINE, **{f"{t}@": self.SPINE for t in schemas}})

    def _latest(self, table: str, version: Version) -> DataFrame | None:
        """(session_id, seen, k): which upsert after the base counts for a session; none if the base has seen more."""
        deltas = [p for p in version.parts.get(f"{table}@", []) if p[0] == 0]
        spines = [self.versions.read(f"{table}@", Version(0, {f"{table}@": [p]})).withColumn("k", F.lit(i)) for i, p in enumerate(deltas)]
        if not spines:
            return None
        best = reduce(DataFrame.unionAll, spines).groupBy("session_id").agg(F.max(F.struct("seen", "k")).alias("x")).select("session_id", "x.*")
        base = self.versions.read(f"{table}@", version, level=1).withColumnRenamed("seen", "held")
        return best.join(base, "session_id", "left").where("seen >= coalesce(held, 0)").drop("held")

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        version = version or self.versions.current()
        base, latest = self.versions.read(table, version, level=1), self._latest(table, version)
        if latest is None:
            return base
        parts = [p for p in version.parts[table] if p[0] == 0]
        rows = reduce(DataFrame.unionAll, [self.versions.read(table, Version(0, {table: [p]})).withColumn("k", F.lit(i)) for i, p in enumerate(parts)])
        own = base.columns
        return base.join(latest, "session_id", "left_anti").select(own).unionByName(rows.join(latest, ["session_id", "k"], "left_semi").select(own))

    def _folded(self, table: str, parts: dict) -> dict:
        """Rows and sessions of a table as one base."""
        version = Version(0, parts)
        by = self.sort.get(table, "session_id")
        rows = self.read(table, version).repartitionByRange(by).sortWithinPartitions(by)
        spine = self.versions.read(f"{table}@", version).groupBy("session_id").agg(F.max("seen").alias("seen"))
        return {table: [(1, self.versions.write(table, rows))], f"{table}@": [(1, self.versions.write("sessions", spine))]}

    def upsert(self, changed: DataFrame, derived: dict[str, DataFrame], attempts: int = 50) -> Version:
        """Make derived rows count for the sessions of changed(session_id, and seen if it has it), in the tables that derived names."""
        seen = F.col("seen") if "seen" in changed.columns else F.lit(0)
        spine = self.versions.write("sessions", changed.groupBy("session_id").agg(F.max(seen.cast("long")).alias("seen")))
        fresh = {}
        for t, df in derived.items():
            rows, by = df.selectExpr(*self._columns(t)), self.sort.get(t)
            fresh[t] = self.versions.write(t, rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows)
        for _ in range(attempts):
            version = self.versions.current()
            parts = {}
            for t, folder in fresh.items():
                old, spines = version.parts.get(t, []), version.parts.get(f"{t}@", [])
                parts |= {t: [*old, (0, folder)], f"{t}@": [*spines, (0, spine)]} if old else {t: [(1, folder)], f"{t}@": [(1, spine)]}
                if len(parts[f"{t}@"]) > self.fold:
                    parts |= self._folded(t, parts)
            new = self.versions.publish(version, parts)
            if new:
                return new
        raise RuntimeError(f"other writers published first {attempts} times")

    def _columns(self, table: str) -> list[str]:
        fields = self.spark.createDataFrame([], self.schemas[table]).schema.fields
        return [f"cast(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields]

    def last_written(self, table: str) -> int:
        """Rows in the folder that the last upsert of a table added; for proof."""
        return self.versions.read(table, Version(0, {table: self.versions.current().parts[table][-1:]})).count()


def derived(ledger: DataFrame, calls: DataFrame, messages: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """D1-D5 of the given rows."""
    own = dedup_calls(calls)
    return {"usage_daily": usage_daily(ledger), "tool_rollup": tool_rollup(own), "file_churn": file_churn(calls, sessions), "turns": turns(messages), "activity_hourly": activity_hourly(messages, own)}
