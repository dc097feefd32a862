"""Queues of sessions: places in order over many ranges, and jobs whose number does not grow with the pages."""

from datetime import datetime

from pyspark.sql import functions as F

from loomlog.operators import rollups
from loomlog.sources.appendlog import AppendLog
from loomlog.streaming import settle
from loomlog.streaming.drain import Drain
from loomlog.streaming.queue import ROUNDS, Queue


def test_places_follow_the_order_over_ranges(spark):
    rows = spark.range(0, 3000, 1, 7).selectExpr("id AS session_id", "IF(id % 5 = 0, NULL, id * 7919 % 1000) AS at")
    want = [r["session_id"] for r in rows.orderBy(F.col("at").asc_nulls_last(), "session_id").collect()]
    with Queue(rows, [F.col("at").asc_nulls_last(), "session_id"]) as q:
        assert q.size == 3000 and set(map(tuple, q.between(700, 1900).select("session_id").collect())) == {(i,) for i in want[700:1900]}
        assert [e - s for s, e in q.rounds(7)] == [756, 756, 756, 732] and q.pages(7, 0, 20) == [7, 7, 6]
    with Queue(rows.limit(0), ["session_id"]) as q:
        assert q.size == 0 and list(q.rounds(7)) == [] and q.pages(7) == []


def test_jobs_of_a_drain_do_not_grow_with_its_pages(spark, tmp_path):
    log, asked = AppendLog(spark, str(tmp_path / "log")), []
    log.append(spark.range(40).selectExpr("id AS session_id", "0L AS seq", "0L AS byte_offset", "concat('line ', id, '\n') AS data"))

    def derive(lines):
        asked.append(1)
        return {"sizes": lines.groupBy("session_id").agg(F.count("*").alias("lines"))}

    d = Drain(log, str(tmp_path / "store"), {"sizes": "session_id long, lines long"}, derive, page=2)
    assert d.run(lambda: datetime(2026, 5, 1)) == 40 and d.pages == [2] * 20 and d.store.read("sizes").count() == 40
    assert len(asked) <= ROUNDS


def test_jobs_of_grading_do_not_grow_with_its_pages(spark, tmp_path):
    store, asked = rollups.SessionStore(spark, str(tmp_path / "graded"), {"signals": "session_id long, score int"}), []
    stale = spark.range(30).selectExpr("id AS session_id", "timestamp_seconds(id * 77 % 30) AS ended_at")

    def grade(ids):
        asked.append(1)
        return ids.select("session_id", F.lit(1).alias("score"))

    assert settle.grade_stale(stale, grade, store, "signals", page=2) == [2] * 15
    assert store.read("signals").count() == 30 and len(asked) <= ROUNDS and settle.grade_stale(stale, grade, store, "signals") == []
