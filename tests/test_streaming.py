"""Settling with timers that survive a restart, grading on time, and the drain by pages."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.operators import rollups, signals
from loomlog.sources.appendlog import AppendLog
from loomlog.sources.views import Inputs
from loomlog.streaming import settle
from loomlog.streaming.drain import Drain, Unparsable


def until(test, seconds=90):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.3)
    return test()


def test_quiet_sessions_settle_new_lines_arm_again_and_restarts_keep_timers(spark, tmp_path):
    src, ck, out = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")
    add = lambda *ids: spark.createDataFrame([(i,) for i in ids], "session_id long").coalesce(1).write.mode("append").parquet(src)
    add(1, 1, 2)
    stream = spark.readStream.schema("session_id long").parquet(src)
    start = lambda quiet: settle.settled(stream, quiet).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").start()
    got = lambda: sorted(map(tuple, spark.read.schema("session_id long, lines long").parquet(out).collect())) if (tmp_path / "out").exists() else []
    query = start(20_000)
    assert until(lambda: any(p["numInputRows"] for p in query.recentProgress), 60)
    query.stop()
    timers = {r["session_id"]: r["expires_ms"] for r in settle.armed(spark, ck).collect()}
    assert set(timers) == {1, 2} and got() == [] and all(t > time.time() * 1000 - 60_000 for t in timers.values())
    query = start(1_000)  # the timers of the first run stand, no line comes
    try:
        assert until(lambda: len(got()) == 2) and got() == [(1, 2), (2, 1)]
        add(1)
        assert until(lambda: len(got()) == 3) and got() == [(1, 1), (1, 2), (2, 1)]
    finally:
        query.stop()
    assert settle.armed(spark, ck).count() == 0


def test_settled_sessions_are_graded_as_in_batch(spark, tiny, tmp_path):
    x, src = Inputs(spark, tiny), str(tmp_path / "in")
    lines = x.messages.where("session_id < 40").select("session_id", "ordinal")
    lines.where("session_id % 2 = 0").coalesce(1).write.parquet(src)
    columns = ["session_id", "outcome", "confidence", "score", "grade"]
    grade = lambda ids: signals.session_signals(Inputs(spark, tiny, ids)).select(columns)
    store = rollups.SessionStore(spark, str(tmp_path / "store"), {"signals": "session_id long, outcome string, confidence string, score int, grade string"})
    query = settle.grade_settled(spark.readStream.schema("session_id long, ordinal long").parquet(src), grade, store, "signals", str(tmp_path / "ck"), quiet_ms=500)
    want = lambda only: sorted(map(tuple, grade(lines.where(only).select("session_id").distinct()).collect()))
    got = lambda: sorted(map(tuple, store.read("signals").select(columns).collect()))
    try:
        even = want("session_id % 2 = 0")
        assert even and until(lambda: len(got()) == len(even)) and got() == even
        lines.where("session_id % 2 = 1 OR session_id = 2").coalesce(1).write.mode("append").parquet(src)
        everything = want("true")
        assert until(lambda: len(got()) == len(everything)) and got() == everything
    finally:
        query.stop()


@pytest.fixture
def log(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "log"))
    log.append(spark.range(20).selectExpr("id AS session_id", "0L AS seq", "0L AS byte_offset", "concat('line ', id, '\n\n  two \n') AS data"))
    return log


def counted(lines):
    return {"sizes": lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.max("byte_offset").alias("last"))}


SIZES = {"sizes": "session_id long, lines long, last long"}


def sizes(drain):
    return {r["session_id"]: (r["lines"], r["last"]) for r in drain.store.read("sizes").collect()}


def test_drain_by_pages_failures_wait_while_others_pass(spark, log, tmp_path):
    now, broken = datetime(2026, 5, 1, 12), {8, 14}

    def derive(lines):
        return counted(lines.withColumn("line", F.when(F.col("session_id").isin(list(broken)), F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
                       .where("line <> 'never'"))

    d = Drain(log, str(tmp_path / "store"), SIZES, derive, page=8)
    assert d.run(lambda: now) == 18 and d.pages == [8, 8, 4] and set(sizes(d)) == set(range(20)) - broken
    assert sizes(d)[7] == (2, 8) and d.run(lambda: now + timedelta(seconds=29)) == 0
    again = Drain(log, str(tmp_path / "store"), SIZES, derive, page=8)  # a new process: nothing is lost, nothing is done twice
    broken.discard(8)
    assert again.run(lambda: now + timedelta(seconds=31)) == 1 and set(sizes(again)) == set(range(20)) - {14}
    assert [tuple(r) for r in again.state().where("retry_at IS NOT NULL").select("session_id", "failures", F.col("retry_at").cast("string")).collect()] == [(14, 2, "2026-05-01 12:01:31")]
    log.append(spark.createDataFrame([(5, 1, 15, b"more\n"), (14, 1, 16, b"more\n")], "session_id long, seq long, byte_offset long, data binary"))
    broken.clear()
    assert again.run(lambda: now + timedelta(seconds=32)) == 1 and sizes(again)[5] == (3, 15)  # 14 still waits for its retry
    assert again.run(lambda: now + timedelta(hours=1)) == 1 and sizes(again)[14] == (3, 16)


def test_drain_wakes_at_appends_pins_the_unparsable_and_rebuilds_by_epoch(spark, log, tmp_path):
    asked = []

    def derive(lines):
        ids = [r["session_id"] for r in lines.select("session_id").distinct().collect()]
        asked.append(ids)
        if 9 in ids:
            raise Unparsable
        return counted(lines)

    d = Drain(log, str(tmp_path / "store"), SIZES, derive)
    d.stream(str(tmp_path / "ck")).awaitTermination()
    assert set(sizes(d)) == set(range(20)) - {9} and d.run() == 0
    log.append(spark.createDataFrame([(3, 1, 15, b"x\n")], "session_id long, seq long, byte_offset long, data binary"))
    asked.clear()
    d.stream(str(tmp_path / "ck")).awaitTermination()
    assert asked == [[3]] and sizes(d)[3] == (3, 15)
    nxt = Drain(log, str(tmp_path / "store"), SIZES, counted, epoch=2)
    assert nxt.run() == 20 and set(sizes(nxt)) == set(range(20))
