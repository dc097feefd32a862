"""Raw lines, remotes, retries and incremental derivation on hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.operators import insights, project, rollups, sessions
from loomlog.operators.analytics import ASSEMBLED, Snapshots
from loomlog.operators.quantiles import quantiles
from loomlog.operators.windows import window_values
from loomlog.sources import raw, shared
from loomlog.sources.views import Inputs
from loomlog.streaming import rederive


def test_lines_keep_byte_offsets(spark):
    df = spark.createDataFrame([(1, 'é a\n\n  {"k": 1} \nlast'), (2, ""), (3, None)], "k int, text string")
    assert sorted(map(tuple, raw.lines_with_offsets(df, "k", "text").collect())) == [(1, 0, "é a"), (1, 6, '{"k": 1}'), (1, 18, "last")]


def test_gaps(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 5), (2, 0, 5), (2, 7, 5), (3, 1, 5)], "session_id int, byte_offset long, bytes long")
    assert sorted(tuple(r) for r in raw.gaps(df).collect()) == [(1, 2, 10, 0), (2, 2, 10, 1), (3, 1, 5, 1)]


@pytest.mark.parametrize(
    ("remote", "want"),
    [
        ("git@github.com:Owner/Repo.git", "github.com/owner/repo"), ("https://user:pw@GitHub.com:443/Owner/Repo.git/", "github.com/owner/repo"),
        ("ssh://git@Example.org:2222/Team/Sub/Repo.git", "example.org:2222/Team/Sub/Repo"), ("ssh://git@example.org:22/Team/Repo", "example.org/Team/Repo"), ("/local/path", None), ("", None),
    ],
)
def test_remotes(spark, remote, want):
    assert spark.range(1).select(raw.canonical_remote(F.lit(remote))).first()[0] == want


def test_backoff(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 8, 99)], "n int").orderBy("n").select(rederive.backoff_seconds(F.col("n"))).collect()
    assert [r[0] for r in got] == [30, 60, 120, 3600, 3600]


def test_due(spark):
    rows = [
        ("new bytes", 9, 5, 3, None, None, None), ("old epoch", 5, 5, 2, None, None, None), ("done", 5, 5, 3, None, None, None), ("pinned", 9, 5, 2, 3, 9, None),
        ("pinned, new bytes", 10, 5, 2, 3, 9, None), ("waits", 9, 5, 2, None, None, 200), ("retry", 9, 5, 2, None, None, 100),
    ]
    df = spark.createDataFrame(rows, "s string, raw_bytes long, parsed_bytes long, epoch int, failed_epoch int, failed_bytes long, retry_at long")
    assert {r["s"] for r in rederive.due(df, 3, F.lit(150)).collect()} == {"new bytes", "old epoch", "pinned, new bytes", "retry"}


def test_null_keys_stay_in_usage_dedup(spark):
    schema = "session_id long, dedup_key string, source_offset long, source_index long, model string, input long, output long, occurred_at timestamp"
    df = spark.createDataFrame([(1, None, 0, 0, "m", 1, 1, None), (1, None, 0, 0, "m", 1, 1, None), (1, "", 1, 0, "m", 1, 1, None), (1, "k", 2, 0, "m", 1, 1, None), (1, "k", 3, 0, "m", 2, 1, None)], schema)
    assert sorted((r["dedup_key"] or "", r["source_offset"]) for r in project.dedup_usage(df).collect()) == [("", 0), ("", 0), ("", 1), ("k", 2)]


def test_discovery(spark, tmp_path):
    for name, text in (("a/rollout-1.jsonl", "x\n"), ("a/b/rollout-2.jsonl", "y\n"), ("a/other.jsonl", "x\n"), ("a/rollout-3.txt", "x\n"), ("a/rollout-4.jsonl", ""), ("a/old/c/rollout-5.jsonl", "x\n"), ("a/tmp-1/rollout-6.jsonl", "x\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(raw.discover(spark, str(tmp_path), "format_b")) == ["rollout-1.jsonl", "rollout-2.jsonl", "rollout-5.jsonl", "rollout-6.jsonl"]
    assert names(raw.discover(spark, str(tmp_path), "format_b", exclude=("old", "tmp-?"))) == ["rollout-1.jsonl", "rollout-2.jsonl"]
    assert names(raw.discover(spark, str(tmp_path / "a"), "format_a", exclude=("**/c/*", "rollout-[12].jsonl", "b/**"))) == ["other.jsonl", "rollout-1.jsonl", "rollout-6.jsonl"]
    files, notices = raw.discover_all(spark, {"format_a": str(tmp_path / "a"), "format_b": "/no/such/root"}, env={"format_a": str(tmp_path / "a/b"), "format_c": ""})
    assert names(files) == ["rollout-2.jsonl"] and notices == ["format_b: no folder /no/such/root"]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_lines_of_files_by_byte_ranges(spark, tmp_path, size):
    """Ranges cut lines anywhere; offsets are those of the raw bytes, with and without a last line end, a mark or blank lines."""
    rng = random.Random(size)
    line = lambda: rng.choice(["", " ", '{"n":1}', "é" * rng.randrange(30), "x" * rng.randrange(90), "a\r"])
    want = {}
    for i in range(12):
        data = ("\n".join(line() for _ in range(rng.randrange(1, 30))) + rng.choice(["", "\n"])).encode()
        data = b"\xef\xbb\xbf" * (i % 4 == 1) + data
        (tmp_path / f"{i}.jsonl").write_bytes(data)
        at = 0
        for raw_line in data.split(b"\n"):
            said = raw_line.removeprefix(b"\xef\xbb\xbf").decode().strip(" \r")
            if said:
                want[f"{i}.jsonl", at] = said
            at += len(raw_line) + 1
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r["session_id"].rsplit("/", 1)[1], r["byte_offset"]): r["line"] for r in raw.file_lines(spark, str(tmp_path), "format_a").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_lines_are_stripped_of_ascii_blanks_alone(spark):
    df = spark.createDataFrame([(1, " a \x85\n b \u2028"), (2, "c \r\n")], "k int, text string")
    assert sorted(r["line"] for r in raw.lines_with_offsets(df, "k", "text").collect()) == ["a \x85", "b \u2028", "c"]


def test_upserts_write_their_sessions_alone(spark, tmp_path):
    store = rollups.SessionStore(spark, str(tmp_path / "rollups"), {"turns": "session_id long, n long", "file_churn": "session_id long, n long"}, fold=3)
    rows = lambda data: spark.createDataFrame(data, "session_id long, n long")
    both = lambda df: {"turns": df, "file_churn": df}
    got = lambda t="turns": sorted(map(tuple, store.read(t).collect()))
    assert got() == []
    store.upsert(rows([(i, 0) for i in range(20)]).select("session_id"), both(rows([(i, 1) for i in range(20)] * 2)))
    store.upsert(rows([(3, 0), (4, 0)]).select("session_id"), both(rows([(3, 2)])))  # 4 has no rows any more
    assert store.last_written("turns") == 1 and got() == sorted([(i, 1) for i in range(20) if i not in (3, 4)] * 2 + [(3, 2)])
    store.upsert(rows([(3, 9)]).withColumnRenamed("n", "seen"), {"turns": rows([(3, 5)])})  # churn is left as it is
    store.upsert(rows([(3, 8), (5, 8)]).withColumnRenamed("n", "seen"), {"turns": rows([(3, 4), (5, 4)])})  # 3 has seen less than the one before
    assert (3, 5) in got() and (5, 4) in got() and (3, 2) in got("file_churn") and (5, 1) in got("file_churn")
    assert [at for at, _ in store.versions.current().parts["turns"]] == [at for at, _ in store.versions.current().parts["turns@"]] == [1]  # folded
    store.upsert(rows([(3, 8)]).withColumnRenamed("n", "seen"), {"turns": rows([(3, 6)])})
    assert (3, 5) in got() and (3, 6) not in got()  # the base has seen more
    store.upsert(rows([(40, 0)]).select("session_id"), both(rows([(40, 7)])))
    assert (40, 7) in got() and len(got()) == 37 and (40, 7) in got("file_churn")


def test_of_two_upserts_at_a_time_none_is_lost(spark, tmp_path):
    one, two = (rollups.SessionStore(spark, str(tmp_path / "s"), {"t": "session_id long, n long"}) for _ in range(2))
    rows = lambda data: spark.createDataFrame(data, "session_id long, n long")
    one.upsert(rows([(1, 0)]).select("session_id"), {"t": rows([(1, 1), (2, 1)])})
    real, met = one.versions.publish, []
    one.versions.publish = lambda *a: (met.append(two.upsert(rows([(2, 0)]).select("session_id"), {"t": rows([(2, 2)])})) if not met else None) or real(*a)
    one.upsert(rows([(1, 0)]).select("session_id"), {"t": rows([(1, 3)])})
    assert sorted(map(tuple, one.read("t").collect())) == [(1, 3), (2, 2)]


def test_stored_tables_follow_their_inputs(spark, tiny, tmp_path):
    """Rows appended to an input show in the next query, and only the sessions that they touch are derived."""
    sf = str(tmp_path / "sf")
    for t in ("events", "orders", "customer", "conversations", "lineitem"):
        spark.read.parquet(f"{tiny}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    before = Inputs(spark, sf)
    calls, churn, signals = before.tool_rollup.count(), before.file_churn.count(), {r["session_id"]: r for r in before.signals.collect()}
    assert calls == Inputs(spark, sf).tool_rollup.count()
    late = spark.read.parquet(f"{tiny}/events.parquet").where("event_id < 12").selectExpr("event_id + 6000000000 AS event_id", "* EXCEPT (event_id)")
    late.select(spark.read.parquet(f"{sf}/events.parquet").columns).write.mode("append").parquet(f"{sf}/events.parquet")
    x = Inputs(spark, sf)
    got = x.tool_rollup
    assert got.count() > calls and got.where("session_id >= 1000000000").count() == got.count() - calls
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rollups.tool_rollup(x.tool_calls).collect()))
    assert x.file_churn.count() > churn
    touched = [k for k in shared._STORED if k[-1] == "tool_rollup" and k[1] == sf]
    assert shared._STORED[touched[0]][1].last_written("tool_rollup") == got.count() - calls
    assert {r["session_id"]: r for r in x.signals.collect()} == signals  # no session of the feed has changed


def test_panel_selection(spark, tiny):
    x = Inputs(spark, tiny)
    assert list(insights.insights(x, ("mix", "mix"))) == ["grade_trend", "outcome_trend", "archetype_trend", "fleet_mix"]
    with pytest.raises(ValueError, match="nope"):
        insights.insights(x, ("nope",))


def test_quantiles_by_hand(spark):
    rng = random.Random(6)
    data = [(k, round(rng.choice([0, 1e-6, 0.5, 3.25, 900]) * rng.random() ** 3, 6)) for k in range(3) for _ in range(50 + k)] + [(3, 7.0), (4, None)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r["k"]: r for r in quantiles(df, "v", {"a": 0.0, "m": 0.5, "z": 0.97, "e": 1.0}, ("k",)).collect()}
    disc = {r["k"]: r for r in quantiles(df, "v", {"m": 0.5, "z": 0.97}, ("k",), discrete=True).collect()}
    assert set(got) == set(disc) == {0, 1, 2, 3}
    for k in got:
        v = sorted(x for i, x in data if i == k)
        assert [got[k][c] for c in "amze"] == pytest.approx([np.quantile(v, p) for p in (0, 0.5, 0.97, 1)], abs=1e-12)
        assert [disc[k]["m"], disc[k]["z"]] == [v[math.ceil(p * len(v)) - 1] for p in (0.5, 0.97)]


def test_snapshots_are_whole_gated_and_renewed(spark, tmp_path):
    one, two = (Snapshots(spark, str(tmp_path / "s"), most=2) for _ in range(2))
    rows = lambda n: spark.createDataFrame([("day", str(i), n, 0, 0, 0, 0, 1, float(i), None, None) for i in range(3)], ASSEMBLED)
    none, some = spark.range(0), spark.range(1)
    assert not one.take("a", rows(1), some, 100) and one.read("a", 100) == ("missing", None)
    assert one.take("a", rows(1), none, 100)
    state, old = one.read("a", 160)
    assert state == "fresh" and one.read("a", 161)[0] == "stale" and one.read("a", 1001)[0] == "missing"
    folder = one.table.current().facts["held"]["a"]["folder"]
    assert two.take("a", rows(1), none, 500) and one.table.current().facts["held"]["a"]["folder"] == folder and one.read("a", 500)[0] == "fresh"
    assert two.take("a", rows(2), none, 600) and {r["input"] for r in old.collect()} == {1} and {r["input"] for r in one.read("a", 600)[1].collect()} == {2}
    for i, name in enumerate("bc"):
        one.take(name, rows(3 + i), none, 700 + i)
    assert set(one.table.current().facts["held"]) == {"b", "c"}


def test_window_values_take_panels_and_read_each_table_once(spark, tiny):
    x = Inputs(spark, tiny)
    with pytest.raises(ValueError, match="nope"):
        window_values(x, "2024-06-15 12:00:00", ("nope",))
    df = window_values(x, "2024-06-15 12:00:00", ("tools",))
    assert {r["panel"] for r in df.select("panel").distinct().collect()} == {"quality", "tools"}
    plan = window_values(x, "2024-06-15 12:00:00", ("economics",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 4  # a panel has one placing in windows and one list of values


def test_search_by_index_finds_what_a_scan_finds(spark, tiny):
    x = Inputs(spark, tiny)
    words = sorted({w for r in x.messages.limit(40).select("content").collect() for w in r["content"].split() if len(w) > 3})
    needles = [*words[:: len(words) // 3], "THE", "é", "no such needle", x.messages.select("content").first()[0][5:60].upper()]
    for needle in needles:
        scan = x.messages.where(F.lower("content").contains(needle.lower()))
        assert sorted(map(tuple, sessions.search(x, needle).select("session_id", "ordinal").collect())) == sorted(map(tuple, scan.select("session_id", "ordinal").collect()))
    texts = [(1, "a😀b́ cd"), (2, "ab"), (3, None), (4, "xxxxx")]
    held = {r["session_id"]: r["n"] for r in sessions.grams(spark.createDataFrame(texts, "session_id long, content string")).groupBy("session_id").agg(F.collect_set("gram").alias("n")).collect()}
    part = sessions.grams(spark.createDataFrame([(0, "😀b́ c")], "session_id long, content string")).collect()
    assert set(held) == {1, 4} and len(held[4]) == 1 and part and {r["gram"] for r in part} <= set(held[1])
    plan = x.grams.where(F.col("gram").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [1,2])]" in plan
