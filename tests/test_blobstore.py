"""The blob store on hand-made contents: claims, counts, pins, sweeps and the bytes they leave."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from loomlog.operators import transcript
from loomlog.operators.rollups import SessionStore
from loomlog.sources import raw
from loomlog.sources.blobstore import PIN, BlobStore


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def store(spark, tmp_path):
    return BlobStore(spark, str(tmp_path / "blobs"), fold=3)


def sent(spark, *rows):
    return spark.createDataFrame([(bytearray(d) if d is not None else None, c, m) for d, c, m in rows], "data binary, claimed string, media_type string")


def held(store, **options):
    return {r["sha256"]: bytes(r["data"]) for r in store.get(**options).collect()}


def test_claims_are_checked_and_equal_contents_stored_once(spark, store):
    rows = [(b"a", None, "text/b"), (b"a", sha(b"a").upper(), "text/a"), (b"", None, None), (None, sha(b"x"), None), (b"b", sha(b"c"), None), (b"\xff\x00", None, None)]
    got = {(r["sha256"], r["accepted"], r["fresh"]) for r in store.put(sent(spark, *rows), 0).collect()}
    assert got == {(sha(b"a"), True, True), (sha(b""), True, True), (sha(b"c"), False, False), (sha(b"\xff\x00"), True, True)}
    assert held(store) == {sha(d): d for d in (b"a", b"", b"\xff\x00")}
    assert {r["media_type"] for r in store.get().where(F.col("sha256") == sha(b"a")).collect()} == {"text/a"}
    again = store.put(sent(spark, (b"a", None, None), (b"b", sha(b"b"), None)), 5)
    assert {(r["sha256"], r["fresh"]) for r in again.collect()} == {(sha(b"a"), False), (sha(b"b"), True)}
    assert store.table.read("blobs", store.table.current()).count() == 4
    wanted = spark.createDataFrame([(sha(b"\xff\x00"),), (sha(b"none"),)], "sha256 string")
    assert held(store, wanted=wanted) == {sha(b"\xff\x00"): b"\xff\x00"}
    assert held(store, wanted=wanted, first=1) == {sha(b"\xff\x00"): b"\xff"}


def test_pins_and_references_protect(spark, store):
    refs = lambda *rows: store.refer(spark.createDataFrame([(sha(d), n) for d, n in rows], "sha256 string, refs long"))
    store.put(sent(spark, (b"pinned", None, None), (b"used", None, None), (b"left", None, None)), 0)
    store.put(sent(spark, (b"pinned", None, None)), PIN // 2)
    refs((b"used", 1), (b"used", 1), (b"left", 1))
    refs((b"used", -1), (b"left", -1), (b"unknown", 1))
    assert store.sweep(PIN - 1).count() == 0
    assert [r["sha256"] for r in store.sweep(PIN).collect()] == [sha(b"left")]
    assert set(held(store)) == {sha(b"pinned"), sha(b"used")} and store.table.read("blobs", store.table.current()).count() == 3
    # put again before the bytes have gone: live without a write
    assert store.put(sent(spark, (b"left", None, None)), PIN).first()["fresh"]
    assert set(held(store)) == {sha(b"pinned"), sha(b"used"), sha(b"left")} and store.table.read("blobs", store.table.current()).count() == 3
    assert {r["sha256"] for r in store.sweep(3 * PIN).collect()} == {sha(b"pinned"), sha(b"left")}
    store.compact()
    assert store.table.read("blobs", store.table.current()).count() == 1 and held(store) == {sha(b"used"): b"used"}
    # after the bytes have gone, a put writes them
    assert store.put(sent(spark, (b"left", None, None)), 4 * PIN).first()["fresh"]
    assert held(store) == {sha(b"used"): b"used", sha(b"left"): b"left"}
    known = {r["sha256"]: (r["refs"], r["live"], r["rows"]) for r in store.state().collect()}
    assert known == {sha(b"used"): (1, 1, 1), sha(b"left"): (0, 1, 1), sha(b"unknown"): (1, 0, 0)}


def test_facts_are_folded_and_empty_calls_change_nothing(spark, store):
    none = sent(spark).limit(0)
    assert store.put(none, 0).count() == 0 and store.sweep(0).count() == 0 and store.get().count() == 0
    for i in range(7):
        store.put(sent(spark, (b"x%d" % i, None, None), (b"x", None, None)), i)
    parts = store.table.current().parts
    assert len(parts["facts"]) < 6 and len(parts["blobs"]) < 6 and len(held(store)) == 8
    assert {r["rows"] for r in store.state().collect()} == {1}


def test_a_sweep_beside_a_put_loses_nothing_that_was_put(spark, store):
    store.put(sent(spark, *[(b"%d" % i, None, None) for i in range(20)]), 0)
    todo = [threading.Thread(target=lambda: store.put(sent(spark, *[(b"%d" % i, None, None) for i in range(10)]), 2 * PIN)), threading.Thread(target=lambda: store.sweep(2 * PIN))]
    for t in todo:
        t.start()
    for t in todo:
        t.join(120)
    # whichever was first, what was put at last is there, once
    assert set(held(store)) == {sha(b"%d" % i) for i in range(10)} and store.get().count() == 10


def test_aliases_of_hosts(spark):
    aliases = spark.createDataFrame([("gh", "GitHub.com"), ("work", "Git.corp"), ("work", "Git.other"), ("example.org", "ssh.example.org"), ("void", "")], "alias string, host string")
    rows = ["git@gh:Team/Repo.git", "ssh://git@work:22/A/b", "git@example.org:A/b", "GH:Team/x", "git@void:a/b", "/local", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, remote string")
    got = {r["i"]: r["remote"] for r in raw.resolved_remotes(df, aliases).collect()}
    assert got == {0: "github.com/team/repo", 1: "git.corp/A/b", 2: "example.org/A/b", 3: "gh/Team/x", 4: "void/a/b", 5: None, 6: None}


def test_a_page_reads_the_files_of_its_session_alone(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id * 7919 % 400 AS session_id", "id div 400 AS ordinal", "repeat('x', 50) AS content")
    store = SessionStore(spark, str(tmp_path / "t"), {"transcript": "session_id long, ordinal long, content string"}, sort={"transcript": "session_id"})
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else files this small are written as one
    try:
        store.upsert(spark.createDataFrame([], "session_id long"), {"transcript": rows})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stored = store.read("transcript")
    one = stored.where("session_id = 123")
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    assert len(files(stored)) == 4 and len(files(one)) == 1 and one.count() == 10
    assert "EqualTo(session_id,123)" in one._jdf.queryExecution().executedPlan().toString()
    assert [r["ordinal"] for r in transcript.budget_page(one, 4000).orderBy("ordinal").collect()] == [0, 1, 2]


def test_windows_after_cursors(spark):
    messages = spark.createDataFrame([(s, o, "user") for s, n in ((1, 5), (2, 3), (3, 1)) for o in range(n)], "session_id long, ordinal long, role string")
    cursors = spark.createDataFrame([(1, 0), (1, 3), (1, 3), (2, -1), (3, 0), (9, 0)], "session_id long, cursor long")
    got = sorted((r["session_id"], r["cursor"], r["ordinal"], r["more"]) for r in transcript.after_windows(messages, cursors, 2).collect())
    assert got == [(1, 0, 1, True), (1, 0, 2, True), (1, 0, 3, True), (1, 3, 4, False), (2, -1, 0, True), (2, -1, 1, True), (2, -1, 2, True)]
