"""The append sink: what is taken and refused, racing writers, replays, digests and folding."""

import hashlib
import random
import threading
from collections import defaultdict

import pytest

from loomlog.sources.appendlog import AppendLog
from loomlog.sources.versions import Versions

SENT = "session_id long, seq long, byte_offset long, data binary"


def digest(data: bytes, block: int) -> str:
    d = ""
    for i in range(0, len(data), block):
        d = hashlib.sha256((d + hashlib.sha256(data[i : i + block]).hexdigest()).encode()).hexdigest()
    return d


def rows(df):
    return sorted(map(tuple, df.select("session_id", "seq", "accepted", "length").collect()), key=repr)


def held(log):
    out = defaultdict(bytes)
    for r in sorted(log.chunks().collect(), key=lambda r: (r["session_id"], r["byte_offset"])):
        assert r["byte_offset"] == len(out[r["session_id"]]) and r["bytes"] == len(r["data"])
        out[r["session_id"]] += bytes(r["data"])
    return dict(out)


def test_only_what_starts_at_the_end_is_taken(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path), block=4)
    sent = [(1, 0, 0, b"ab\n"), (1, 1, 3, b"c\n"), (1, 2, 3, b"again\n"), (1, 3, 9, b"gap\n"), (2, 0, 0, b"cut"), (2, 1, 0, b"whole\n"), (2, 2, 0, b""), (3, 0, 0, None), (None, 0, 0, b"x\n"), (4, 0, None, b"x\n")]
    got = rows(log.append(spark.createDataFrame(sent * 2, SENT).repartition(3)))
    assert [r for r in got if r[2]] == [(1, 0, True, 3), (1, 1, True, 5), (2, 1, True, 6)]
    assert {r[0]: r[3] for r in got if not r[2]} == {1: 5, 2: 6, 3: 0, None: 0, 4: 0} and len(got) == 20
    assert held(log) == {1: b"ab\nc\n", 2: b"whole\n"}
    assert rows(log.append(spark.createDataFrame([(1, 9, 5, b"d\n"), (1, 8, 0, b"ab\n")], SENT))) == [(1, 8, False, 5), (1, 9, True, 7)]
    before = log.table.current().number
    assert not any(r[2] for r in rows(log.append(spark.createDataFrame(sent, SENT)))) and log.table.current().number == before
    assert log.append(spark.createDataFrame([], SENT)).count() == 0


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_digest_goes_on_over_any_chunks(spark, tmp_path, block):
    rng = random.Random(block)
    log, want = AppendLog(spark, str(tmp_path), block), defaultdict(bytes)
    for turn in range(3):
        sent = []
        for sid in range(4):
            for seq in range(rng.randrange(0, 4)):
                data = rng.randbytes(rng.randrange(0, 40)) + b"\n"
                sent.append((sid, seq, len(want[sid]), data))
                want[sid] += data
        rng.shuffle(sent)
        if sent:
            assert all(r["accepted"] for r in log.append(spark.createDataFrame(sent, SENT)).collect()), turn
    got = {r["session_id"]: (r["length"], r["digest"]) for r in log.heads().collect()}
    assert got == {k: (len(v), digest(v, block)) for k, v in want.items() if v} and held(log) == {k: v for k, v in want.items() if v}


def test_of_two_writers_one_is_refused_with_the_truth(spark, tmp_path):
    one, two = AppendLog(spark, str(tmp_path)), AppendLog(spark, str(tmp_path))
    one.append(spark.createDataFrame([(7, 0, 0, b"start\n")], SENT))
    real, met = one._try, []

    def slow(sent, version):  # the other writer comes between the decision and its publishing
        if not met:
            met.append(rows(two.append(spark.createDataFrame([(7, 0, 6, b"second\n"), (8, 0, 0, b"x\n")], SENT))))
        return real(sent, version)

    one._try = slow
    got = rows(one.append(spark.createDataFrame([(7, 5, 6, b"late\n"), (9, 5, 0, b"own\n")], SENT)))
    assert met == [[(7, 0, True, 13), (8, 0, True, 2)]] and got == [(7, 5, False, 13), (9, 5, True, 4)]
    assert held(one) == {7: b"start\nsecond\n", 8: b"x\n", 9: b"own\n"}


def test_versions_are_published_once_by_many_threads(spark, tmp_path):
    tables = [Versions(spark, str(tmp_path), {"t": "n long"}) for _ in range(6)]
    base = tables[0].current()
    won, gate = [], threading.Barrier(6)

    def go(i):
        gate.wait()
        if tables[i].publish(base, {}, {"by": i}):
            won.append(i)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and tables[0].current().facts == {"by": won[0]} and tables[0].current().number == 1


def test_folders_stay_few_and_old_ones_can_go(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path))
    for i in range(9):
        log.append(spark.createDataFrame([(1, i, 2 * i, b"x\n")], SENT))
    assert [at for at, _ in log.table.current().parts["chunks"]] == [1, 0]
    assert log.table.vacuum() > 8 and held(log) == {1: b"x\n" * 9} and log.table.vacuum() == 0
    assert [tuple(r) for r in log.heads().select("length", "digest").collect()] == [(18, digest(b"x\n" * 9, 4096))]


def test_stream_and_its_replay(spark, tmp_path):
    src, log = str(tmp_path / "in"), AppendLog(spark, str(tmp_path / "log"))
    for batch in ([(1, 0, 0, b"a\n")], [(1, 1, 2, b"b\n"), (2, 0, 0, b"c\n")]):
        spark.createDataFrame(batch, SENT).coalesce(1).write.mode("append").parquet(src)
        for checkpoint in ("one", "two"):  # a second stream from the start stands for a lost checkpoint
            log.stream(spark.readStream.schema(SENT).parquet(src), str(tmp_path / checkpoint)).awaitTermination()
    assert held(log) == {1: b"a\nb\n", 2: b"c\n"} and log.table.current().number == 2


def test_regions(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path))
    log.append(spark.createDataFrame([(1, 0, 0, b"12345\n"), (1, 1, 6, b"1\n"), (1, 2, 8, b"1234567890\n")], SENT))
    assert sorted(map(tuple, log.regions(8).collect())) == [(1, 0, 0, 8, 2), (1, 1, 8, 11, 1)]
