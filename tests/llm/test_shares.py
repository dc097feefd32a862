"""Sharding, resampling and alignment against brute force, on a small fixture with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import align, registry, resample, sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard string, slot string, rank string, n long, weight string"


def corpus():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "it's", "é", "straße", "naïve", "x1", "2024", "the", "of", "日本", "Ω"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "\n\t ", "one", "one", "  two  spaces ", "tail ", "a▁b", "<|endoftext|> <s> <0x41>", "nul\x00x", "-" * 300, "x" * 5000, say(5000)]
    texts += [say(rng.randrange(1, 60)) for _ in range(60)] + [say(25)] * 9
    rows = [(i, t, None, [None, "s1", "s2", "s2", "s2", ""][i % 6] if i != 5 else "rare", "a", "b", "c", i, None) for i, t in enumerate(texts)]
    return rows + [(None, "no id " + say(30), None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None), *[rows[20]] * 3, *[rows[-1]] * 4]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Sharding ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("shards", "group"), [(7, 1 << 16), (40, 4), (200, 1 << 16)])
def test_shards(docs, empty, monkeypatch, shards, group):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group)
    got = [r.asDict() for r in sharding.interleave(docs, shards).collect()]
    total = len(corpus())
    assert len(got) == total and set(got[0]) == set(docs.columns)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    mix = Counter((r["shard"], r["source"]) for r in got)
    for source, n in Counter(r["source"] for r in got).items():
        assert all(abs(mix[s, source] - n / shards) <= 2 for s in range(shards))
    # by hand: ranks within sources, then by fractional rank
    h = lambda *x: int(hashlib.md5(":".join("" if y is None else str(y) for y in x).encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for r in corpus():
        by[r[3]].append((h(11, r[0]), r[0]))
    rows = sorted(((i + h(11, s) / 2**60) / len(v), "" if s is None else "1" + s, i, x[1]) for s, v in by.items() for i, x in enumerate(sorted(v, key=lambda x: x[0])))
    placed = sorted(((r["shard"], r["slot"], r["doc_id"]) for r in got), key=lambda r: r[:2])
    assert [r[2] for r in placed] == [r[3] for r in rows]
    assert [(r[0]) for r in placed] == [p * shards // total for p in range(total)]
    assert sharding.interleave(empty, shards).count() == 0


def test_shards_as_files_and_again(spark, docs, tmp_path):
    one, two = (sharding.interleave(docs.repartition(k), 5) for k in (2, 6))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    sharding.write_shards(one, f"{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(corpus()) and back.where("shard = 3").agg(F.max("slot") + 1 == F.count("*")).first()[0]
    assert len(os.listdir(f"{tmp_path}/out/shard=0")) >= 2


def test_shards_of_many_small_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"))
    got = sharding.interleave(df, 10).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "hot").alias("hot")).collect()
    assert all(r["n"] == 300 and 80 <= r["hot"] <= 120 for r in got)  # not all single rows in one shard


# Resampling -------------------------------------------------------------------------------------------------------


def by_hand_features(t, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize(("ngram", "percent", "pivots"), [(2, 25, 32), (3, 60, 1), (1, 99, 2), (2, 100, 3)])
def test_resample(spark, docs, empty, ngram, percent, pivots):
    target = ["the alpha of gamma", None, "naïve x1 x1", ""]
    s, t = Counter(), Counter()
    for r in corpus():
        s.update(by_hand_features(r[1], ngram)[1])
    for x in target:
        t.update(by_hand_features(x, ngram)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for r in corpus():
        n, f = by_hand_features(r[1], ngram)
        weight = sum(map(gain, f)) // len(f) if f else 0
        u = (int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        want.append([n, r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u)))])
    able = sorted((x for x in want if x[0] >= 20), key=lambda x: (-x[4], x[1] is not None, x[1] or 0, x[2]))
    ranks = [(*x[1:], k + 1) for k, x in enumerate(able[: len(able) * percent // 100])]
    ranks += [(*x[1:], None) for x in able[len(able) * percent // 100 :]] + [(*x[1:], None) for x in want if x[0] < 20]
    some = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(docs, some, percent, ngram, pivots=pivots)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ranks, key=repr)
    assert resample.resample(empty, some).count() == 0
    assert resample.resample(docs, some, percent=0).where("rank is not null").count() == 0
    assert resample.resample(docs, some.limit(0)).where("rank is not null").count() == len(able) // 4


def test_quickselect_finds_every_place(spark):
    rng = random.Random(2)
    keys = [(rng.randrange(-3, 3), rng.randrange(2), rng.randrange(3), rng.randrange(2)) for _ in range(90)]
    df = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in resample.KEY))
    for k in (1, 2, 17, 45, 89, 90):
        cut, taken, same = resample.kth_key(df, k, pivots=2, seed=k)
        assert cut == sorted(keys)[k - 1] and same == keys.count(cut) and sum(x < cut for x in keys) + taken == k


# Alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.TOKENIZERS}/{align.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/{align.PIECE_BPE}")


def by_hand_tokens(tokenizers, text):
    """Lists of (id, bytes) by whole-text encoding with each library."""
    a, b = tokenizers
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if text and b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def by_hand_groups(x, y):
    spans = lambda ts: [(i, e - len(t), e) for (i, t), e in zip(ts, np.cumsum([len(t) for _, t in ts]).tolist(), strict=True)]
    sx, sy = spans(x), spans(y)
    links = [(i, j) for i, s, e in sx for j, u, v in sy if s < v and u < e]
    cuts = sorted({e for *_, e in sx} & {e for *_, e in sy})
    groups = [("".join(f"{i}," for i, s, e in sx if lo <= s and e <= hi)[:-1], "".join(f"{i}," for i, s, e in sy if lo <= s and e <= hi)[:-1]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    return links, ";".join(f"{p}|{q}" for p, q in groups), len(groups)


def test_alignment(spark, docs, empty, tokenizers):
    texts = [(r[0], (r[1] or "")[:400]) for r in corpus()]
    some = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_a string").repartition(3)
    rows, count = [], Counter()
    for i, t in texts:
        x, y = by_hand_tokens(tokenizers, t)
        rows.append((i, x, y, *by_hand_groups(x, y)))
        count.update(rows[-1][3])
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    want = [(i, len(x), len(y), g, len(links), text, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for i, x, y, links, text, g in rows]
    assert sum(w[1] == 0 for w in want) >= 3 and any(w[3] < w[1] for w in want)
    for small in (10**6, 0):  # counts by broadcast, and by join
        got = align.align(some, small_pairs=small)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert align.align(empty, small_pairs=small).count() == 0
    digest = {r["doc_id"]: r["groups"] for r in align.align(some, digest=True).collect()}
    assert all(digest[w[0]] == (hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "") for w in want if w[0] is not None)
    assert align.align(docs).count() == len(corpus())


def test_parts_encode_as_whole_texts(tokenizers, monkeypatch):
    rng = random.Random(4)
    signs = list("abcdeé ß\n\t  ,.'’12日本 ​▁😀<>|\x00\x1c\x85İ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + [" ", "  ", " x", "x ", "'s 're  ", "<s></s><unk>", "<|endoftext|>"]
    monkeypatch.setattr(align, "MEMO_CHARS", 300)
    monkeypatch.setattr(align, "BATCH_BYTES", 64)
    coder = align.Coder(*(open(f"{align.TOKENIZERS}/{f}", "rb").read() for f in (align.BYTE_BPE, align.PIECE_BPE)))
    for k in range(0, len(texts), 50):
        got = coder.align(texts[k : k + 50])
        for i, t in enumerate(texts[k : k + 50]):
            x, y = by_hand_tokens(tokenizers, t)
            links, text, n = by_hand_groups(x, y)
            assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["n_links"][i], got["groups"][i]) == (len(x), len(y), n if x else 0, len(links), text)
            code, times = (np.frombuffer(got[c][i], "<u4").tolist() for c in ("pairs", "times"))
            assert dict(zip(code, times, strict=True)) == Counter(p * len(coder.b_bytes) + q for p, q in links)


def test_chains_of_overlaps_end_in_one_group():
    n = 1000  # A cuts at odd bytes, B at even ones: one chain through all tokens
    a, b = np.array([*range(1, 2 * n, 2), 2 * n]), np.arange(2, 2 * n + 1, 2)
    assert set(align.terminals(a, b).tolist()) == {n}


@pytest.mark.parametrize("name", ["op11_interleaved_shards", "op12_target_resample"])
def test_sql_twin(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tiny}/{table}.parquet')")
    df, want = registry.queries()[name](spark, tiny), con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)
