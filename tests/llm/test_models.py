"""The factorization machine by hand, base spans of the secret scan by an own scanner, and clashing column names for operators."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import backoff, decontaminate, mixing, quality, registry, secrets, simhash, suffixes, toxicity


def test_scores_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Model(np.arange(12), 0.3, rng.normal(0, 1, 12), rng.normal(0, 1, (12, 3)))
    for n in (0, 1, 2, 7):
        on = np.sort(rng.choice(12, n, replace=False))
        z = m.w0 + sum(m.w[i] for i in on) + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(on) for j in on[a + 1 :])
        assert m.score(on) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-12)


def test_a_step_follows_the_numerical_gradient():
    rng = np.random.default_rng(5)
    k, factors, rate, decay = 6, 2, 0.1, 1e-4
    docs = [np.sort(rng.choice(k, rng.integers(0, 5), replace=False)) for _ in range(40)]
    y = (rng.random(40) < 0.4).astype(float)
    got = toxicity.fit_fm(docs, y, np.arange(k), factors, epochs=1, rate=rate, decay=decay, seed=3)
    base = y.mean()
    at = np.concatenate([[np.log(base / (1 - base))], np.zeros(k), np.random.default_rng(3).normal(0, 0.02, (k, factors)).ravel()])

    def loss(p):
        w0, w, v = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, factors)
        z = np.array([w0 + w[d].sum() + sum(v[i] @ v[j] for a, i in enumerate(d) for j in d[a + 1 :]) for d in docs])
        return np.mean(np.log1p(np.exp(-z)) + (1 - y) * z) + decay / 2 * (p[1:] ** 2).sum()

    slope = np.array([(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(len(at)) * 1e-5])
    want = at - rate * slope / np.sqrt(1e-6 + slope**2)
    assert np.concatenate([[got.w0], got.w, got.v.ravel()]) == pytest.approx(want, abs=2e-3)


def test_terms_enter_by_chi_square_and_by_frequency(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    texts = []
    for i in range(200):
        bad = i % 4 == 0
        texts.append((i, " ".join({rng.choice(words) for _ in range(6)} | ({"vile"} if bad and i % 3 else set()) | ({"kind"} if not bad else set())), int(bad)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in texts] + [(None, 1), (999, 1), (3, None)], "doc_id long, y int")
    held = [Counter(t for _, text, b in texts if b == y for t in toxicity.term_set(text)) for y in (0, 1)]
    n, npos = len(texts), sum(b for *_, b in texts)
    chi = {}
    for t in held[0].keys() | held[1].keys():
        a, b = held[1][t], held[0][t]
        if a + b >= 3:
            chi[t] = n * (a * (n - npos) - b * npos) ** 2 / ((a + b) * max(1, n - a - b) * npos * (n - npos))
    telling = sorted((t for t in chi if chi[t] >= 15), key=lambda t: (-chi[t], t))[:2]
    common = sorted((t for t in chi if chi[t] < 15), key=lambda t: (-(held[0][t] + held[1][t]), t))[:4]
    got = toxicity.train(docs, labels, kept=2, frequent=4)
    assert zlib.crc32(b"vile") & (toxicity.EVERY - 1) in telling and got.ids.tolist() == telling + common


def by_hand_base(text):
    """Spans of the three kinds, found letter by letter."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    run = lambda i, allowed: next((j for j in range(i, len(text)) if text[j] not in allowed), len(text))
    spans, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                j = i + len(word)
                j += j < len(text) and text[j] in "\"'"
                j = run(j, " ")
                if j < len(text) and text[j] in ":=":
                    j = run(j + 1, " ")
                    j += j < len(text) and text[j] in "\"'"
                    stop = run(j, value)
                    if stop > j:
                        end = stop
                        if stop - j >= 6:
                            spans.append((i, end, "assign"))
                break
        i = end or i + 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        end = run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end - i >= 20:
            spans.append((i, end, "access"))
        i = end if end > i + 4 else i + 1
    i = 0
    while i < len(text):
        end = run(i, set("0123456789abcdef"))
        if end - i >= 24:
            spans.append((i, end, "hex"))
        i = max(end, i + 1)
    kinds = ("assign", "access", "hex")
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2])))


def test_base_spans_by_another_scanner(spark, tmp_path):
    rng = random.Random(12)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "apikey", "api__key", "ſecret", "=", ":", "==", " ", "  ", "\t", "\n", '"', "'", "é", "日", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "x", "A", "Z9", "abc123", "-", "_", ".", "/", "K" * 16, "f" * 24, "; "]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500))]
    texts += [f"{w}{q}{s}{sep}{s}{q}{v}" for w in ("token", "PASSWORD") for q in ("", '"', "'") for s in ("", "  ") for sep in ":=" for v in ("12345", "123456", "AKIA" + "B" * 17, "a" * 30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.queries()["op9_secret_scan"](spark, str(tmp_path)).collect()}
    found = Counter()
    for i, t in enumerate(texts):
        spans = by_hand_base(t or "")
        count = Counter(k for *_, k in spans)
        found.update(count)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [count[k] for k in ("assign", "access", "hex")], t
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
    assert min(found[k] for k in ("assign", "access", "hex")) > 50


CLASH = ["n_words", "score", "fp", "component_id", "llr", "kept", "wh", "fold", "size", "target", "taken", "spans", "item_id", "chunk", "h", "k", "keys", "n_bytes", "batch", "text_", "t_id", "d", "b"]


@pytest.mark.parametrize("name", ["backoff", "simhash", "toxicity", "suffixes", "quality", "decontaminate", "mixing", "secrets"])
def test_other_columns_of_any_name_change_nothing(spark, name):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["red", "green", "blue", "cyan", "grey", "token: abc123"]) for _ in range(n))
    texts = [say(30) for _ in range(12)] + [None, "", say(3)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, texts[0][:60])], "item_id long, text string")
    run = {
        "backoff": backoff.score_documents, "simhash": simhash.simhash_groups, "suffixes": suffixes.dedup_suffixes, "secrets": secrets.scan_secrets,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train(d, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, y int"))),
        "quality": lambda d: quality.quality_rules(d, d.where("doc_id < 4").select("doc_id")), "decontaminate": lambda d: decontaminate.find_contained(d, items), "mixing": lambda d: mixing.mix_sources(d, [5, 2, 1]),
    }[name]
    plain, clashing = run(docs), run(docs.select("*", *[F.lit("x").alias(c) for c in CLASH]))
    common = [c for c in plain.columns if c not in CLASH or dict(clashing.dtypes)[c] == dict(plain.dtypes)[c]]
    result = lambda df: sorted(map(repr, df.select(*common).collect()))
    assert "doc_id" in common and result(clashing) == result(plain)
