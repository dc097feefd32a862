"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, UPPER, WORD, counted, pack, parts, read, totals_of, words

ALPHA = 0.4
#: Longest n-gram of the query. An order more costs the operator about 1.5 times the input in shuffled keys.
ORDER = 2
#: Text bytes in a chunk of documents and n-grams in a hash partition; they bound the memory of a task.
CHUNK_BYTES, BUCKET_GRAMS = 6 << 20, 3 << 20


def _unigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    seen: dict[bytes, int] = {}
    out, digest = [], xxhash.xxh64_intdigest
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens = (text or b"").lower().split()
        sizes[i] = len(tokens)
        for w in tokens:
            h = seen.get(w)
            if h is None:
                h = seen[w] = digest(w)
            out.append(h)
    return np.array(out, np.uint64), sizes


def _longer(shorter: np.ndarray, uni: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that end at `at`, from that of the n - 1 words before and the last word's."""
    a, b = shorter, uni[at]
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a >> np.uint64(17)))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for n from 1 to order (hashes of all n-grams, positions of their last words)."""
    uni, sizes = _unigrams(texts)
    place = np.arange(len(uni)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole, out = uni, [(uni, np.arange(len(uni)))]
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        grams = _longer(whole[at - 1], uni, at)
        whole = np.zeros(len(uni), np.uint64)
        whole[at] = grams
        out.append((grams, at))
    return sizes, out


def score_documents(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score): a row for each row of docs.

    A word scores count(context, word) / count(context), where the context is the order - 1 words before it, if that n-gram
    also occurs outside this text, else alpha times its score with a context one word shorter; without context it is
    count(word) / N. A text's first words have shorter contexts, which is no backing off. log_score is the sum of
    natural logarithms, 0 for null or wordless texts. n_backoff counts the words that backed off. Words are as in
    common.WORD, A-Z lower-cased. Every row counts towards the corpus, repeated rows and copies included, and a copy
    is another text. Long texts are taken whole. Columns other than doc_id and text are neither read nor returned.
    Empty tables give no rows.

    Counts are relational: each chunk of documents holds its distinct n-grams, hash partitions hold the count tables,
    and the two are joined on (chunk, partition), see common.pack. What is shuffled grows with the corpus; an n-gram
    that all documents share is sent once per chunk.
    """
    n_bytes, n_words, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0)), F.count("*")).first()
    chunks, buckets = parts(n_bytes, CHUNK_BYTES), parts(order * n_words, BUCKET_GRAMS)
    dealt = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary").alias("data"))  # pandas would turn ids beside a null into floats
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "data"), F.lit(chunks)))

    def request(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, (grams, _) in enumerate(_grams(pdf["data"].tolist(), order)[1]):
            # each length has partitions of its own, so that hashes of different lengths never meet
            rows.append(pack(int(pdf["chunk"].iloc[0]), *np.unique(grams, return_counts=True), buckets))
            rows[-1]["bucket"] += n * buckets
        return pd.concat(rows)

    def score(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        sizes, every = _grams(pdf["data"].tolist(), order)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        n_grams = len(doc)
        level, logs = np.zeros(n_grams, np.int64), np.zeros(n_grams)
        before = np.full(n_grams, float(n_words))  # count of the context of each word, for the n at hand
        for n, (grams, at) in enumerate(every):
            keys, inverse = np.unique(grams, return_inverse=True)
            mine = replies[replies["bucket"] // buckets == n]
            total = totals_of(keys, buckets, mine.assign(bucket=mine["bucket"] % buckets))[inverse].astype(float)
            if n:
                # the text's own occurrences do not make an n-gram seen
                _, own, times = np.unique(doc[at] * len(keys) + inverse, return_inverse=True, return_counts=True)
                seen = (total > times[own]) & (level[at] == n - 1)
            else:
                seen = np.ones(len(at), bool)
            hit = at[seen]
            logs[hit] = np.log(total[seen]) - np.log(before[hit])
            level[hit] = n
            before = np.full(n_grams, np.inf)
            after = at[:-1][doc[at[:-1]] == doc[at[:-1] + 1]] if len(at) else at
            before[after + 1] = total[: len(at)][np.searchsorted(at, after)]
        short = np.minimum(order - 1, np.arange(n_grams) - np.repeat(np.cumsum(sizes) - sizes, sizes)) - level
        logs += short * np.log(alpha)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": sizes, "n_backoff": np.bincount(doc, short > 0, len(sizes)).astype(np.int64), "log_score": np.bincount(doc, logs, len(sizes))})

    replies = counted(dealt, request)
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(score, "doc_id string, n_words long, n_backoff long, log_score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(read(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 5)).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", "n_backoff", mean.alias("mean_log_score"))


OP1_SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
u AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
p AS (SELECT r, i, x, lag(x) OVER (PARTITION BY r ORDER BY i) AS y FROM u),
c1 AS (SELECT x, count(*) AS n FROM p GROUP BY x),
o2 AS (SELECT r, y, x, count(*) AS own FROM p WHERE y IS NOT NULL GROUP BY r, y, x),
c2 AS (SELECT y, x, sum(own) AS n FROM o2 GROUP BY y, x),
s AS (SELECT p.r, p.y IS NOT NULL AND c2.n = o2.own AS back,
             CASE WHEN p.y IS NOT NULL AND c2.n > o2.own THEN ln(c2.n) - ln(cy.n)
                  ELSE ln(cx.n) - ln((SELECT count(*) FROM u)) + CASE WHEN p.y IS NULL THEN 0 ELSE ln({ALPHA}) END END AS l
      FROM p JOIN c1 cx ON p.x = cx.x LEFT JOIN c1 cy ON p.y = cy.x LEFT JOIN c2 ON p.y = c2.y AND p.x = c2.x LEFT JOIN o2 ON p.r = o2.r AND p.y = o2.y AND p.x = o2.x),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (back) AS n_backoff, sum(l) AS l FROM s GROUP BY r)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, coalesce(round(l / n_words, 5), 0.0) AS mean_log_score
FROM t LEFT JOIN g USING (r)
"""
