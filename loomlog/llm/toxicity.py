"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import read, written

_TOKEN = re.compile(r"\w+")
BITS = 20
EVERY = 1 << BITS


def terms(word: str) -> list[int]:
    """Hashed terms of a word: itself and its first four and five letters, which inflected or coded forms share."""
    own = [word, *[f"^{n}{word[:n]}" for n in (4, 5) if len(word) > n]]
    return [zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in own]


def term_set(text: str | None) -> set[int]:
    return {t for w in set(_TOKEN.findall((text or "").lower())) for t in terms(w)}


@dataclass
class Model:
    """score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct kept terms of a text."""

    ids: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    _at: dict = field(default_factory=dict, repr=False)

    def rows(self, text: str | None, cache: dict) -> np.ndarray:
        at, out = self._at or self._at.update({int(h): i for i, h in enumerate(self.ids)}) or self._at, set()
        for word in set(_TOKEN.findall((text or "").lower())):
            hit = cache.get(word)
            if hit is None:
                if len(cache) > 100_000:
                    cache.clear()
                hit = cache[word] = tuple(at[t] for t in terms(word) if t in at)
            out.update(hit)
        return np.fromiter(sorted(out), np.int64, len(out))

    def score(self, active: np.ndarray) -> float:
        v = self.v[active]
        pair = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.w0 + float(self.w[active].sum()) + pair, -30, 30))))


def fit_fm(docs: list[np.ndarray], y: np.ndarray, ids: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adagrad on the logistic loss in mini-batches of 128; docs hold indexes into ids. One class only: its base rate."""
    rng = np.random.default_rng(seed)
    k = len(ids)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        return Model(ids, 30.0 if base else -30.0, np.zeros(k), np.zeros((k, factors)))
    w0, w, v = float(np.log(base / (1 - base))), np.zeros(k), rng.normal(0, 0.02, (k, factors))
    g0, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), 128):
            batch = order[s : s + 128]
            n = np.array([len(docs[i]) for i in batch])
            idx = np.concatenate([docs[i] for i in batch]) if n.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(batch)), n)
            vi = v[idx]
            total = np.zeros((len(batch), factors))
            np.add.at(total, row, vi)
            square = np.bincount(row, (vi**2).sum(axis=1), len(batch))
            z = w0 + np.bincount(row, w[idx], len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            g0 += err.sum() ** 2
            w0 -= rate * err.sum() / np.sqrt(g0)
            hit = np.unique(idx)
            dw, dv = np.bincount(idx, err[row], k)[hit], np.zeros((k, factors))
            np.add.at(dv, idx, err[row, None] * (total[row] - vi))
            dw, dv = dw + decay * w[hit], dv[hit] + decay * v[hit]
            gw[hit] += dw**2
            gv[hit] += dv**2
            w[hit] -= rate * dw / np.sqrt(gw[hit])
            v[hit] -= rate * dv / np.sqrt(gv[hit])
    return Model(ids, w0, w, v)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold a term, added up in the task; the term EVERY stands for all documents."""
    n = np.zeros((2, EVERY + 1), np.int32)
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            hits = term_set(text)
            n[int(y), np.fromiter(hits, np.int64, len(hits))] += 1
            n[int(y), EVERY] += 1
    some = np.flatnonzero(n.sum(axis=0))
    yield pd.DataFrame({"term": some, "neg": n[0, some], "pos": n[1, some]})


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, kept: int = 4096, frequent: int = 1024, min_docs: int = 3, least_chi: float = 15.0) -> Model:
    """Fit on at most `rows` labelled documents, those of least hash.

    Terms that enter: up to `kept` of highest chi-square, if it reaches `least_chi`, and the `frequent` most frequent
    others, whatever they say alone, so that pairs of them can tell; decay keeps those of no bearing near zero.

    labels: (doc_id, y). Null ids and labels are left out; an id that is labelled twice trains twice, and so does one
    that several documents share; a label without a document does not count. The bound makes the model's cost the same
    at every size of corpus; it is the only sample in this module. Without labelled documents every score is 0.
    """
    picked = labels.where("doc_id is not null and y is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("y").cast("int"))
    df = sample.mapInPandas(_counts, "term int, neg int, pos int").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    df = written(df, "terms")
    whole = df.where(F.col("term") == EVERY).first()
    npos, nneg = (float(whole["pos"]), float(whole["neg"])) if whole else (0.0, 0.0)
    n = npos + nneg
    both = F.col("pos") + F.col("neg")
    chi = n * F.pow(F.col("pos") * nneg - F.col("neg") * npos, 2) / (both * F.greatest(F.lit(1.0), n - both) * F.lit(max(1.0, npos * nneg)))
    terms = df.where(F.col("term") != EVERY).where(both >= min_docs).withColumn("chi", chi)
    telling = terms.where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "term").limit(kept).select("term")
    common = terms.where(F.col("chi") < least_chi).orderBy(both.desc(), "term").limit(frequent).select("term")
    ids = np.array([r["term"] for r in telling.collect() + common.collect()], np.int64)
    bare = Model(ids, 0.0, np.zeros(len(ids)), np.zeros((len(ids), 1)))

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "idx": [bare.rows(t, cache).tolist() for t in pdf["text"]]})

    got = sample.mapInPandas(active, "y int, idx array<int>").toPandas()
    order = sorted(range(len(got)), key=lambda i: (got["y"][i], tuple(got["idx"][i])))  # whatever order tasks end in
    return fit_fm([np.asarray(got["idx"][i], np.int64) for i in order], got["y"].to_numpy(float)[order] if len(got) else np.zeros(0), ids)


def score_column(model: Model, text: F.Column) -> F.Column:
    """The score of a text column, batch by batch; a null or empty text gets the model's base score."""
    cache: dict = {}

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(model.rows(t, cache)) for t in texts], dtype=float)

    return scored(text)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from the text alone: a row for each row of docs, none for an empty table.

    Null and empty texts get the model's base score. A term counts once a text, so long texts cost time in proportion
    to their length and equal texts score alike. Columns other than doc_id and text are neither read nor returned.
    """
    return docs.select(F.col("doc_id").cast("long"), score_column(model, F.col("text")).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""
    return docs.where(score_column(model, F.col("text")) < threshold)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")).where(~held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, training_labels(spark, sf_dir)))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
