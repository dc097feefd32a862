"""Quality rules: counts of bad form, and a hashed n-gram log-likelihood ratio against trusted text. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import read, small, words, written

#: Hash buckets of unigrams and bigrams together; also the length of the weight table that the plan carries.
BUCKETS = 10_000
SYMBOLS = "#*$%&|<>"
#: Parts of the trusted texts that are judged by weights fitted without them, and the share of trusted texts that may be lost.
FOLDS, MISS = 5, 0.03
#: Steps of a mean log ratio in which the threshold is set.
STEP = 0.001


def form_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words): counts of each row's whole text.

    Null texts count as empty. A word is repeated if a window of `window` words that covers it occurs twice or more in
    the text. Windows are compared by 64-bit hash within one text. The counts are written, so that a filter on them
    is one over a table.
    """
    return written(_form(docs, window).drop("wh"), "form")


def _form(docs: DataFrame, window: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of form_counts, those in `keep`, and wh, the hashes of the words in order.

    A filter on the result would be pushed through these projections and split the text once for each use of its words
    in every window; so results that are given away are written first.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        "doc_id", *keep,
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("wh"),
    )
    n = F.size("wh")
    df = df.withColumn("win", F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1))), lambda i: F.xxhash64(F.slice("wh", i, F.lit(window))))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("ranked", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.get("ranked", a)["h"] == F.get("ranked", b)["h"]
    twice = F.filter("ranked", lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    df = df.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda x, j: F.least(F.lit(window), F.coalesce(F.get("at", j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        "doc_id", *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "wh",
    )


def _grams(df: DataFrame, buckets: int) -> DataFrame:
    """df with wh replaced by grams: bucket numbers of every word and every pair of neighbours."""
    pairs = F.when(F.size("wh") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("wh") - 1)), lambda i: F.xxhash64(F.get("wh", i - 1), F.get("wh", i)))).otherwise(F.array().cast("array<long>"))
    return df.withColumn("grams", F.transform(F.concat("wh", pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))).drop("wh")


def _trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with `fold` of the trusted rows, null for others; ids that repeat count once, nulls are none."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("t_id")).distinct()
    fold = F.pmod(F.xxhash64(F.col("t_id").cast("long")), F.lit(FOLDS)).cast("int")
    return docs.join(small(ids), F.col("doc_id") == F.col("t_id"), "left").withColumn("fold", F.when(F.col("t_id").isNotNull(), fold)).drop("t_id")


def ratio_weights(marked: DataFrame, buckets: int = BUCKETS, prior: float = 1.0) -> list[list[float]]:
    """log p_target(b) - log p_raw(b) of each bucket, from all n-grams of all documents: first with all trusted texts as the
    target, then without each fold of them.

    marked: (text, fold) of _trusted. Both multinomials are smoothed by `prior`. Rows count one by one; null and wordless
    texts add nothing. Without target text all weights are 0.
    """
    grams = _grams(marked.select("fold", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh")), buckets)
    rows = grams.select("fold", F.explode_outer("grams").alias("b"))  # _outer: else Spark tests for empty arrays below, building them twice
    counts = rows.where("b is not null").groupBy("b", "fold").count().collect()  # FOLDS + 1 rows a bucket at most
    raw, target = [prior] * buckets, [[0] * buckets for _ in range(FOLDS)]
    for r in counts:
        raw[r["b"]] += r["count"]
        if r["fold"] is not None:
            target[r["fold"]][r["b"]] += r["count"]
    out = []
    for left in [None, *range(FOLDS)]:
        t = [prior + sum(f[b] for i, f in enumerate(target) if i != left) for b in range(buckets)]
        shift = math.log(sum(raw)) - math.log(sum(t))
        out.append([math.log(x) - math.log(r) + shift for x, r in zip(t, raw, strict=True)] if sum(t) > prior * buckets else [0.0] * buckets)
    return out


def _ratio(weights: list[list[float]]) -> Column:
    """Mean weight of a row's grams, trusted rows by the weights fitted without their fold; none: 0."""
    def by(table: list[float]) -> Column:
        values = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
        return F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(values, b))

    total = F.when(F.col("fold").isNull(), by(weights[0]))
    for i, table in enumerate(weights[1:]):
        total = total.when(F.col("fold") == i, by(table))
    return F.coalesce(F.try_divide(total, F.size("grams")), F.lit(0.0))


def least_ratio(marked: DataFrame, weights: list[list[float]], miss: float = MISS, buckets: int = BUCKETS) -> float:
    """The highest step below which at most `miss` of the trusted texts of 20 words or more score; without any: 0.

    A trusted text is judged by weights that it took no part in, so this is what the rule costs among texts like them.
    """
    own = marked.where("fold is not null").select("fold", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh")).where(F.size("wh") >= 20)
    steps = _grams(own, buckets).select(F.floor(_ratio(weights) / STEP).alias("s")).groupBy("s").count().orderBy("s").collect()  # one row a step
    lost, every = 0, sum(r["count"] for r in steps)
    for r in steps:
        if lost + r["count"] > miss * every:
            return r["s"] * STEP
        lost += r["count"]
    return 0.0


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, counts of form_counts, base_failed, llr, kept): a row for each row of docs.

    llr is the mean of the weights of a text's n-grams, so long and short texts compare; none: 0. A row is kept if it
    passes the base rules and llr >= threshold, by default that of least_ratio. Counts and llr are written, one narrow row
    a document, so that filters on the result are cheap. Rows that share a doc_id are judged one
    by one, equal texts outside the trusted ones alike. Texts are taken whole, in time in proportion to their length, but
    for sorting the repeated windows. Empty tables give no rows; columns other than doc_id and text are neither read nor
    returned.
    """
    marked = _trusted(docs.select("doc_id", "text"), trusted)
    weights = ratio_weights(marked, buckets)
    threshold = least_ratio(marked, weights, MISS, buckets) if threshold is None else threshold
    df = _grams(_form(marked, keep=("fold",)), buckets).withColumn("llr", _ratio(weights)).drop("grams", "fold")
    df = written(df, "form")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select("*", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(read(spark, sf_dir, "documents"), trusted)
