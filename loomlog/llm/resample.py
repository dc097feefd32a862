"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel scores, distributed quickselect."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, UPPER, parts, read, small, written

#: ASCII but for letters and digits parts words; A-Z become lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(data: bytes, ngram: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a UTF-8 text, and the bucket of each run of 1 to `ngram` words: CRC-32 of the words joined by spaces, modulo `buckets`."""
    words = data.translate(_WORDS).split()
    if not words:
        return 0, np.empty(0, np.int64)
    code, led = list(map(crc32, words)), [b" " + w for w in words]
    every = code
    for k in range(1, min(ngram, len(words))):
        code = list(map(crc32, led[k:], code))  # a run's checksum goes on from that of its first words
        every = every + code
    return len(words), np.array(every, np.int64) % buckets


def bucket_counts(texts: DataFrame, ngram: int = 2, buckets: int = 10_000) -> dict[int, int]:
    """How many features of all texts fall in each bucket; tasks add up before the shuffle, `buckets` rows reach the driver at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.append(features(text.as_py(), ngram, buckets)[1])
                    n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(each, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the raw corpus, floored."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
    return np.array([gain(raw.get(b, 0), target.get(b, 0)) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, ngram: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features; none: 0. A row for each row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                n, at = features(text.as_py() or b"", ngram, len(gains))
                out[:, i] = n, len(at), int(gains[at].sum()) // max(1, len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def luck(seed: int) -> Column:
    """Thousandths of a Gumbel draw for each doc_id, floored; ids that are null share that of an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: The order of the draw: higher scores first, then smaller ids, null ids before others; the last part tells rows of one id apart.
KEY = {"k_score": "-score", "k_has_id": "bigint(doc_id is not null)", "k_id": "bigint(coalesce(doc_id, 0))", "k_features": "n_features"}


def _key(value: tuple | None = None) -> Column:
    return F.struct(*KEY) if value is None else F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, value, strict=True)])


def kth_key(keys: DataFrame, k: int, pivots: int = 32, seed: int = 0) -> tuple[tuple, int, int]:
    """The k-th smallest composite key of a table with the columns of KEY, how many rows before or at k hold it, and how many rows do.

    Quickselect: some random keys are pivots; one pass counts exactly, for each, the rows before it and those equal to
    it. That tells whether the k-th is a pivot, and else between which two it lies; only these rows are written for the
    next round, about 1 / pivots of the rows. What reaches the driver is the pivots and their counts.
    """
    keys, turn = keys.select(*[F.col(c).cast("long").alias(c) for c in KEY]), 0
    while True:
        drawn = keys.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *KEY)).limit(pivots).collect()
        at = sorted({tuple(r) for r in drawn})
        counts = keys.agg(*[F.count_if(_key() < _key(p)) for p in at], *[F.count_if(_key() == _key(p)) for p in at]).first()
        less, same = counts[: len(at)], counts[len(at) :]
        i = next((i for i in range(len(at)) if less[i] + same[i] >= k), len(at))
        if i < len(at) and less[i] < k:
            return at[i], k - less[i], same[i]
        inside = F.lit(True)
        if i < len(at):
            inside &= _key() < _key(at[i])
        if i:
            inside &= _key() > _key(at[i - 1])
            k -= less[i - 1] + same[i - 1]
        keys, turn = written(keys.where(inside), "narrowed"), turn + 1


def _ranked(winners: DataFrame, total: int) -> DataFrame:
    """winners (columns of a row, those of KEY, copies) with `rank`: sorted by range, numbered within ranges, ranges added up."""
    pieces = max(16, parts(total, 1 << 18))
    ranged = written(winners.repartitionByRange(pieces, *KEY).withColumn("piece", F.spark_partition_id()), "winners")
    sums = ranged.groupBy("piece").agg(F.sum("copies").alias("n"))
    base = sums.select("piece", (F.sum("n").over(W.orderBy("piece")) - F.col("n")).alias("base"))  # a row for each range
    within = F.sum("copies").over(W.partitionBy("piece").orderBy(*KEY).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("copies")
    return ranged.join(small(base), "piece").withColumn("first", F.col("base") + within + 1).withColumn("rank", F.explode(F.expr("sequence(first, first + copies - 1)")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, ngram: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7, pivots: int = 32) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): docs drawn without replacement, likelier the more they look like target(text).

    A feature is a run of 1 to `ngram` words, its bucket a CRC-32 modulo `buckets`; a document's weight is its mean log
    ratio of bucket shares in target and in docs, in thousandths. score adds a Gumbel draw of the id, so the highest
    scores are a sample in proportion to exp(weight / 1000). Of the documents with `least_words` words, `percent` in 100
    are drawn, rounded down; rank numbers them by score, ties to the smaller doc_id, and is null for all others.

    A row for each row of docs. Null and wordless texts have no features and weight 0; null ids come before others and
    share one draw; rows of one id share it too and are drawn one by one, that of fewer features first, and rows alike
    in all result columns are interchangeable. Texts are read whole, in time in proportion to their length. An empty
    table gives no rows; without target text, gains come from smoothing alone. Columns other than doc_id and text are
    neither read nor returned. `buckets` numbers travel to tasks; no other part of the data does.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets), buckets)
    scored = weigh(docs, gains, ngram).withColumn("score", F.col("weight") + luck(seed))
    scored = written(scored.select("*", *[F.expr(c).alias(n) for n, c in KEY.items()]), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    own = ["doc_id", "n_features", "weight", "score"]
    unranked = [*own, F.lit(None).cast("long").alias("rank")]
    if not k:
        return scored.select(*unranked)
    cut, taken, same = kth_key(able, k, pivots, seed)
    ahead = able.where(_key() < _key(cut)).groupBy(*own, *KEY).agg(F.count("*").alias("copies"))
    # rows with the key of the cut are alike in every column, so that one of them says what to write, and how often
    one = able.where(_key() == _key(cut)).limit(1).first()
    alike = lambda n: spark.range(n).select(*[F.lit(one[c]).cast("long").alias(c) for c in (*own, *KEY)])
    drawn = _ranked(ahead.unionByName(alike(1).withColumn("copies", F.lit(taken).cast("long"))), k).select(*own, F.col("rank").cast("long"))
    left = scored.where((F.col("n_words") < least_words) | (_key() > _key(cut))).select(*unranked)
    return drawn.unionByName(left).unionByName(alike(same - taken).select(*unranked))


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC-32 of a string's UTF-8 bytes in DuckDB: its table by the rule of the polynomial, then a fold over the bytes.
CRC_SQL = """crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of `text`, where crc_table is joined in."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


_FEATURES = r"""SELECT {id} AS doc_id, w FROM (SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""
OP12_SQL = f"""
WITH {CRC_SQL},
dw AS MATERIALIZED ({_FEATURES.format(id="doc_id", table="documents", upper=UPPER, lower=LOWER)}),
bw AS MATERIALIZED ({_FEATURES.format(id="item_id", table="benchmark", upper=UPPER, lower=LOWER)}),
df AS MATERIALIZED (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM dw),
bf AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM bw),
code AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf) u, crc_table),
s AS (SELECT bucket, count(*) AS s FROM df JOIN code USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN code USING (f) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM df) + 10000.0::DOUBLE AS s_all, (SELECT count(*) FROM bf) + 10000.0::DOUBLE AS t_all),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all / ((s + 1.0::DOUBLE) * t_all)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN code USING (f) JOIN g USING (bucket) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
             ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM dw LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) FILTER (able) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM r
"""
