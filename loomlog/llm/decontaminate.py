"""Benchmark decontamination: containment search for short items inside long documents, natively in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import read, small, written

#: Words here are runs of letters and digits, lower-cased, so that punctuation around a quoted passage does not matter.
TOKEN = r"[\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _runs(column: str, length, make) -> Column:
    """make(run) of every run of `length` words of an array column; none if it has fewer words, or none at all."""
    n = F.size(column)
    starts = F.sequence(F.lit(1), n - length + 1)
    return F.when((n > 0) & (n >= length), F.transform(starts, lambda i: make(F.slice(column, i, length))))


def _text(run: Column) -> Column:
    return F.array_join(run, " ")


def _hashed(df: DataFrame) -> DataFrame:
    """df(id, text) -> (id, w: hashes of the words in order); they are hashed again by run, which makes no strings."""
    return df.select("id", F.transform(_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))


def _own_length(k: int) -> Column:
    """The shingle length of an item with words w: k, or all its words if it has fewer."""
    return F.least(F.lit(k), F.size("w"))


def _every(lengths: list[int], make) -> Column:
    """The runs of w of all these lengths in one array."""
    none = F.array().cast("array<long>" if make is F.xxhash64 else "array<string>")
    every = [F.coalesce(_runs("w", F.lit(n), make), none) for n in lengths]
    return every[0] if len(every) == 1 else F.concat(*every)


def item_sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(h, item_id, length, part): the least hashes of each item, as many as its size partition needs.

    Items are partitioned by their shingle length, which is k or, of items below k words, the number of their words,
    and then by powers of two of their number of distinct shingles. If at least `threshold` of an item is in a
    document, fewer than floor((1 - threshold) * n) + 1 of its shingles are missing there, so that many least hashes
    (a bottom-k MinHash sketch) always hold one that the document has. A partition uses its largest n, so that its
    depth is one number; no containment at or above the threshold can be missed.
    """
    each = _hashed(items).select(F.col("id").alias("item_id"), _own_length(k).alias("length"), F.array_sort(F.array_distinct(_runs("w", _own_length(k), F.xxhash64))).alias("s"))
    each = each.where("length > 0").withColumn("part", F.floor(F.log2(F.size("s"))).cast("int"))
    depth = each.groupBy("length", "part").agg((F.floor((1 - threshold) * F.max(F.size("s")) + 1e-9) + 1).cast("int").alias("depth"))
    return each.join(F.broadcast(depth), ["length", "part"]).select("length", "part", "item_id", F.explode(F.slice("s", F.lit(1), F.col("depth"))).alias("h"))


def find_contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, containment) for every item of which at least `threshold` of the distinct shingles are in a document.

    An item is cut into shingles of k words, one of fewer words into a single shingle of all of them, and documents into
    shingles of every length that an item has; so an item of one to k - 1 words is in each document that holds these
    words in a row. docs: (doc_id, text), items: (item_id, text); other columns are neither read nor returned, whatever
    their names. Rows that share an id are one document, or one item, and a hit is given once. Null texts have no words;
    an item without words is in no document. Ids may be null. Long texts are taken whole. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    items = items.select(F.col("item_id").alias("id"), "text")
    sketch = written(item_sketches(items, k, threshold), "sketch")
    # at most k lengths; of a document only hashes up to the deepest sketch can meet one: most shingles end here, before any join
    tops = {r["length"]: r["top"] for r in sketch.groupBy("length").agg(F.max("h").alias("top")).collect()}
    if not tops:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")
    lengths, top = sorted(tops), max(tops.values())
    # explode_outer here and below: for explode Spark would test for empty arrays first, building each array once more
    probes = _hashed(docs).withColumn("s", _every(lengths, F.xxhash64)).select(F.col("id").alias("doc_id"), F.explode_outer(F.filter("s", lambda h: h <= top)).alias("h")).where("h is not null")
    found = written(probes.join(small(sketch.select("h", "item_id").distinct()), "h").select("doc_id", "item_id").distinct(), "candidates")
    ids = found.select(F.col("doc_id").alias("c")).distinct()
    some = docs.join(small(ids), F.col("id").eqNullSafe(F.col("c")), "left_semi")
    words = lambda df: df.select("id", _tokens(F.col("text")).alias("w"))
    texts = lambda df, runs: df.withColumn("s", runs).select("id", F.explode_outer("s").alias("s")).where("s is not null").distinct()
    parts = texts(words(items), _runs("w", _own_length(k), _text)).withColumnRenamed("id", "item_id")
    sizes = parts.groupBy(F.col("item_id").alias("i")).agg(F.count("*").alias("n"))
    hits = texts(words(some), _every(lengths, _text)).withColumnRenamed("id", "doc_id").join(small(parts, "s"), "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    out = hits.join(small(sizes), F.col("item_id").eqNullSafe(F.col("i"))).where(F.col("hits") >= F.lit(threshold) * F.col("n") - 1e-9)
    return out.select("doc_id", "item_id", (F.col("hits") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """docs without the rows whose doc_id holds an item."""
    gone = find_contained(docs, items, **params).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    hits = find_contained(docs, items).groupBy(F.col("doc_id").alias("d")).agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"), F.max("containment").alias("best")
    )
    out = docs.select("doc_id").join(hits, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select(
        "doc_id", F.col("d").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best_containment"),
    )


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(5, len(w)) AS l FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + l - 1], ' ') FOR i IN range(1, len(w) - l + 2)]) AS s FROM bl),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + l - 1], ' ') FOR i IN range(1, len(w) - l + 2)]) AS s
       FROM t, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
m AS (SELECT doc_id, item_id, hits / n AS c FROM h JOIN n USING (item_id) WHERE hits >= 0.8 * n),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids, max(c) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids,
       round(coalesce(best, 0.0), 6) AS best_containment
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
