"""Substring deduplication by sliding spans of consecutive sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, UPPER, read, written

#: A sentence: words up to a mark or line end, with the marks and blanks after it; the first one also has those before it.
SENTENCE = r"[.!?\x20\x09-\x0D]*[^.!?\x20\x09-\x0D][^.!?\n]*[.!?\x20\x09-\x0D]*"
_BLANKS = r"[\x20\x09-\x0D]+"


def _pieces(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def repeated_spans(docs: DataFrame, span: int = 2, min_words: int = 10) -> DataFrame:
    """(doc_id, gone): positions of the sentences covered by a non-first occurrence of a repeated span.

    From every sentence on, the run of at least `span` consecutive sentences with at least `min_words` words is hashed
    (blanks squeezed, A-Z lower-cased, 128 bits) and compared over all documents, so a passage of short sentences
    makes longer runs. A text that has no such run is one run as a whole; a text without words has none. The first
    occurrence is that of smallest (doc_id, position), null doc_ids first. Rows that share a doc_id are one document,
    so they do not repeat each other.
    """
    norm = F.transform(_pieces(F.col("text")), lambda s: F.trim(F.translate(F.regexp_replace(s, _BLANKS, " "), UPPER, LOWER)))
    df = docs.select("doc_id", norm.alias("s"))
    df = df.select("doc_id", F.transform("s", lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(s, F.lit(1)).alias("b"), F.size(F.split(s, " ")).alias("w"))).alias("s"))
    n = F.size("s")
    words = lambda i, k: F.aggregate(F.slice("s", i, F.lit(k)), F.lit(0), lambda t, x: t + x["w"])
    # a sentence has a word at least, so min_words of them are enough
    enough = lambda i: F.coalesce(*[F.when((i + k - 1 <= n) & (words(i, k) >= min_words), k) for k in range(span, max(span, min_words) + 1)])
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.struct((i - 1).alias("pos"), enough(i).alias("len"))))
    found = F.filter(starts, lambda r: r["len"].isNotNull())
    df = df.select("doc_id", "s", n.alias("n"), found.alias("runs"))
    runs = F.when(F.size("runs") > 0, F.col("runs")).when(F.col("n") > 0, F.array(F.struct(F.lit(0).alias("pos"), F.col("n").alias("len"))))
    hashed = lambda r, c: F.xxhash64(F.transform(F.slice("s", r["pos"] + 1, r["len"]), lambda x: x[c]))
    each = F.transform(runs, lambda r: F.struct(r["pos"].alias("pos"), r["len"].alias("len"), hashed(r, "a").alias("a"), hashed(r, "b").alias("b")))
    # _outer: for inline Spark would test for empty arrays first, building each array once more
    spans = df.select("doc_id", F.inline_outer(each)).where("pos is not null")
    first = spans.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1")
    first = written(first.select("a", "b", F.col("first.doc_id").alias("f_id"), F.col("first.pos").alias("f_pos")), "spans")
    again = spans.join(first, ["a", "b"]).where(~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("pos") == F.col("f_pos"))))
    gone = again.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "len")).alias("at"))
    return gone.select("doc_id", F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))).alias("gone"))


def dedup_spans(docs: DataFrame, **params) -> DataFrame:
    """docs with text cut to the sentences that stay, plus n_sentences and n_removed (which replace columns of that name).

    A text that loses nothing is returned as it is, so null stays null, and a text without words has no sentence.
    Empty tables give empty results. Other columns keep their name and value, whatever it is. A long text costs time in
    proportion to its sentences.
    """
    gone = repeated_spans(docs, **params)
    own = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    out = docs.select(F.struct(*own).alias("d")).join(gone, F.col("d.doc_id").eqNullSafe(gone["doc_id"]), "left")
    text = F.col("d.text")
    out = out.select("d", "gone", _pieces(text).alias("p"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("p") - 1), "gone"), lambda i: F.get("p", i))
    # a text with a run to lose has a sentence, so the sequence goes upwards
    out = out.select("d", F.size("p").alias("n"), F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    cut = F.coalesce(F.size("kept") < F.col("n"), F.lit(False))
    return out.select(
        *[F.when(cut, F.array_join("kept", "")).otherwise(text).alias("text") if c == "text" else F.col("d")[c].alias(c) for c in own],
        F.col("n").cast("long").alias("n_sentences"), F.when(cut, F.col("n") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
    )


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS p FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece, len(p) AS n FROM t),
s AS (SELECT doc_id, i, n, trim(translate(regexp_replace(piece, '{_BLANKS}', ' ', 'g'), '{UPPER}', '{LOWER}')) AS s FROM e),
v AS (SELECT *, len(string_split(s, ' ')) AS w, sum(len(string_split(s, ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s),
j AS (SELECT a.doc_id, a.i, a.n, min(b.i) - a.i + 1 AS len FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 9 AND b.upto - a.upto + a.w >= 10 GROUP BY a.doc_id, a.i, a.n),
k AS (SELECT doc_id, i, len FROM j UNION ALL SELECT doc_id, 1, any_value(n) FROM v WHERE doc_id NOT IN (SELECT doc_id FROM j) GROUP BY doc_id),
h AS (SELECT k.doc_id, k.i, k.len, string_agg(v.s, chr(1) ORDER BY v.i) AS run FROM k JOIN v ON k.doc_id = v.doc_id AND v.i BETWEEN k.i AND k.i + k.len - 1 GROUP BY k.doc_id, k.i, k.len),
f AS (SELECT run, min((doc_id, i)) AS first FROM h GROUP BY run HAVING count(*) > 1),
a AS (SELECT doc_id, i, len FROM h JOIN f USING (run) WHERE (doc_id, i) <> first),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS i FROM a),
m AS (SELECT e.doc_id, e.i, e.piece, c.i IS NOT NULL AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i),
o AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN n_removed > 0 THEN kept ELSE t.text END) AS kept_sha256
FROM t LEFT JOIN o USING (doc_id)
"""
