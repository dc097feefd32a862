"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id. The keys seen so far live in sorted runs on levels; a batch merge-anti-joins
the runs, appends the keys it is first to hold as a new run of level 0, and `fanout` runs of one level are merged into one
run of the next. Runs are bucketed and sorted by hash alike, so a batch shuffles its own keys alone: runs are read bucket
by bucket beside it and are never shuffled. A line stays where its key's first document is and goes elsewhere.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, UPPER, at_path, parts, read, written

#: Text of one batch of documents, and of one bucket of all runs together. Beyond MOST batches these grow instead, as each
#: reads all runs before it; a batch is shuffled with spilling, so its size is bounded by no memory.
BATCH_BYTES, BUCKET_BYTES, MOST = 64 << 30, 4 << 30, 16

#: What is stripped from both ends of a line before it is compared.
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"  # not $, which in Java also matches before a final line end of any kind


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """Levels of runs (h1, h2, first_id), stored in buckets of the hash, each sorted by it; a key is in one run only.

    Spark knows bucketed tables by name alone, so runs are named in the session's catalog until `close`. Their files lie
    in the shared folder.
    """

    KEY = ["h1", "h2"]

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def new(self, keys: DataFrame) -> DataFrame:
        """keys, dealt to the buckets of the runs, without those that any run holds."""
        keys = keys.repartition(self.buckets, *self.KEY)
        for name in (name for level in self.levels for name in level):
            keys = keys.join(self.spark.table(name).select(*self.KEY).hint("merge"), self.KEY, "left_anti")
        return keys

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Store a run whose tasks hold a bucket each, and merge its level if it is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"run_{uuid.uuid4().hex}"
        path = at_path(self.spark, name)
        run.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("path", path).saveAsTable(name)
        self.paths[name] = path
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.add(reduce(self._merged, [self.spark.table(n) for n in old]), level + 1)
            for n in old:
                self._drop(n)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: no key is in both, so a full join by merging puts them together bucket by bucket."""
        both = a.join(b.select("h1", "h2", F.col("first_id").alias("other"), F.lit(True).alias("of_b")).hint("merge"), Runs.KEY, "full")
        return both.select("h1", "h2", F.when(F.col("of_b"), F.col("other")).otherwise(F.col("first_id")).alias("first_id"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        del self.paths[name]

    def close(self) -> DataFrame:
        """All keys; the names go, the files stay."""
        schema = "h1 long, h2 long, first_id long"
        out = self.spark.read.schema(schema).parquet(*self.paths.values()) if self.paths else self.spark.createDataFrame([], schema)
        for name in list(self.paths):
            self._drop(name)
        return out


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """(doc_id, drop): positions of the lines to drop, for the documents that lose any.

    Null doc_ids sort before all others. Rows that share a doc_id are one document: none of them makes another's line
    a repeat. Keys are compared by 128 bits of hash. Null or empty texts have one empty line, which is too short to go.
    A batch holds about BATCH_BYTES of text, or more if that made over MOST batches, unless their number is given; no
    result depends on it. Line hashes are stored by batch, so that a batch reads its own alone. A line that many
    documents hold is one row of its batch before it is dealt to a bucket.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = batches or min(MOST, max(4, parts(n_bytes, BATCH_BYTES)))
    at = docs.select(F.col("doc_id").cast("long")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.5 / batches) if batches > 1 else []
    edges = sorted({int(x) for x in at})
    # a null doc_id falls to batch 0
    batch = F.aggregate(F.array(*[F.lit(e) for e in edges]).cast("array<long>"), F.lit(0), lambda n, e: n + F.coalesce((F.col("doc_id") > e).cast("int"), F.lit(0)))
    keyed = docs.select("doc_id", batch.alias("batch"), F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
    keyed = keyed.select("doc_id", "batch", "pos", F.translate(F.regexp_replace("line", _ENDS, ""), UPPER, LOWER).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    lines = written(keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "batch"), "lines", by="batch")
    runs = Runs(docs.sparkSession, max(8, parts(n_bytes, BUCKET_BYTES)), fanout)
    try:
        for i in range(len(edges) + 1):
            mine = lines.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nul"))
            runs.add(runs.new(mine.select("h1", "h2", F.when(~F.col("nul"), F.col("low")).cast("long").alias("first_id"))))
    finally:
        first = runs.close()
    gone = lines.join(first, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """docs with text cut to the lines that stay, plus n_lines and n_dropped (these two replace columns of that name).

    A text that loses nothing is returned as it is (null stays null); empty tables give empty results. If all lines
    go, the text is empty. Rows that share a doc_id lose the same line positions. Other columns keep their name and
    value, whatever it is. A long text costs time in proportion to its lines.
    """
    drop = repeated_lines(docs, **params)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = docs.select(F.struct(*own).alias("d")).join(drop, F.col("d.doc_id").eqNullSafe(drop["doc_id"]), "left").select("d", "drop")
    text = F.col("d.text")
    out = out.select("d", "drop", _lines(text).alias("lines"))  # a column, so that it is split once
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"), lambda i: F.get("lines", i))
    out = out.select("d", F.size("lines").alias("n"), F.when(F.col("drop").isNotNull(), kept).alias("kept"))
    cut = F.coalesce(F.size("kept") < F.col("n"), F.lit(False))
    return out.select(
        *[F.when(cut, F.array_join("kept", "\n")).otherwise(text).alias("text") if c == "text" else F.col("d")[c].alias(c) for c in own],
        F.col("n").cast("long").alias("n_lines"), F.when(cut, F.col("n") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
                  unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
