"""SimHash fingerprints, linked within a Hamming radius by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import connected_components, read, small, written


def runs(data: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `shingle` words of a UTF-8 text, repeats included: A-Z lower-cased, words between ASCII blanks.

    A text of fewer words is one run; a text without words has none.
    """
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(tokens))
    starts, stops = (ends - lengths)[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:t], seed) for s, t in zip(starts, stops, strict=True)), np.uint64, len(starts))


def bits_of(h: np.ndarray) -> int:
    """64-bit SimHash of hashes, repeats counted; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the runs of a text; no words: 0."""
    return bits_of(runs(data, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a row for each row of docs; null texts count as empty. Other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "doc_id long, fp long")


def _ring(rows: DataFrame, m: int, radius: int, width: int = 8) -> tuple[DataFrame, DataFrame]:
    """rows (g, x, fp), x of m segments -> (bucket members, what is left of them): one pass of pigeonring over groups g.

    If two x differ in at most `radius` bits, some chain of consecutive segments keeps every prefix of length l within
    l * radius / m differences. The leading segments whose budget is below one are equal, so they are the key; the
    members keep the turned x, which the longer prefixes are checked on.
    """
    lead, bits = -(-m // radius) - 1, m * width
    whole, key = f"{(1 << bits) - 1}L" if bits < 64 else "-1L", f"{(1 << (width * lead)) - 1}L"
    turned = rows.select("g", "fp", "x", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    turned = turned.withColumn("x", F.expr(f"(shiftrightunsigned(x, {width} * i) | if(i = 0, 0L, shiftleft(x, {bits} - {width} * i))) & {whole}"))
    return turned.select(F.xxhash64("g", "i", F.expr(f"x & {key}")).alias("g"), "fp", "x", F.expr(f"shiftrightunsigned(x, {width * lead})").alias("rest")), lead


def pigeonring_links(fps: DataFrame, radius: int = 2, bucket: int = 32) -> DataFrame:
    """(src, dst): links that join any two distinct fingerprints at most `radius` bits apart (2, no other), directly or over others.

    The 64 bits are a ring of eight segments, see _ring. Members of a bucket are compared in pairs: prefixes of chains
    first, and only then the full distance. A bucket of more than `bucket` members goes through the ring again on the
    bits that it does not share, where the whole budget is left: 40 bits, then 24, then 16. Buckets that are still
    crowded when 16 bits are left are linked through shared one-bit neighbours of these bits, which is exact (a shared
    neighbour means two bits or fewer, and two bits or fewer means a shared neighbour), in 17 rows a member.
    """
    if radius != 2:
        raise ValueError("radius must be 2")
    rows, m, width, found = fps.select(F.lit(0).cast("long").alias("g"), F.col("fp").alias("x"), "fp"), 8, 8, []
    while m > radius:
        keyed, lead = _ring(rows, m, radius, width)
        sizes = written(keyed.groupBy("g").count().where("count > 1"), "buckets")
        few = keyed.join(sizes.where(F.col("count") <= bucket).select("g"), "g")
        pairs = few.alias("a").join(few.alias("b"), "g").where("a.fp < b.fp").select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"), F.col("a.x").bitwiseXOR(F.col("b.x")).alias("d"))
        for n in range(lead + 1, m):
            pairs = pairs.where(F.expr(f"bit_count(d & {(1 << (width * n)) - 1}L) <= {n * radius // m}"))
        found.append(pairs.where(F.bit_count(F.expr("src ^ dst")) <= radius).select("src", "dst"))
        crowd = sizes.where(F.col("count") > bucket).select("g")
        if crowd.isEmpty():
            rows = None
            break
        rows, m = written(keyed.join(crowd, "g").select("g", F.col("rest").alias("x"), "fp"), "crowd"), m - lead
    if rows is not None:
        flips = F.concat(F.array("x"), F.transform(F.sequence(F.lit(0), F.lit(m * width - 1)), lambda b: F.expr("x").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
        spread = rows.select("g", "fp", F.explode(flips).alias("key"))
        hubs = spread.groupBy("g", "key").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").select("g", "key", "dst")
        found.append(spread.join(hubs, ["g", "key"]).where(F.col("fp") != F.col("dst")).select(F.col("fp").alias("src"), "dst"))
    return reduce(DataFrame.unionAll, found).distinct()


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups, named by their smallest doc_id.

    A row for each row of docs. Null and empty texts have fingerprint 0 and are linked like any other. Rows with a
    null doc_id take part; a group of only such rows has a null component_id. An empty table gives no rows. Equal
    fingerprints are collapsed first, so groups of exact copies cost one row. Columns other than doc_id and text are
    neither read nor returned.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = connected_components(pigeonring_links(distinct.select("fp"), radius))
    tagged = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = tagged.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = written(tagged.join(named, "component").select("fp", "component_id"), "components")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one document of each group of groups(doc_id, component_id), that of its smallest doc_id; all columns are kept.

    Rows that repeat a doc_id stay once for each distinct text. Rows without a doc_id go if their group has one, and
    else stay once for each distinct text.
    """
    groups = groups.select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_c"))
    named = small(groups.where(F.col("_id").eqNullSafe(F.col("_c"))).select("_id").distinct())
    kept = docs.join(named, docs["doc_id"].eqNullSafe(named["_id"]), "left_semi")
    # only rows that share a doc_id are compared as wholes
    many = written(docs.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "repeated")
    if many.isEmpty():
        return kept
    many = small(many)
    alone = kept.join(many, kept["doc_id"].eqNullSafe(many["_id"]), "left_anti")
    return alone.unionByName(kept.join(many, kept["doc_id"].eqNullSafe(many["_id"]), "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each group, as keep_first keeps them."""
    return keep_first(docs, simhash_groups(docs, **params))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
