"""Proportional stratified interleaving: shards of equal row counts, each with the mixture of sources of the whole. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import parts, read, small, written
from loomlog.llm.resample import CRC_SQL, crc_sql

#: Rows that one task numbers at most; short tables are still dealt to SPREAD groups.
GROUP_ROWS, SPREAD = 1 << 16, 64


def _hash60(*parts_: Column) -> Column:
    """A number from 0 to 2^60 - 1 from the MD5 of the parts, joined by colons; null parts are empty."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts_])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def _groups(n: Column) -> Column:
    """How many groups n rows are numbered in."""
    return F.greatest(F.ceil(n / GROUP_ROWS), F.least(F.lit(SPREAD), F.ceil(n / 256))).cast("long")


def _numbered(df: DataFrame, keys: list[str], group: str, order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... over its rows in the order of (group, order), for each combination of keys.

    Groups are numbered apart and their sizes added up, so no task holds more than a group of rows; the table of groups
    has a row for 2^16 rows of df or so.
    """
    sizes = df.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*keys).orderBy(group) if keys else W.orderBy(group)
    base = sizes.withColumn("_base", F.sum("_n").over(upto) - F.col("_n"))
    held = base.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(group).alias("_h"), "_base")
    same = F.col(group) == F.col("_h")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    at = F.row_number().over(W.partitionBy(*keys, group).orderBy(*order)) - 1
    return df.join(small(held), same).withColumn(name, F.col("_base") + at).drop("_h", "_base", *[f"_{k}" for k in keys])


def interleave(docs: DataFrame, shards: int = 40, by: str = "source", ids: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 11) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (0, 1, 2, ... in each shard); columns of these names are replaced.

    1. The rows of each source (column `by`, null is one) are shuffled by a seeded hash of `ids` and ranked.
    2. A row's fractional rank is (rank + phase) / rows of its source. The phase, from 0 to 1, is a seeded hash of the
       source, so that sources of few rows do not all fall into the same place.
    3. All rows are sorted by fractional rank and cut into shards whose row counts are at most one apart. So a shard
       holds a source's share of rows, give or take two.

    Rows of one id keep the order of `ties` and of a hash of the whole row; rows alike in every column are
    interchangeable. Null ids share a hash, but not the order. Rows are not compared by text, so empty and long texts
    are rows like others; texts that are not needed in the result are best left out before. An empty table gives no
    rows, and with fewer rows than shards some shards are empty. Reruns agree. Other columns keep name and value.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*own).alias("d"), F.col(by).cast("string").alias("src"), _hash60(F.lit(seed), F.col(ids)).alias("h"), F.xxhash64(*own).alias("x"))
    rows = written(rows, "shuffled")
    sums = rows.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
    sums = sums.withColumn("phase", _hash60(F.lit(seed), F.col("s")) / F.lit(float(1 << 60))).withColumn("groups", _groups(F.col("n")))
    total = rows.count()
    rows = rows.join(small(sums, "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    share = lambda x, n: F.least(F.floor(x * n), n - 1).cast("long")
    order = ["h", *[F.col(f"d.{c}") for c in ties], "x"]
    ranked = _numbered(rows.withColumn("g", share(F.col("h") / F.lit(float(1 << 60)), F.col("groups"))), ["src"], "g", order, "at")
    ranked = ranked.withColumn("frac", (F.col("at") + F.col("phase")) / F.col("n")).drop("g")
    cells = max(parts(total, GROUP_ROWS), min(SPREAD, parts(total, 256)))
    placed = _numbered(ranked.withColumn("g", share(F.col("frac"), F.lit(cells))), [], "g", ["frac", F.col("src").asc_nulls_first(), "at"], "pos")
    shard = F.expr(f"pos * {shards} div {max(1, total)}")
    placed = placed.withColumn("_shard", shard).withColumn("_slot", F.col("pos") - F.expr(f"(_shard * {total} + {shards - 1}) div {shards}"))
    return placed.select(*[F.col("d")[c].alias(c) for c in own], F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Write a result of interleave as a folder `shard=N` for each shard, its files in the order of slots."""
    files = parts(sharded.count(), rows_per_file)
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(docs, 40, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = f"""
WITH {CRC_SQL},
t AS MATERIALIZED (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc_sql("text")} END AS text_crc32 FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, text_crc32, size) - 1 AS nth,
             count(*) OVER (PARTITION BY source) AS n, ('0x' || substr(md5('11:' || coalesce(source, '')), 1, 15))::BIGINT / (1::BIGINT << 60)::DOUBLE AS phase FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY (nth + phase) / n, source NULLS FIRST, nth) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, pos * 40 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, pos - (shard * total + 39) // 40 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
