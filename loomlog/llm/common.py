"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.shared import shared_dir

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; no words for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


#: Paths that the run at hand has written; threads have their own, so runs beside it never delete them.
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


@contextmanager
def run_tables(spark: SparkSession):
    """Within it, `written` and `at_path` note their tables in the list it gives; at its end those left in the list are deleted.

    What is to outlive it is taken out of the list. Runs may nest. If the driver is lost, the tables stay.
    """
    made: list[str] = []
    token = _RUN.set(made)
    try:
        yield made
    finally:
        _RUN.reset(token)
        delete(spark, made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _noted(path: str) -> str:
    run = _RUN.get()
    if run is not None:
        run.append(path)
    return path


def at_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which a run deletes like those of `written`."""
    return _noted(f"{shared_dir(spark)}/{name}")


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage; `by` names a column to store it by, options are the writer's."""
    spark = df.sparkSession
    path = _noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a broadcast table may hold at most.
SMALL_ROWS, SMALL_BYTES = 500_000, 64 << 20


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """df, marked for broadcast if it holds at most SMALL_ROWS rows and, in the string column `text`, SMALL_BYTES bytes."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    few = df.limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.max(F.lit(0)) if not text else size.alias("size")).first()
    return F.broadcast(df) if few[0] <= SMALL_ROWS and (few[1] or 0) <= SMALL_BYTES else df


def parts(total: float, each: float) -> int:
    """How many groups of about `each` units hold `total` units."""
    return max(1, int(-(-total // each)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (src, dst), for every node of an edge.

    Alternates large-star and small-star contraction, which needs about log(nodes) rounds; each round is written to
    the shared folder. No edges give no rows.
    """
    e = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst"), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        hung = down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        e = written(hung.union(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")).union(e.select("dst", "dst").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# Counts by hash, asked for and answered in packed form ------------------------------------------------------------
#
# One row per n-gram would cost several times its hash in row headers at every shuffle. So the documents are dealt to
# chunks; each chunk sends every hash partition ONE row with the sorted distinct hashes it holds and their counts, and
# gets back the totals in the same order. A hash that a third of all rows hold is thus sent once per chunk.


def pack(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """Distinct sorted uint64 keys with counts -> a row for each hash partition."""
    order, edges = by_bucket(keys, buckets)
    k, c = keys[order], counts[order].astype("<u4")
    rows = [(chunk, b, k[s:t].tobytes(), c[s:t].tobytes()) for b, s, t in edges]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "counts"])


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    ends = np.cumsum(np.bincount(b, minlength=buckets))
    return order, [(i, int(t - n), int(t)) for i, (t, n) in enumerate(zip(ends, np.diff(ends, prepend=0), strict=True)) if n]


REQUEST = "chunk long, bucket int, keys binary, counts binary"
REPLY = "chunk long, bucket int, totals binary"


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """All requests to one hash partition -> the totals of each request's hashes."""
    keys = [np.frombuffer(x, "<u8") for x in pdf["keys"]]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]))[inverse].astype("<u8")
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "totals": [x.tobytes() for x in np.split(totals, cuts)]})


def counted(docs: DataFrame, request: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """docs with a column chunk -> replies; request packs one chunk's keys."""
    return docs.groupBy("chunk").applyInPandas(request, REQUEST).groupBy("bucket").applyInPandas(answer, REPLY)


def totals_of(keys: np.ndarray, buckets: int, replies: pd.DataFrame) -> np.ndarray:
    """Totals for one chunk's sorted distinct keys from the replies it got."""
    order, edges = by_bucket(keys, buckets)
    got = dict(zip(replies["bucket"], replies["totals"], strict=True))
    out = np.zeros(len(keys), np.uint64)
    for b, s, t in edges:
        out[order[s:t]] = np.frombuffer(got[b], "<u8")
    return out
