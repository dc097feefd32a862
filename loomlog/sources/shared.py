"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomlog-"))
    return sc.getCheckpointDir()


def listing(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files below paths: equal listings mean equal tables. File names alone reach the driver."""
    fs_of, out = spark._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        where = fs_of(path)
        todo, fs = [where], where.getFileSystem(spark._jsc.hadoopConfiguration())
        while todo:
            for s in fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(session_id, n, x): how many rows a session has and the XOR of their hashes; sessions with other rows differ in one."""
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x"))


#: By application, input folder and table: the listing that a store is up to date with, the store, and the prints of its sources.
_STORED: dict[tuple, tuple] = {}


def stored(spark: SparkSession, key: tuple, seen: tuple, sources: Callable[[], dict[str, DataFrame]], build: Callable[[DataFrame | None], DataFrame], own: Callable) -> DataFrame:
    """The session-grained table build(None), kept in a store (`own`) that follows its sources.

    seen is the listing of the inputs. While it stays the same, the store is read. When it changes, sessions whose
    rows in any source differ are found by their fingerprints, and build(these) is upserted; the others are not derived.
    """
    key, name = (spark.sparkContext.applicationId, *key), key[-1]
    if key in _STORED and _STORED[key][0] == seen:
        return _STORED[key][1].read(name)
    folder = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    prints = {}
    for source, rows in sources().items():  # tables of the same inputs share the prints of a source
        at = (*key[:-1], source, seen)
        if at not in _STORED:
            fingerprints(rows).write.parquet(f"{folder}/prints-{source}")
            _STORED[at] = (f"{folder}/prints-{source}",)
        prints[source] = _STORED[at][0]
    if key not in _STORED:
        first = build(None)
        store = own(spark, folder, {name: ", ".join(f"`{c}` {t}" for c, t in first.dtypes)})
        store.upsert(spark.createDataFrame([], "session_id long"), {name: first})
    else:
        _, store, before = _STORED[key]
        read, changed = spark.read.schema("session_id long, n long, x long").parquet, []
        for source, path in prints.items():
            old, new = read(before[source]), read(path)
            differ = new.join(old.withColumnsRenamed({"n": "n0", "x": "x0"}), "session_id", "full").where("NOT (n <=> n0 AND x <=> x0)")
            changed.append(differ.select("session_id"))
        reduce(DataFrame.unionAll, changed).distinct().write.parquet(f"{folder}/changed")
        these = spark.read.schema("session_id long").parquet(f"{folder}/changed")
        store.upsert(these, {name: build(these)})
    _STORED[key] = (seen, store, prints)
    return store.read(name)


class Step:
    """A table that rounds replace: each is written to the shared folder, which cuts its lineage, and the one before is deleted."""

    def __init__(self, df: DataFrame):
        self.spark, self._path, self._kept = df.sparkSession, None, False
        self.next(df)

    def next(self, df: DataFrame) -> None:
        path, before = f"{shared_dir(self.spark)}/step-{uuid.uuid4().hex}", self._path
        df.write.parquet(path)
        self.df, self._path = self.spark.read.schema(df.schema).parquet(path), path
        self._drop(before)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, which reads the last table, so that it stays."""
        self._kept = True
        return df

    def _drop(self, path: str | None) -> None:
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Step:
        return self

    def __exit__(self, *_: object) -> None:
        if not self._kept:
            self._drop(self._path)
