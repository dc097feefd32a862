"""A queue of sessions in a fixed order, worked off by pages, of which many go through one job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.sources.shared import Step

#: In how many rounds a queue is worked off at most, so that the number of jobs does not grow with the pages.
ROUNDS = 4
#: Ids up to this number are broadcast.
FEW = 50_000


class Queue:
    """waiting(session_id, ...) with places 0, 1, 2... in the order given, kept in the shared folder until the queue is left.

    Rows are sorted by ranges; a place is that within its range and the sizes of the ranges before, of which there is
    one row each. No rows reach the driver.
    """

    def __init__(self, waiting: DataFrame, order: list[Column | str]):
        ranged = waiting.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id"))
        self._step = Step(ranged)
        rows = self._step.df
        ranges = rows.groupBy("_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        ranges = ranges.withColumn("_before", F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).drop("_n")
        self._rows = rows.join(F.broadcast(ranges), "_range").withColumn("_place", F.expr("_before + _id - _first")).select(*waiting.columns, "_place")
        self.size = rows.count()

    def between(self, start: int, end: int) -> DataFrame:
        """The rows at places start <= place < end."""
        return self._rows.where((F.col("_place") >= start) & (F.col("_place") < end)).drop("_place")

    def ids(self, start: int, end: int) -> DataFrame:
        """session_id of these rows, marked for broadcast if they are few."""
        ids = self.between(start, end).select("session_id")
        return F.broadcast(ids) if end - start <= FEW else ids

    def pages(self, page: int, start: int = 0, end: int | None = None) -> list[int]:
        """Sizes of the pages of the places from start to end."""
        end = self.size if end is None else end
        return [min(page, end - at) for at in range(start, end, page)]

    def rounds(self, page: int) -> Iterator[tuple[int, int]]:
        """(start, end) of runs of whole pages, first to last: one page each while there are few, else ROUNDS runs."""
        run = page * max(1, -(-len(self.pages(page)) // ROUNDS))
        return ((at, min(at + run, self.size)) for at in range(0, self.size, run))

    def __enter__(self) -> Queue:
        return self

    def __exit__(self, *error: object) -> None:
        self._step.__exit__(*error)
