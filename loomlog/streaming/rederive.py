"""Which sessions are to be derived, and how long a failure waits; see drain for the deriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backoff_seconds(failures: Column, first: int = 30, most: int = 3600) -> Column:
    """L4: the wait after so many failures in a row: `first`, doubled each time, up to `most`."""
    return F.least(F.lit(most), F.lit(first) * F.pow(2, F.least(failures - 1, F.lit(20)))).cast("long")


def due(state: DataFrame, epoch: int, now: Column) -> DataFrame:
    """L2/L3: sessions with new bytes, of an older epoch, or whose retry has come; a failure waits for its retry or new bytes."""
    retry = F.col("retry_at").isNotNull() & (F.col("retry_at") <= now)
    pinned = F.col("failed_epoch").eqNullSafe(F.lit(epoch)) & (F.col("failed_bytes") == F.col("raw_bytes"))
    return state.where(retry | (~pinned & F.col("retry_at").isNull() & ((F.col("raw_bytes") > F.col("parsed_bytes")) | (F.col("epoch") < epoch))))
