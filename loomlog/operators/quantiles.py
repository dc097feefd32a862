"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of a doubling of the value; a cell holds the values within about one per cent of each other.
CELLS = 64


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = (), discrete: bool = False) -> DataFrame:
    """(by, one column for each name in wanted): exact quantiles of the values that are not null and not negative.

    Continuous ones interpolate between neighbours; discrete ones are the first value whose rank reaches the share.
    Equal values are counted first. Their counts are summed by cell, a running sum over the cells of a key (some
    thousands at most) tells in which cell each rank lies, and only those cells are looked into, cell by cell.
    """
    by = list(by) or ["_k"]
    counts = df.where(F.col(value).isNotNull()).withColumn("_k", F.lit(1)).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_c", F.floor(F.log2(F.col("_v") + 1) * CELLS))
    cells = counts.groupBy(*by, "_c").agg(F.sum("_n").alias("_s"))
    cells = cells.withColumn("_to", F.sum("_s").over(W.partitionBy(*by).orderBy("_c"))).withColumn("_all", F.sum("_s").over(W.partitionBy(*by)))
    places = []
    for name, p in wanted.items():
        at = F.greatest(F.ceil(F.round(F.lit(p) * F.col("_all"), 9)) - 1, F.lit(0)).cast("double") if discrete else (F.col("_all") - 1) * F.lit(p)
        places += [F.struct(F.lit(name).alias("name"), at.alias("at"), side.cast("long").alias("rank")) for side in (F.floor(at), F.ceil(at))]
    sought = cells.select(*by, "_c", (F.col("_to") - F.col("_s")).alias("_from"), "_to", F.explode(F.array(*places)).alias("q"))
    sought = sought.where("q.rank >= _from AND q.rank < _to").select(*by, "_c", "_from", "q.*").distinct()
    upto = F.sum("_n").over(W.partitionBy(*by, "name", "rank").orderBy("_v"))
    found = counts.join(F.broadcast(sought), [*by, "_c"]).withColumn("_to", F.col("_from") + upto).where("_to > rank")
    ends = found.groupBy(*by, "name", "at", "rank").agg(F.min("_v").alias("v")).groupBy(*by, "name", "at").agg(F.min_by("v", "rank").alias("lo"), F.max_by("v", "rank").alias("hi"))
    ends = ends.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at")) if not discrete else F.col("lo"))
    out = ends.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])
    return out if by != ["_k"] else out.drop("_k")
