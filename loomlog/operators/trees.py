"""Depths and subtree sums of trees given by parents, by pointer doubling: rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.sources.shared import Step


def _parents(nodes: DataFrame) -> DataFrame:
    """nodes(node, up, ...) with `rooted`: it has no parent. A parent that is no node is none to climb to, but makes no root."""
    known = nodes.select(F.col("node").alias("_n"))
    own = [F.col(c) for c in nodes.columns if c != "up"]
    return nodes.join(known, F.col("up") == F.col("_n"), "left").select(*own, F.col("_n").alias("up"), F.col("up").isNull().alias("rooted"))


def _up(now: DataFrame, *more: str) -> DataFrame:
    """Rows that still climb, with the pointer, steps and root of the node that they point to."""
    to = now.select(F.col("node").alias("_to"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("rooted").alias("_rooted"))
    on = now.where("up IS NOT NULL").join(to, F.col("up") == F.col("_to"))
    return on.select("node", *more, F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_rooted").alias("rooted"))


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth) of every node of nodes(node, up) whose chain of parents ends in a node without one, which has depth 1.

    Each round doubles how far every node points, so a chain of 10,000 takes 14. A node that still climbs when pointers
    reach over all nodes is on a cycle or below one; it has no root, and is left out as are those below a missing parent.
    """
    start = _parents(nodes.select("node", "up")).withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    with Step(start) as step:
        rounds = step.df.count().bit_length() + 1
        while rounds and not step.df.where("up IS NOT NULL").isEmpty():
            step.next(_up(step.df).unionByName(step.df.where("up IS NULL")))
            rounds -= 1
        return step.keep(step.df.where("up IS NULL AND rooted").select("node", (F.col("steps") + 1).alias("depth")))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, values): for every node of nodes(node, up, values), the sums over itself and all nodes below it.

    After k rounds a node holds the sum over those less than 2^k below it, and points to its 2^k-th ancestor. The next
    2^k levels are what the nodes that point to it hold, so each round adds these sums up by pointer, partially before
    the shuffle; there are as many rows as nodes in every round. An edge from a node that is on a cycle or below one is
    not followed, so such nodes stand for themselves.
    """
    linked = _parents(nodes.select("node", "up", *values)).withColumn("steps", F.lit(1).cast("long"))
    with Step(linked) as start:
        rounds = start.df.count().bit_length() + 1
        out = _summed(start, values, rounds)
        if out is None:  # some never reach an end
            with Step(start.df.select("node", "up", "rooted", "steps")) as top:
                for _ in range(rounds):
                    top.next(_up(top.df).unionByName(top.df.where("up IS NULL")))
                lost = top.df.where("up IS NOT NULL").select(F.col("node").alias("_l"))
                cut = start.df.join(lost, F.col("node") == F.col("_l"), "left").withColumn("up", F.when(F.col("_l").isNull(), F.col("up"))).drop("_l")
                start.next(cut)
            out = _summed(start, values, rounds)
        return out


def _summed(start: Step, values: list[str], rounds: int) -> DataFrame | None:
    """The sums after as many rounds as it takes; None if some nodes still climb after `rounds`."""
    step = start
    for _ in range(rounds + 1):
        df = step.df
        if df.where("up IS NOT NULL").isEmpty():
            return step.keep(df.select("node", *values))
        below = df.where("up IS NOT NULL").groupBy(F.col("up").alias("_b")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        moved = _up(df, *values).unionByName(df.where("up IS NULL"))
        sums = [(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values]
        after = moved.join(below, F.col("node") == F.col("_b"), "left").select("node", "up", "rooted", "steps", *sums)
        if step is start:
            step = Step(after)
        else:
            step.next(after)
    step.__exit__()
    return None
