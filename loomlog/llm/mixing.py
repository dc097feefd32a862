"""Mixing sources to target weights by fixed-length token blocks, from sizes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import parts, read, small, words, written

#: Rounds of the index permutation, and how often it is applied at most until the index is one of the source.
ROUNDS, WALKS = 6, 96


def _u(*key: Column) -> Column:
    """A uniform draw in [0, 1) from 53 bits of the key's hash; the key is of longs."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """sizes(source, source_size, and other columns) with target.

    Sources by code point, null last, take the weights in turn and share 100% of all sizes by weight. A target stops at
    cap times its source's size, and the excess is shared again by weight until none is above. That is a water level:
    sources are filled in order of cap * size / weight, and the level is the first that the next one can hold.
    """
    n, some = len(weights), F.col("source_size") > 0
    s = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.when(some, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % n + 1).cast("int"))).otherwise(0.0))
    s = s.withColumn("cap", cap * F.col("source_size")).withColumn("r", F.when(some, F.col("cap") / F.col("w")))
    before = W.orderBy(F.col("r").asc_nulls_last(), "k").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("all_w", F.sum("w").over(W.partitionBy())).withColumn("all_size", F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("level", F.try_divide(F.col("all_size") - F.col("capped"), F.col("all_w") - F.col("used")))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "k", "level"))).over(W.partitionBy())["level"])
    target = F.when(some, F.least("cap", F.col("w") * F.coalesce("water", F.lit(float("inf"))))).otherwise(0.0)
    return s.select(*sizes.columns, target.alias("target"))


def _offsets(df: DataFrame, key: str, order: Column, group: Column, value: str, name: str, levels: int = 3) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before this one in its key, in the order of (group, order).

    By levels, so that no task sees a whole key: sums by (key, group), a running sum over those (at another level by
    groups of 1024 groups), and one in each group.
    """
    g, k, h = f"_g{levels}", f"_k{levels}", f"_h{levels}"
    df = df.withColumn(g, group)
    sums = df.groupBy(key, g).agg(F.sum(value).alias("_s"))
    if levels > 2:
        base = _offsets(sums, key, F.col(g), F.expr(f"{g} div 1024"), "_s", f"_base{levels}", levels - 1)
    else:
        base = sums.withColumn(f"_base{levels}", F.sum("_s").over(W.partitionBy(key).orderBy(g)) - F.col("_s"))
    base = base.select(F.col(key).alias(k), F.col(g).alias(h), f"_base{levels}")
    df = df.join(base, F.col(key).eqNullSafe(F.col(k)) & (F.col(g) == F.col(h)))
    inner = W.partitionBy(key, g).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(value).over(inner) - F.col(value) + F.col(f"_base{levels}")).drop(g, k, h, f"_base{levels}")


def _within(df: DataFrame, x: str, spans: DataFrame, cells: int) -> DataFrame:
    """df joined to the row of spans(lo, hi, ...) with lo <= x < hi, x in [0, 1); spans are apart.

    [0, 1) is cut into cells; a span is listed under each cell that it touches, so the join is on equal cells and the
    list has no more rows than spans and cells together.
    """
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("long")
    listed = spans.where("lo < hi").withColumn("_c", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    return df.withColumn("_c", cell(F.col(x))).join(small(listed), "_c").where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("_c", "lo", "hi")


def draw_slots(plan: DataFrame, slots: int, seed: int) -> DataFrame:
    """(shard, sid, n_blocks, j): which use j of its source every slot of the output is, from plan(sid, n_blocks, quota, all_slots).

    A shard is a run of `slots` slots, and its counts of sources are one multinomial draw: each slot takes a source by
    its share of all quotas, independently. Over all shards a source then has some slots more or less than its quota.
    That residual is settled slot by slot: a source's slots beyond its quota, in the order of shards, are given to the
    sources that lack some, in the order of sources. So totals equal quotas, and all but the surplus is as drawn.
    """
    spark = plan.sparkSession
    total, sources = plan.agg(F.max("all_slots"), F.count("*")).first()
    cells = 4 * sources
    upto = W.orderBy("sid")
    share = plan.withColumn("hi", F.sum("quota").over(upto) / F.col("all_slots")).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    each = spark.range(0, total, 1, parts(total, 1 << 19)).select(F.expr(f"id div {slots}").alias("shard"), _u(F.lit(seed).cast("long"), F.col("id")).alias("u"))
    counts = _within(each, "u", share.select("lo", "hi", "sid", "n_blocks", "quota"), cells).groupBy("shard", "sid", "n_blocks", "quota").agg(F.count("*").alias("n"))
    counts = written(_offsets(counts, "sid", F.col("shard"), F.expr("shard div 1024"), "n", "j0"), "draws")
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("j0")))
    held = counts.withColumn("kept", kept).repartition(parts(total, 1 << 19), "shard", "sid")
    drawn = held.where("kept > 0").select("shard", "sid", "n_blocks", F.explode(F.sequence("j0", F.col("j0") + F.col("kept") - 1)).alias("j"))

    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    lack = plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("lack", F.greatest(F.lit(0), F.col("quota") - F.col("got")))
    lack = lack.withColumn("to", F.sum("lack").over(upto)).withColumn("from", F.col("to") - F.col("lack")).withColumn("all", F.sum("lack").over(W.partitionBy()))
    lack = written(lack, "lack")
    over = held.withColumn("s", F.col("n") - F.col("kept")).groupBy("shard").agg(F.sum("s").alias("s")).where("s > 0").withColumn("k", F.lit(0))
    over = written(over, "over")
    free = _offsets(over, "k", F.col("shard"), F.expr("shard div 1024"), "s", "f0").select("shard", F.explode(F.sequence("f0", F.col("f0") + F.col("s") - 1)).alias("f"))
    most = lack.agg(F.max("all")).first()[0]
    # x is half a step up, so that rounding leaves every f inside its span
    spans = lack.where("lack > 0").select((F.col("from") / most).alias("lo"), (F.col("to") / most).alias("hi"), "sid", "n_blocks", "got", "from") if most else None
    if spans is None:
        return drawn
    settled = _within(free.withColumn("x", (F.col("f") + 0.5) / most), "x", spans, cells).select("shard", "sid", "n_blocks", (F.col("got") + F.col("f") - F.col("from")).alias("j"))
    return drawn.unionAll(settled)


def read_blocks(slots: DataFrame, seed: int) -> DataFrame:
    """(sid, block) of slots(sid, n_blocks, j): use j of a source reads the block at place j mod n of a keyed permutation.

    The key is seed, sid and the pass j div n, so each pass reads all n blocks once in an order of its own. Indexes of
    as many bits as n - 1 has are permuted by a Feistel network, whose rounds add a hash of one half to the other. An
    index that falls outside the source is permuted again until it is inside, which visits every index inside once.
    With fewer than half of the indexes outside, WALKS steps fall short with a chance of 2^-96; that would be an error.
    """
    own = slots.select("sid", "n_blocks", (F.col("j") % F.col("n_blocks")).alias("at"), F.expr("j div n_blocks").alias("turn"), F.greatest(F.lit(2), F.length(F.bin(F.col("n_blocks") - 1))).alias("bits"))
    own = own.select("sid", "n_blocks", "at", "turn", F.expr("cast(bits - bits div 2 AS int)").alias("low"), F.expr("shiftleft(1L, bits - bits div 2) - 1").alias("lows"), F.expr("shiftleft(1L, bits div 2) - 1").alias("highs"))

    def half(i: Column, part: Column) -> Column:
        return F.xxhash64(F.lit(seed + 1).cast("long"), F.col("sid"), F.col("turn"), i, part)

    def step(v: Column, i: Column) -> Column:
        to_high = F.call_function("shiftleft", half(i, v.bitwiseAND(F.col("lows"))).bitwiseAND(F.col("highs")), F.col("low"))
        to_low = half(i, F.call_function("shiftright", v, F.col("low"))).bitwiseAND(F.col("lows"))
        return v.bitwiseXOR(F.when(i % 2 == 0, to_high).otherwise(to_low))

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    inside = F.col("block") < F.col("n_blocks")
    out = own.withColumn("block", F.aggregate(rounds, F.col("at"), step))
    for most in (8, WALKS):  # few rows need the long walk, so each projection takes on only what the one before has left outside
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col("block"), lambda v, i: F.when(v < F.col("n_blocks"), v).otherwise(F.aggregate(rounds, v, step)))
        out = out.withColumn("block", F.when(inside, F.col("block")).otherwise(walk))
    found = F.when(inside, F.col("block")).otherwise(F.raise_error(F.lit("the permutation found no index inside")).cast("long"))
    # never null, which the plan has to know: a join on blocks would else test it, and so permute everything twice, before the shuffle
    return out.select("sid", F.coalesce(found, F.lit(-1).cast("long")).alias("block"))


def mix_sources(docs: DataFrame, weights: list[float], block: int = 64, slots: int = 256, cap: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    1. A source's documents are laid end to end in hash order and cut into blocks of `block` words; the last is short.
    2. The output is cut into shards of `slots` blocks, whose source counts are multinomial draws, see draw_slots. A
       source's quota is its target in blocks, rounded by largest remainders.
    3. A source's uses are numbered over all shards; use j reads the block that a permutation of the source's n blocks,
       keyed by source and pass j div n, has at j mod n, see read_blocks.
    4. Slots join blocks by index, and uses of a block count for the words that each document has in it.

    Targets stop at `cap` times a source's size, so no block is used more than cap times and no document exceeds cap
    times its size. Null or wordless texts have size 0 and take 0; null is a source of its own; rows that share a doc_id
    are separate documents, and equal rows of one doc_id are laid in any order, as they are alike. Reruns agree, as all
    draws are hashes of seed and position. Long texts span many blocks. Columns other than doc_id, text and source are
    neither read nor returned. An empty table gives no rows. Sources are few enough to go through one task.
    """
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("t"))
    sized = written(sized.withColumn("h", F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id").cast("long"), "t")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    targets = source_targets(sums, weights, float(cap))
    plan = targets.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # a source's share of slots is its target in blocks, as its blocks hold size / n_blocks words on average
    plan = plan.withColumn("real", F.coalesce(F.try_divide(F.col("target") * F.col("n_blocks"), "source_size"), F.lit(0.0))).withColumn("whole", F.floor(F.col("real") + 1e-9))
    plan = plan.withColumn("left", F.round(F.sum(F.col("real")).over(W.partitionBy()) - F.sum("whole").over(W.partitionBy())))
    plan = plan.withColumn("quota", F.least(F.col("whole") + F.when(F.row_number().over(W.orderBy((F.col("real") - F.col("whole")).desc(), "sid")) <= F.col("left"), 1).otherwise(0), cap * F.col("n_blocks")))
    plan = written(plan.withColumn("all_slots", F.sum("quota").over(W.partitionBy())), "plan")
    named = small(plan.select(F.col("source").alias("_s"), "sid", "source_size", "target", "docs"))
    layed = sized.join(named, F.col("source").eqNullSafe(F.col("_s"))).select("sid", "doc_id", "size", "source_size", "target", "h", "t", "docs")
    none = layed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    if not plan.where("quota > 0").take(1):
        return layed.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # groups of about 1024 documents of a source
    layout = _offsets(layed.where("size > 0"), "sid", F.struct("h", "doc_id", "size", "t"), F.floor(_u(F.col("h")) * F.expr("docs div 1024 + 1")), "size", "start").drop("h", "t", "docs")
    slot = draw_slots(plan.where("quota > 0").select("sid", "n_blocks", "quota", "all_slots"), slots, seed)
    # shuffled first, as the draws have few tasks
    slot = slot.select("sid", "n_blocks", "j").repartition(parts(plan.agg(F.max("all_slots")).first()[0], 1 << 16), "sid", "j")
    uses = written(read_blocks(slot, seed).groupBy("sid", "block").agg(F.count("*").alias("uses")), "uses")
    spans = layout.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    spans = spans.withColumn("part", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    taken = spans.join(uses, ["sid", "block"], "left").groupBy("sid", "doc_id", "size", "start", "source_size", "target").agg(F.sum(F.col("part") * F.coalesce("uses", F.lit(0))).alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken").unionAll(none)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), [5, 2, 1])
