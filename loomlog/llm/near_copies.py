"""Near copies: texts at or above a Jaccard similarity of word shingles, by SimHash first, then by prefix filtering, each with an exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import connected_components, small, written
from loomlog.llm.simhash import bits_of, keep_first, pigeonring_links, runs

#: Shingles that a task sees so often are candidates for the end of the order; so many of them are ordered by count.
OFTEN, ORDERED = 4, 200_000
_FLUSH = 1 << 22
#: How often members of buckets are compared with leaders before all pairs that are left.
ROUNDS = 3
#: Longs of parity that go with the members of buckets; a power of two.
SKETCH = 8
#: Texts that a worker holds the shingles of at a time.
_TEXTS = 1000


def shingle_set(data: bytes, k: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of k words of a UTF-8 text: A-Z lower-cased, words between ASCII blanks.

    A text of fewer words is one run; texts without words have the same set, of the empty run.
    """
    return as_set(runs(data, k, seed), seed)


def as_set(h: np.ndarray, seed: int = 42) -> np.ndarray:
    """The set of a text's runs; without words it holds the empty run."""
    return np.unique(h) if len(h) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def prefix(shingles: np.ndarray, threshold: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(threshold * n) + 1 of n shingles, by hash, common ones last and by rank.

    Two sets of that similarity miss at most n - ceil(threshold * n) of each other's shingles, so under any one order
    their prefixes share a shingle.
    """
    n = len(shingles)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.argsort(np.where(common[at] == shingles, rank[at], -1), kind="stable")]
    return shingles[: n - math.ceil(threshold * n - 1e-9) + 1]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles dealt to each of about four bits a shingle: two sets differ in at least as many members as bits.

    The number of longs is a power of two, so that bits of texts of different length compare after folding in half.
    """
    bits = 64 << max(0, (len(shingles) // 16).bit_length() - 1)
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few texts, so that a worker's memory does not follow the size of Spark's batches."""
    for batch in batches:
        for i in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(i, _TEXTS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key stands for the text, so that exact copies are compared once."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the most common shingles, sorted by hash. They decide the order of shingles, no result."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["h", "n"])

        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(shingle_set(x.as_py(), k))
                size += len(held[-1])
                if size > _FLUSH:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    top = texts.select("text").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = top.orderBy(F.col("n").desc(), "h").limit(ORDERED).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def simhash_pairs(fps: DataFrame) -> DataFrame:
    """(src, dst), src < dst: pairs of keys of fps(key, fp) that SimHash links within radius 2, directly or over others.

    Keys of one fingerprint are paired with the least of them, which stands for it in the pairs with others.
    """
    least = written(fps.groupBy("fp").agg(F.min("key").alias("src")), "distinct")
    same = fps.join(least, "fp").select("src", F.col("key").alias("dst"))
    near = pigeonring_links(least.select("fp"))
    for end in ("src", "dst"):
        near = near.withColumnRenamed(end, "_fp").join(least.select(F.col("fp").alias("_fp"), F.col("src").alias(end)), "_fp").drop("_fp")
    pairs = same.unionByName(near).where("src <> dst")
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def jaccard_links(texts: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(src, dst): edges that join any two keys of texts(key, text) of that similarity, directly or over others.

    Edges are the links found by the last comparison and, for those before, each key's edge to the least of its component.
    First come the pairs that SimHash finds: the 64 bits of each text, over the same shingles with repeats, are linked
    within radius 2 (see simhash.pigeonring_links), and of these pairs those of that similarity are links. Two bits reach
    the closest copies only, so the rest follows, between what is not joined yet.

    Keys whose prefixes share a shingle are candidates, if enough of both is left behind it. Each is first compared
    with those two leaders of such buckets that it meets most often, which joins the members of a large group in rows
    that grow with its size and not with its square, and again with other leaders where a bucket still holds several
    components; then all pairs of a bucket whose members are not joined yet are compared. Texts that share a key must
    be equal. Parity bits bound the similarity from above, so the sets themselves are read for few pairs.
    """
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(_common(texts, k))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes = [runs(x.as_py(), k) for x in batch.column(1)]
            fps = pa.array(np.fromiter(map(bits_of, hashes), np.uint64, len(hashes)).view(np.int64))
            sets = [as_set(h) for h in hashes]
            heads = pa.array([prefix(s, threshold, *order.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            bits = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), bits, heads, fps], ["key", "n", "bits", "head", "fp"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = pa.array([shingle_set(x.as_py(), k).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["key", "s"])

    heads = texts.select("key", "text").mapInArrow(prefixes, "key long, n int, bits array<long>, head array<long>, fp long")
    heads = written(heads.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("head").alias("head"), F.first("fp").alias("fp")), "heads")
    # posexplode_outer: for posexplode Spark would test for empty arrays first
    posts = heads.select("key", "n", F.posexplode_outer("head").alias("at", "h"))
    shared = posts.groupBy("h").count().where("count > 1").select("h")
    members = written(posts.join(shared, "h"), "members")
    bits = written(heads.join(small(members.select("key").distinct()), "key", "left_semi").select("key", "n", "bits"), "bits")

    def possible(a: str, b: str) -> F.Column:
        """Whether two members of a bucket may be similar if this shingle is the first they share: what is left of both is enough."""
        n = F.col(f"{a}n") + F.col(f"{b}n")
        return F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at")) >= F.lit(threshold / (1 + threshold)) * n - 1e-9

    def folded(x: str, y: str) -> F.Column:
        """Bits x, folded once if they are longer than y."""
        half = F.size(x) / 2
        turned = F.transform(F.slice(x, F.lit(1), half.cast("int")), lambda v, i: v.bitwiseXOR(F.get(x, i + half.cast("int"))))
        return F.when(F.size(x) > F.size(y), turned).otherwise(F.col(x))

    def near(x: str, y: str, n: F.Column) -> F.Column:
        """Whether bits x and y differ in no more places than sets of n members together may in members."""
        # lengths differ by a fifth at most, so the number of longs by one power of two
        apart = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda t, v: t + v)
        return apart <= F.lit((1 - threshold) / (1 + threshold)) * n + 1e-9

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.select(F.col("key").alias("src"), F.col("n").alias("an"), F.col("bits").alias("a")), "src")
        both = both.join(bits.select(F.col("key").alias("dst"), F.col("n").alias("bn"), F.col("bits").alias("b")), "dst")
        both = both.where(F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn") - 1e-9)
        pairs = both.where(near("a", "b", F.col("an") + F.col("bn"))).select("src", "dst")
        pairs = written(pairs, "pairs")
        need = pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
        some = texts.select("key", "text").join(small(need), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        sets = written(some.mapInArrow(whole, "key long, s array<long>"), "sets")
        both = pairs.join(sets.select(F.col("key").alias("src"), F.col("s").alias("a")), "src")
        both = both.join(sets.select(F.col("key").alias("dst"), F.col("s").alias("b")), "dst")
        both = both.select("src", "dst", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("n"))
        return both.where(F.col("i") >= F.lit(threshold) * (F.col("n") - F.col("i")) - 1e-9).select("src", "dst")

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]

    def tagged(left: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows of left in the buckets that hold several components, with their own and the bucket's largest component."""
        own = left.select("h", "key", "n", "at").join(small(comp), F.col("key") == F.col("node"), "left").select("h", "key", "n", "at", F.coalesce("component", "key").alias("c"))
        mixed = own.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.count("*").alias("cs"), F.max_by("c", F.struct("m", "c")).alias("most")).where("cs > 1")
        return written(own.join(mixed.select("h", "most"), "h"), "tagged")

    tried = written(simhash_pairs(heads.select("key", "fp")), "tried")
    comp = written(connected_components(alike(tried)), "joined")
    left = tagged(members, comp)
    for r in range(ROUNDS):
        place, whole_key = F.xxhash64("key", F.lit(r)), F.struct("key", "n", "at", "c")
        led = left.groupBy("h").agg(F.min_by(whole_key, place).alias("x"), F.max_by(whole_key, place).alias("y"))
        met = left.join(led, "h").select("key", "n", "at", "c", F.explode(F.array("x", "y")).alias("to")).where("c <> to.c").where(possible("", "to."))
        met = met.groupBy("key", F.col("to.key").alias("to")).count()
        best = met.groupBy("key").agg(F.max(F.struct("count", "to")).alias("p"), F.max_by(F.struct("count", "to"), F.struct(F.col("count"), -F.col("to"))).alias("q"))
        new = best.select("key", F.explode(F.array("p.to", "q.to")).alias("to")).select(*pair("key", "to")).distinct()
        new = written(new.join(tried, ["src", "dst"], "left_anti"), "tried")
        tried = tried.unionAll(new)
        links = written(alike(new), "links")
        if links.isEmpty():
            continue
        # components only grow together, so a bucket that is not mixed any more never is again
        comp = written(connected_components(comp.toDF("src", "dst").unionAll(links)), "joined")
        left = tagged(left, comp)
    # a few longs of parity go with the members of buckets, so that most pairs end inside the join that makes them
    few = F.transform(F.array(*[F.lit(i) for i in range(SKETCH)]), lambda i: F.aggregate(F.filter("bits", lambda x, j: j % SKETCH == i), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)))
    sketch = bits.select(F.col("key").alias("_key"), F.when(F.size("bits") > SKETCH, few).otherwise(F.col("bits")).alias("sk"))
    left = written(left.join(small(sketch), F.col("key") == F.col("_key")).drop("_key"), "sketched")
    a, b = left.where("c <> most").alias("a"), left.alias("b")
    rest = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.c") != F.col("b.c")) & ((F.col("b.c") == F.col("b.most")) | (F.col("a.key") < F.col("b.key"))) & possible("a.", "b.") & near("a.sk", "b.sk", F.col("a.n") + F.col("b.n")))
    rest = rest.select(*pair("a.key", "b.key")).distinct().join(tried, ["src", "dst"], "left_anti")
    return comp.toDF("src", "dst").unionAll(written(alike(rest), "links"))


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, component_id): near-duplicate groups, named by their smallest doc_id; a row for each row of docs.

    A group is what pairs of that similarity connect. Null and empty texts are copies of each other. A group of rows
    without a doc_id has a null component_id.
    """
    keyed = _keyed(docs)
    rows = keyed.select("doc_id", "key")
    comp = connected_components(jaccard_links(keyed, threshold, k)).withColumnRenamed("node", "key")
    tagged = rows.join(comp, "key", "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    named = tagged.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return tagged.join(named, "component").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """docs with one document of each group, as simhash.keep_first keeps them."""
    return keep_first(docs, jaccard_groups(docs, threshold, k))
