"""The append sink: a log of chunks per session that only grows at its end, with a digest of what it holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.sources.versions import Version, Versions

#: Bytes that the digest moves on by, and of a region of the log that is read at once.
BLOCK, REGION = 4096, 16 << 20
_KEY = ["session_id", "byte_offset", "seq", "h"]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session, offset and seq -> with `accepted` and `length`, what the session's log holds after the row."""
    session, length = None, 0
    for batch in batches:
        accepted, lengths = [], []
        for sid, offset, size, whole, start in zip(*(batch.column(c).to_pylist() for c in ("session_id", "byte_offset", "bytes", "whole", "start")), strict=True):
            if sid != session:
                session, length = sid, start
            accepted.append(bool(whole) and offset == length)
            length += size if accepted[-1] else 0
            lengths.append(length)
        kept = [batch.column(c) for c in _KEY]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(accepted, pa.bool_()), pa.array(lengths, pa.int64())], [*_KEY, "accepted", "length"])


class AppendLog:
    """A3: chunks of raw bytes by session; L7: a chunk that comes again is refused, so replays change nothing.

    A chunk (session_id, seq, byte_offset, data) is taken if it is not empty, ends its last line and starts where the
    log of its session ends; else it is refused with the true length, for the sender to go on from. Chunks of one call
    are taken in the order of byte_offset and seq. Whatever a call takes becomes visible at once, with the heads of its
    sessions; of two callers at a time one publishes, and the other decides again from what the first has left.

    A head holds the length of a log, the digest of its whole blocks and the bytes after them. The digest goes on from
    there, so a call reads its own chunks and the heads, not the logs: d(k) = SHA-256(d(k-1) || SHA-256(block k)), as
    lower hex digits, with blocks of `block` bytes and a last one that may be short. It does not depend on how the
    bytes were cut into chunks.

    Deciding is a scan in order over a session's offsets and sizes, without its data: one task for each session, in
    memory for a batch of rows. Data is joined and hashed by block, so that a long session spreads over tasks.
    """

    SCHEMAS = {
        "chunks": "session_id long, seq long, byte_offset long, bytes long, data binary",
        "heads": "session_id long, version long, length long, state string, tail binary",
        "decisions": "session_id long, byte_offset long, seq long, h long, accepted boolean, length long",
    }

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.block, self.table = spark, block, Versions(spark, path, self.SCHEMAS)

    @staticmethod
    def _latest(heads: DataFrame) -> DataFrame:
        return heads.groupBy("session_id").agg(F.max_by(F.struct("version", "length", "state", "tail"), "version").alias("x")).select("session_id", "x.*")

    def _heads(self, version: Version) -> DataFrame:
        return self._latest(self.table.read("heads", version))

    def heads(self) -> DataFrame:
        """(session_id, length, digest) of every log."""
        tail = F.sha2(F.concat("state", F.sha2("tail", 256)).cast("binary"), 256)
        return self._heads(self.table.current()).select("session_id", "length", F.when(F.octet_length("tail") > 0, tail).otherwise(F.col("state")).alias("digest"))

    def chunks(self) -> DataFrame:
        return self.table.read("chunks", self.table.current())

    def lengths(self) -> DataFrame:
        """(session_id, length, version) of every log; version is that of its last append."""
        return self._heads(self.table.current()).select("session_id", "length", "version")

    def lines(self, sessions: DataFrame | None = None) -> DataFrame:
        """(session_id, byte_offset, line) of whole lines that are not blank, with their place in the log; of some sessions, if given.

        Chunks end with a line, so each is cut by itself: a long log spreads over tasks.
        """
        c = self.chunks()
        c = c.join(sessions.select("session_id"), "session_id", "left_semi") if sessions is not None else c
        each = c.select("session_id", F.col("byte_offset").alias("at"), F.posexplode(F.split(F.col("data").cast("string"), "\n", -1)).alias("pos", "line"))
        before = F.coalesce(F.sum(F.octet_length("line") + 1).over(W.partitionBy("session_id", "at").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return each.select("session_id", (F.col("at") + before).cast("long").alias("byte_offset"), F.trim("line").alias("line")).where("line <> ''")

    def regions(self, size: int = REGION) -> DataFrame:
        """A4: (session_id, region, byte_offset, bytes, chunks): runs of chunks that start in the same `size` bytes of a log."""
        c = self.chunks().withColumn("region", F.expr(f"byte_offset div {size}"))
        return c.groupBy("session_id", "region").agg(F.min("byte_offset").alias("byte_offset"), F.sum("bytes").alias("bytes"), F.count("*").alias("chunks"))

    def decide(self, sent: DataFrame, version: Version) -> str:
        """Stage the decisions on sent chunks against a version's heads; their folder."""
        start = self._heads(version).select("session_id", F.col("length").alias("start"))
        meta = sent.select(*_KEY, F.octet_length("data").cast("long").alias("bytes"), "whole")
        meta = meta.join(start, "session_id", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
        ordered = meta.repartition("session_id").sortWithinPartitions(*_KEY)
        return self.table.write("decisions", ordered.mapInArrow(_follow, self.SCHEMAS["decisions"]))

    def _advanced(self, taken: DataFrame, version: Version) -> DataFrame:
        """New heads of the sessions of taken chunks."""
        block, sessions = self.block, taken.select("session_id").distinct()
        old = self._heads(version).join(sessions, "session_id", "left_semi")
        state = old.select("session_id", "state", (F.col("length") - F.octet_length("tail")).alias("from"))
        fresh = taken.select("session_id", "byte_offset", "data")
        held = old.where(F.octet_length("tail") > 0).select("session_id", (F.col("length") - F.octet_length("tail")).alias("byte_offset"), F.col("tail").alias("data"))
        # bytes by block, in the order of offsets
        cut = fresh.unionAll(held).select("session_id", "byte_offset", "data", F.explode(F.expr(f"sequence(byte_offset div {block}, (byte_offset + octet_length(data) - 1) div {block})")).alias("block"))
        begin = F.greatest(F.col("byte_offset"), F.col("block") * block)
        piece = F.substring("data", (begin - F.col("byte_offset") + 1).cast("int"), F.least(F.lit(block), (F.col("block") + 1) * block - begin).cast("int"))
        whole = cut.select("session_id", "block", begin.alias("at"), piece.alias("piece")).groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
        whole = whole.select("session_id", "block", F.aggregate("ps", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["piece"])).alias("bytes"))
        full = F.octet_length("bytes") == block
        by = whole.groupBy("session_id").agg(
            F.array_sort(F.collect_list(F.when(full, F.struct("block", F.sha2("bytes", 256).alias("leaf"))))).alias("leaves"),
            F.max(F.when(~full, F.col("bytes"))).alias("tail"), F.max(F.col("block") * block + F.octet_length("bytes")).alias("length"),
        )
        chain = F.aggregate("leaves", F.coalesce("state", F.lit("")), lambda d, x: F.sha2(F.concat(d, x["leaf"]).cast("binary"), 256))
        return by.join(state, "session_id", "left").select("session_id", F.lit(version.number + 1).cast("long").alias("version"), "length", chain.alias("state"), F.coalesce("tail", F.lit(b"").cast("binary")).alias("tail"))

    def _try(self, sent: DataFrame, version: Version) -> str | None:
        decided = self.decide(sent, version)
        yes = self.table.read("decisions", Version(0, {"decisions": [(0, decided)]})).where("accepted").select(*_KEY)
        taken = sent.join(yes, _KEY, "left_semi").dropDuplicates(_KEY).select("session_id", "seq", "byte_offset", F.octet_length("data").cast("long").alias("bytes"), "data")
        stored = self.table.write("chunks", taken)
        rows = self.table.read("chunks", Version(0, {"chunks": [(0, stored)]}))
        if rows.isEmpty():
            return decided
        heads = self.table.write("heads", self._advanced(rows, version))
        parts = {t: [*version.parts.get(t, []), (0, f)] for t, f in (("chunks", stored), ("heads", heads))}
        parts["heads"] = self.table.folded("heads", parts["heads"], reduced=self._latest)
        parts["chunks"] = self.table.folded("chunks", parts["chunks"])
        return decided if self.table.publish(version, parts) else None

    def append(self, chunks: DataFrame, attempts: int = 50) -> DataFrame:
        """Take what fits of chunks(session_id, seq, byte_offset, data); a row for each chunk, with `accepted` and the true `length` after it.

        seq tells chunks of one offset apart. Rows without a session, an offset or data are refused. Chunks are read
        again for another attempt, so they should come from a table or a stream's batch.
        """
        sent = chunks.select(F.col("session_id").cast("long"), F.col("byte_offset").cast("long"), F.col("seq").cast("long"), F.col("data").cast("binary").alias("data"))
        sent = sent.withColumn("h", F.xxhash64("data")).withColumn("whole", F.col("session_id").isNotNull() & F.coalesce(F.endswith("data", F.lit(b"\n").cast("binary")), F.lit(False)))
        for _ in range(attempts):
            decided = self._try(sent, self.table.current())
            if decided:
                return self.table.read("decisions", Version(0, {"decisions": [(0, decided)]})).drop("h")
        raise RuntimeError(f"other writers published first {attempts} times")

    def stream(self, chunks: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """Append a stream of chunks, batch by batch; a batch that is replayed after a failure is refused, as its bytes are there."""
        return chunks.writeStream.foreachBatch(lambda df, _: self.append(df) and None).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()

