"""Contents by their SHA-256: stored once, held by references and pins, swept when nothing holds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.versions import Version, Versions

#: How long an upload protects its content before something refers to it, in microseconds.
PIN = 3600 * 1_000_000


class BlobStore:
    """Put, get and prefix of contents; A8: reference counts, pins with an expiry, and the sweep.

    What is known of a content is the sum of its `facts`: how often it is referred to, until when it is pinned (the
    latest time), whether it is live, and in how many rows its bytes lie. Every call adds a small folder of facts and
    folds folders now and then, so a sweep reads facts, neither the holders nor the bytes. Swept contents are dead at
    once; their bytes go with the next compaction. A content that is put again before that is live again without a write.

    Each call is one version, published whole. A call that another writer has overtaken is planned again from what that
    one has left, so a sweep never takes a content that a put has just pinned. Times are microseconds of the caller's clock.
    """

    SCHEMAS = {
        "blobs": "sha256 string, bytes long, media_type string, data binary",
        "facts": "sha256 string, bytes long, refs long, until long, live long, rows long",
        "answers": "sha256 string, bytes long, accepted boolean, fresh boolean",
    }

    def __init__(self, spark: SparkSession, path: str, fold: int = 8):
        self.spark, self.fold, self.table = spark, fold, Versions(spark, path, self.SCHEMAS)

    @staticmethod
    def _summed(facts: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("refs", "live", "rows")]
        return facts.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.max("until").alias("until"), *sums).select("sha256", "bytes", "refs", "until", "live", "rows")

    def state(self, version: Version | None = None) -> DataFrame:
        """(sha256, bytes, refs, until, live, rows) of every content ever heard of and not forgotten."""
        return self._summed(self.table.read("facts", version or self.table.current()))

    def _staged(self, table: str, folder: str) -> DataFrame:
        return self.table.read(table, Version(0, {table: [(0, folder)]}))

    def _publish(self, version: Version, facts: DataFrame, blobs: str | None = None) -> bool:
        added = self.table.write("facts", facts.select("sha256", *[F.col(c).cast("long").alias(c) for c in ("bytes", "refs", "until", "live", "rows")]))
        parts = {"facts": self.table.folded("facts", [*version.parts.get("facts", []), (0, added)], self.fold, self._summed)}
        if blobs:
            parts["blobs"] = self.table.folded("blobs", [*version.parts.get("blobs", []), (0, blobs)], self.fold)
        return self.table.publish(version, parts) is not None

    def _again(self, step, attempts: int = 50):
        for _ in range(attempts):
            done = step(self.table.current())
            if done is not None:
                return done
        raise RuntimeError(f"other writers published first {attempts} times")

    def put(self, contents: DataFrame, now: int, pin: int = PIN) -> DataFrame:
        """Store contents(data, and claimed and media_type if it has them); a row (sha256, bytes, accepted, fresh) for each claim.

        A content whose hash is not the claimed one is refused, and nothing of it is stored. Others are live and pinned
        until now + pin, or longer if they were; fresh tells that the content was not live before. Equal contents are
        stored once, with the least of their media types. Rows without data are left out. A long content is one row, as
        its hash needs all of it (2 GB at most).
        """
        has = lambda c: F.col(c) if c in contents.columns else F.lit(None).cast("string")
        sent = contents.where("data IS NOT NULL").select(F.col("data").cast("binary").alias("data"), has("media_type").alias("media_type"), has("claimed").alias("claimed"))
        sent = sent.withColumn("sha256", F.sha2("data", 256)).withColumn("bytes", F.octet_length("data").cast("long"))
        good = F.col("claimed").isNull() | (F.lower("claimed") == F.col("sha256"))

        def step(version: Version) -> DataFrame | None:
            known = self.state(version).select("sha256", "live", "rows")
            claims = sent.groupBy(F.coalesce(F.when(~good, F.lower("claimed")), "sha256").alias("sha256"), good.alias("accepted")).agg(F.max("bytes").alias("bytes"))
            told = claims.join(known, "sha256", "left").withColumn("fresh", F.col("accepted") & (F.coalesce("live", F.lit(0)) == 0))
            answers = self.table.write("answers", told.select("sha256", "bytes", "accepted", "fresh"))
            mine = sent.where(good).join(known.where("rows > 0"), "sha256", "left_anti")
            new = mine.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.min("media_type").alias("media_type"), F.any_value("data").alias("data"))
            blobs = self.table.write("blobs", new)
            written = self._staged("blobs", blobs).select("sha256", F.lit(1).alias("rows"))
            facts = self._staged("answers", answers).where("accepted").join(written, "sha256", "left")
            facts = facts.select("sha256", "bytes", F.lit(0).alias("refs"), F.lit(now + pin).alias("until"), F.col("fresh").cast("long").alias("live"), F.coalesce("rows", F.lit(0)).alias("rows"))
            return self._staged("answers", answers) if self._publish(version, facts, blobs) else None

        return self._again(step)

    def refer(self, changes: DataFrame) -> None:
        """Count references: changes(sha256, refs), more or less than before; rows of one content are added up."""
        facts = changes.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.sum("refs").alias("refs"))
        facts = facts.select("sha256", F.lit(None).alias("bytes"), "refs", F.lit(0).alias("until"), F.lit(0).alias("live"), F.lit(0).alias("rows"))
        self._again(lambda version: self._publish(version, facts) or None)

    @staticmethod
    def held(now: int) -> Column:
        return (F.col("refs") > 0) | (F.col("until") > now)

    def sweep(self, now: int) -> DataFrame:
        """Let live contents go that nothing refers to and no pin protects any more; (sha256, bytes) of these."""

        def step(version: Version) -> DataFrame | None:
            dead = self.state(version).where(F.col("live") > 0).where(~self.held(now))
            told = self.table.write("answers", dead.select("sha256", "bytes", F.lit(True).alias("accepted"), F.lit(False).alias("fresh")))
            gone = self._staged("answers", told)
            facts = gone.select("sha256", F.lit(None).alias("bytes"), F.lit(0).alias("refs"), F.lit(0).alias("until"), F.lit(-1).alias("live"), F.lit(0).alias("rows"))
            return gone.select("sha256", "bytes") if self._publish(version, facts) else None

        return self._again(step)

    def compact(self) -> None:
        """Rewrite the bytes without dead contents, folder by folder where any is dead, and forget what is neither live nor referred to."""

        def step(version: Version) -> bool | None:
            state = self.table.write("facts", self.state(version))
            known = self._staged("facts", state)
            dead = known.where("live = 0 AND rows > 0").select("sha256")
            blobs = []
            for level, folder in version.parts.get("blobs", []):
                rows = self._staged("blobs", folder)
                touched = not rows.select("sha256").join(dead, "sha256", "left_semi").isEmpty()
                blobs.append((level, self.table.write("blobs", rows.join(dead, "sha256", "left_anti")) if touched else folder))
            left = known.where("live > 0 OR refs <> 0").withColumn("rows", F.when(F.col("live") > 0, F.col("rows")).otherwise(0))
            parts = {"blobs": blobs, "facts": [(0, self.table.write("facts", left))]}
            return self.table.publish(version, parts) is not None or None

        self._again(step)

    def get(self, wanted: DataFrame | None = None, first: int | None = None) -> DataFrame:
        """(sha256, bytes, media_type, data, intact) of live contents, of wanted(sha256) if given; only their first bytes if told so.

        intact tells that the stored bytes still have their hash; a prefix is not checked, it is null.
        """
        version = self.table.current()
        live = self.state(version).where("live > 0").select("sha256")
        asked = [live] if wanted is None else [live, wanted.select("sha256")]
        rows = reduce(lambda df, keys: df.join(keys, "sha256", "left_semi"), asked, self.table.read("blobs", version))
        if first is not None:
            return rows.withColumn("data", F.substring("data", 1, first)).withColumn("intact", F.lit(None).cast("boolean"))
        return rows.withColumn("intact", F.sha2("data", 256) == F.col("sha256"))
