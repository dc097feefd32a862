"""Raw logs and content-addressed blobs: lines with byte offsets, gap checks, exports, and what refers to what."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.sources.appendlog import AppendLog
from loomlog.sources.blobstore import PIN, BlobStore
from loomlog.sources.shared import shared_dir
from loomlog.sources.views import Inputs, read

_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"  # not $, which in Java also matches before a final line end
#: Hosts whose paths do not tell upper from lower case, and the default port of each URL scheme. Fixed values.
CASELESS_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
DEFAULT_PORTS = {"ssh": "22", "git": "9418", "http": "80", "https": "443"}


def lines_with_offsets(logs: DataFrame, key: str, text: str) -> DataFrame:
    """A2: (key, byte_offset, line): trimmed lines that are not blank, each with its first byte in the raw text.

    Blank lines are not returned but advance the offset. Null texts have no lines.
    """
    each = logs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0)).cast("long"))
    return each.select(key, "byte_offset", F.regexp_replace("raw", _ENDS, "").alias("line")).where("line <> ''")


def chunks(messages: DataFrame) -> DataFrame:
    """Messages as the byte chunks of an append-only log: (session_id, ordinal, data, byte_offset, bytes)."""
    sized = messages.select("session_id", "ordinal", F.concat("content", F.lit("\n")).alias("data")).withColumn("bytes", F.octet_length("data").cast("long"))
    before = W.partitionBy("session_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("byte_offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long"))


def gaps(log: DataFrame) -> DataFrame:
    """A4: chunks, bytes and broken places of each log; a place is broken if a chunk does not start where the last ended."""
    w = W.partitionBy("session_id").orderBy("byte_offset")
    log = log.withColumn("due", F.coalesce(F.lag(F.col("byte_offset") + F.col("bytes")).over(w), F.lit(0)))
    return log.groupBy("session_id").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.count_if(F.col("due") != F.col("byte_offset")).alias("gaps"))


def export(log: DataFrame, limit: int) -> DataFrame:
    """A5: each log's chunks in order while they end within the limit, as a digest, with the total and whether it was cut."""
    inside = F.col("byte_offset") + F.col("bytes") <= limit
    got = log.groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(inside, F.struct("byte_offset", "data")))).alias("c"), F.sum("bytes").alias("total"))
    text = F.array_join(F.transform("c", lambda x: x["data"]), "")
    return got.select("session_id", F.sha2(text, 256).alias("sha256"), "total", (F.col("total") > limit).alias("truncated"))


def blobs(texts: DataFrame, text: str) -> DataFrame:
    """One row for each distinct content: its SHA-256, its bytes and how many hold it. Nulls are no content."""
    keyed = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))
    return keyed.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.count("*").alias("holders"))


def missing(asked: DataFrame, present: DataFrame) -> DataFrame:
    """Hashes that are asked for and not there."""
    return asked.select("sha256").distinct().join(present.select("sha256"), "sha256", "left_anti")


def unreferenced(stored: DataFrame, *holders: DataFrame) -> DataFrame:
    """Stored blobs that nothing refers to."""
    for refs in holders:
        stored = stored.join(refs.select("sha256"), "sha256", "left_anti")
    return stored


def referenced(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """The references whose blob is stored."""
    return refs.join(stored.select("sha256"), "sha256", "left_semi")


_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^@/]*@)?([^/:]+)(?::([0-9]+))?/+(.+?)/*$"
_SCP = r"^(?:[^@/:]+@)?([^/:]+):([^/].*?)/*$"


def remote_host(remote: Column) -> Column:
    """The host of a git remote as it is written; empty if the remote is in neither URL nor scp form."""
    return F.when(F.trim(remote).rlike(_URL), F.regexp_extract(F.trim(remote), _URL, 2)).otherwise(F.regexp_extract(F.trim(remote), _SCP, 1))


def canonical_remote(remote: Column, real: Column | None = None) -> Column:
    """host[:port]/path of a git remote in URL or scp form, without user, default port or .git; null if neither.

    real: the host that the written one is an alias of, null or empty if it is none. Hosts with a dot are never aliases.
    """
    part = lambda p, i: F.regexp_extract(F.trim(remote), p, i)
    is_url = F.trim(remote).rlike(_URL)
    scheme, port = F.lower(part(_URL, 1)), part(_URL, 3)
    default = F.coalesce(*[F.when(scheme == s, F.lit(p)) for s, p in DEFAULT_PORTS.items()], F.lit(""))
    host = remote_host(remote)
    if real is not None:
        host = F.when(~host.contains(".") & (F.coalesce(real, F.lit("")) != ""), real).otherwise(host)
    host = F.lower(host)
    path = F.regexp_replace(F.when(is_url, part(_URL, 4)).otherwise(part(_SCP, 2)), r"\.git$", "")
    path = F.when(host.isin(*CASELESS_HOSTS), F.lower(path)).otherwise(path)
    shown = F.when(is_url & (port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(F.lit(""))
    return F.when(is_url | F.trim(remote).rlike(_SCP), F.concat(host, shown, F.lit("/"), path))


def resolved_remotes(df: DataFrame, aliases: DataFrame, remote: str = "remote") -> DataFrame:
    """Df with `remote` in its canonical form, after hosts that are in aliases(alias, host) have been replaced.

    Aliases tell upper from lower case. Of an alias that is listed twice the least host counts; rows keep their number.
    """
    real = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("host").alias("_real"))
    out = df.withColumn("_host", remote_host(F.col(remote))).join(real, F.col("_host") == F.col("_alias"), "left")
    return out.withColumn(remote, canonical_remote(F.col(remote), F.col("_real"))).drop("_host", "_alias", "_real")


_CHUNK_SQL = """, ck AS (SELECT session_id, ordinal, content || chr(10) AS data, strlen(content || chr(10)) AS bytes FROM messages),
 lg AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM ck)"""
# the digest of whole logs, by blocks of 512 bytes
_DIGEST_SQL = """, hx AS (SELECT session_id, hex(encode(string_agg(data, '' ORDER BY ordinal))) AS x FROM lg GROUP BY 1),
 dg AS (SELECT session_id, list_reduce([''] || list_transform(range(0, len(x), 1024), lambda i: sha256(unhex(substr(x, i + 1, 1024)))), lambda a, b: sha256(a || b)) AS digest FROM hx)"""
_SHA = "SELECT sha256({0}) AS sha256, strlen({0})::BIGINT AS bytes FROM {1} WHERE {0} IS NOT NULL"
LIMIT = 600


def _docs(x: Inputs) -> DataFrame:
    return read(x.spark, x.sf_dir, "documents")


def _of(x: Inputs, table: str, text: str) -> DataFrame:
    return blobs(read(x.spark, x.sf_dir, table), text)


def broken(x: Inputs) -> DataFrame:
    """Chunks of which some are missing and some come twice."""
    kept = chunks(x.messages).where("(session_id + ordinal) % 7 <> 3")
    return kept.unionAll(kept.where("(session_id + ordinal) % 5 = 1"))


def local_project(machine: Column, cwd: Column, root: Column) -> Column:
    """(key, display_name) of a project without a remote: by machine and its root, or else the working directory."""
    place = F.coalesce(F.nullif(root, F.lit("")), cwd, F.lit(""))
    name = F.regexp_extract(F.regexp_replace(place, r"[/\\]+\z", ""), r"([^/\\]*)\z", 1)
    return F.struct(F.concat(F.lit("local:"), F.coalesce(machine, F.lit("")), F.lit(":"), place).alias("key"), F.when(name == "", "(unknown location)").otherwise(name).alias("display_name"))


def _pattern(glob: str) -> str:
    """A glob as a regular expression: `**` stands for any folders, `*` and `?` for letters within one name."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"(?:^|/){out}(?:$|/)"


def discover(spark: SparkSession, root: str, agent: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A1: (path, bytes, modified) of an agent's log files below root, in any folder; format B's are named rollout-*.

    Left out are empty files and those whose path below root, or a folder of it, matches a glob of `exclude`. Spark
    lists the files; their content is not read. Links to folders are not followed where the file system tells them apart.
    """
    glob = "rollout-*.jsonl" if agent == "format_b" else "*.jsonl"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape("/" + re.sub(r"^[a-z]+:/+", "/", root).strip("/") + "/"), "")
    for g in exclude:
        found = found.where(~below.rlike(_pattern(g)))
    return found.where("length > 0").select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def discover_all(spark: SparkSession, roots: dict[str, str], env: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """A1: (agent, path, bytes, modified) of all agents, and a notice for each root that is not there.

    roots: the folder of each agent; env, by agent, the folders that override them (from environment variables of the
    caller's choice). A missing root is no error, as few machines have all agents.
    """
    out, notices = spark.createDataFrame([], "agent string, path string, bytes long, modified timestamp"), []
    for agent, root in (roots | {a: r for a, r in (env or {}).items() if r}).items():
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out = out.unionByName(discover(spark, root, agent, exclude).withColumn("agent", F.lit(agent)))
        else:
            notices.append(f"{agent}: no folder {root}")
    return out, notices


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task in their order, with the bytes before each in its own byte range (path, start)."""
    now, base = None, 0
    for batch in batches:
        sizes = np.asarray(pc.add(pc.binary_length(batch.column("line").cast(pa.binary())), 1)).astype(np.int64)
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
        before, i = np.empty(len(sizes), np.int64), 0
        while i < len(keys):
            j = next((k for k in range(i + 1, len(keys)) if keys[k] != keys[i]), len(keys))
            if keys[i] != now:
                now, base = keys[i], 0
            run = np.cumsum(sizes[i:j])
            before[i:j], base, i = base + run - sizes[i:j], base + int(run[-1]), j
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(before), batch.column("line")], ["path", "start", "before", "line"])


def file_lines(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """A1/A2: (session_id, agent, byte_offset, line) of the files of discover; a file is a session, named by its path.

    Files are split into byte ranges that are read in parallel (spark.sql.files.maxPartitionBytes), so their size is not
    bounded by a task. A first pass adds up the bytes of each range's lines, a running sum over a file's ranges gives
    the place of its first line, and the second pass counts on from there in the order of lines. Offsets are those of
    the raw bytes: blank lines advance them, carriage returns are bytes, and so is a byte order mark, which the reader
    takes off the first line. Files must not change between the passes. A table of one row a range is joined.
    """
    glob = "rollout-*.jsonl" if agent == "format_b" else "*.jsonl"
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    at = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))
    ranges = at.groupBy("path", "start").agg(F.max("size").alias("size"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"))
    upto = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    # what lines hold is the file's size, or one more without a last line end; if three bytes lack, they are the mark
    mark = F.when(F.sum("bytes").over(W.partitionBy("path")) <= F.col("size") - 2, 3).otherwise(0)
    ranges = ranges.select("path", "start", (F.coalesce(F.sum("bytes").over(upto), F.lit(0)) + mark).alias("base"), mark.alias("mark"))
    placed = at.select("path", "start", "line").mapInArrow(_offsets, "path string, start long, before long, line string").join(ranges, ["path", "start"])
    first = (F.col("base") == F.col("mark")) & (F.col("before") == 0)
    offset = F.when(first, 0).otherwise(F.col("base") + F.col("before"))
    return placed.select(F.col("path").alias("session_id"), F.lit(agent).alias("agent"), offset.cast("long").alias("byte_offset"), F.regexp_replace("line", _ENDS, "").alias("line")).where("line <> ''")


def _read_ranges(x: Inputs) -> DataFrame:
    """A1: the messages, written as files of eight sessions' logs each, and read back by byte ranges."""
    root = f"{shared_dir(x.spark)}/logs-{uuid.uuid4().hex}"
    logs = x.messages.select((F.col("session_id") % 8).alias("bucket"), "session_id", "ordinal", F.col("content").alias("value"))
    # one file a bucket, in the order of sessions
    logs.repartition("bucket").sortWithinPartitions("bucket", "session_id", "ordinal").select("bucket", "value").write.partitionBy("bucket").text(root)
    # the glob of discovery wants its own ending
    fs, at = x.spark._jvm.org.apache.hadoop.fs, x.spark._jvm.org.apache.hadoop.fs.Path(root)
    on = at.getFileSystem(x.spark._jsc.hadoopConfiguration())
    for folder in on.listStatus(at):
        for i, f in enumerate(on.listStatus(folder.getPath()) if folder.isDirectory() else []):
            if f.getPath().getName().startswith("part-"):
                on.rename(f.getPath(), fs.Path(f"{folder.getPath().toString()}/{i}.jsonl"))
    lines = file_lines(x.spark, root, "format_a").withColumn("bucket", F.regexp_extract("session_id", "bucket=([0-9]+)", 1).cast("long"))
    return lines.groupBy("bucket").agg(F.count("*").alias("lines"), F.sum("byte_offset").alias("offsets"), F.max("byte_offset").alias("last"), F.sum(F.octet_length("line")).alias("bytes"))


def _sent(x: Inputs) -> DataFrame:
    """Chunks, some sent again later and some with a false offset or a cut line."""
    c = chunks(x.messages).select("session_id", F.col("ordinal").alias("seq"), "byte_offset", "data")
    again = c.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000)
    false = c.where("seq % 4 = 1").withColumns({"seq": F.col("seq") + 2000, "byte_offset": F.col("byte_offset") + 1})
    cut = c.where("seq % 5 = 2").withColumns({"seq": F.col("seq") - 1000, "data": F.lit("no end of line")})
    return c.unionAll(again).unionAll(false).unionAll(cut)


def _log(x: Inputs, block: int = 512) -> AppendLog:
    return AppendLog(x.spark, f"{shared_dir(x.spark)}/log-{uuid.uuid4().hex}", block)


def _appended(x: Inputs) -> DataFrame:
    """A3: what a log takes of chunks sent in one call, and the digest of what it then holds."""
    log = _log(x)
    out = log.append(_sent(x)).groupBy("session_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), F.max("length").alias("length"))
    return out.join(log.heads().select("session_id", "digest"), "session_id")


def _replayed(x: Inputs) -> DataFrame:
    """The first three chunks of each log, then all from the start again: what was there is refused, the rest goes on."""
    log, all_ = _log(x), chunks(x.messages).select("session_id", F.col("ordinal").alias("seq"), "byte_offset", "data")
    first = log.append(all_.where("seq < 3")).groupBy("session_id").agg(F.count_if("accepted").alias("first"))
    again = log.append(all_).groupBy("session_id").agg(F.count_if("accepted").alias("then"), F.count_if(~F.col("accepted")).alias("refused"))
    return first.join(again, "session_id").join(log.heads(), "session_id")


def _regions(x: Inputs) -> DataFrame:
    log = _log(x)
    log.append(chunks(x.messages).select("session_id", F.col("ordinal").alias("seq"), "byte_offset", "data"))
    return log.regions(1024)


_REMOTES = {0: "git@GitHub.com:Team/R{}.git", 1: "https://user:pw@example.org:443/Team/R{}/", 2: "ssh://git@Example.org:2222/a/b/R{}.git", 3: "/local/r{}"}
_KEYS = {0: "github.com/team/r{}", 1: "example.org/Team/R{}", 2: "example.org:2222/a/b/R{}", 3: None}


def _remotes(x: Inputs) -> DataFrame:
    n = F.col("session_id").cast("string")
    made = F.coalesce(*[F.when(F.col("session_id") % 4 == i, F.concat(F.lit(a), n, F.lit(b))) for i, (a, b) in ((i, t.split("{}")) for i, t in _REMOTES.items())])
    return x.sessions.select("session_id", canonical_remote(made).alias("remote"))


def _aliased(x: Inputs) -> DataFrame:
    """Remotes by the alias of their project's host; every fifth project has no alias, one is of a host that ignores case."""
    host = F.when(F.col("project_id") == 1, "GitHub.com").otherwise(F.concat(F.lit("Git.p"), "project_id", F.lit(".org")))
    aliases = x.projects.where("project_id % 5 <> 0").select(F.concat(F.lit("h"), "project_id").alias("alias"), host.alias("host"))
    made = x.sessions.select("session_id", F.concat(F.lit("git@h"), "project_id", F.lit(":Team/R"), F.col("session_id") % 9, F.lit(".git")).alias("remote"))
    return resolved_remotes(made, aliases)


def _contents(x: Inputs, where: str = "true") -> DataFrame:
    """Texts of documents with their hashes as claims, every eleventh of which is false."""
    claim = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return _docs(x).where(where).select(F.col("text").cast("binary").alias("data"), claim.alias("claimed"))


def _blob_store(x: Inputs) -> BlobStore:
    return BlobStore(x.spark, f"{shared_dir(x.spark)}/blobs-{uuid.uuid4().hex}")


def _stored_blobs(x: Inputs) -> DataFrame:
    """The texts of even documents, then all: what is stored of each, its first bytes, and in which call it came."""
    store = _blob_store(x)
    first, then = store.put(_contents(x, "doc_id % 2 = 0"), 0), store.put(_contents(x), 0)
    calls = first.where("fresh").select("sha256", F.lit(1).alias("call")).unionAll(then.where("fresh").select("sha256", F.lit(2)))
    return store.get().select("sha256", "bytes", "intact").join(store.get(first=24).select("sha256", F.hex("data").alias("head")), "sha256").join(calls, "sha256")


def _swept_blobs(x: Inputs) -> DataFrame:
    """Texts put at 0, some again half an hour later; references come and go; swept after an hour, and the bytes compacted."""
    store, half = _blob_store(x), PIN // 2
    of = lambda where, n: _docs(x).where(where).select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(n).alias("refs"))
    store.put(_docs(x).select("text").withColumnRenamed("text", "data"), 0)
    store.put(_docs(x).where("doc_id % 7 = 0").select(F.col("text").alias("data")), half)
    store.refer(of("doc_id % 2 = 0", 1))
    store.refer(of("doc_id % 4 = 0", -1))
    swept = store.sweep(PIN)
    store.compact()
    return swept.select("sha256", "bytes", F.lit(False).alias("kept")).unionAll(store.get().select("sha256", "bytes", F.lit(True)))


QUERIES = {
    "A1_byte_ranges": (_read_ranges, """, ln AS (SELECT session_id % 8 AS bucket, session_id, ordinal, unnest(range(len(string_split(content, chr(10))))) AS pos, unnest(string_split(content, chr(10))) AS raw FROM messages),
 o AS (SELECT bucket, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY bucket ORDER BY session_id, ordinal, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM ln)
 SELECT bucket, count(*) AS lines, sum(byte_offset)::BIGINT AS offsets, max(byte_offset)::BIGINT AS last, sum(strlen(line))::BIGINT AS bytes FROM o WHERE line <> '' GROUP BY 1"""),
    "A2_line_offsets": (lambda x: lines_with_offsets(_docs(x), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("byte_offset").alias("offsets"), F.max("byte_offset").alias("last"), F.sum(F.octet_length("line")).alias("bytes")),
        """, w AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
 o AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM w)
 SELECT doc_id, count(*) AS n, sum(byte_offset)::BIGINT AS offsets, max(byte_offset)::BIGINT AS last, sum(strlen(line))::BIGINT AS bytes FROM o WHERE line <> '' GROUP BY 1"""),
    # a chunk in seven is missing, and one in five comes twice
    "A4_gaps": (lambda x: gaps(broken(x)), _CHUNK_SQL + """, kept AS (SELECT *, ordinal AS o FROM lg WHERE (session_id + ordinal) % 7 <> 3), twice AS (SELECT *, 0 AS again FROM kept UNION ALL SELECT *, 1 FROM kept WHERE (session_id + ordinal) % 5 = 1)
      SELECT session_id, count(*) AS chunks, sum(bytes)::BIGINT AS bytes, count(*) FILTER (CASE WHEN again = 1 THEN true WHEN o = 0 THEN false ELSE (session_id + o - 1) % 7 = 3 END)::BIGINT AS gaps FROM twice GROUP BY 1"""),
    "A3_append": (_appended, _CHUNK_SQL + _DIGEST_SQL + """ SELECT session_id, count(*) AS accepted, (count(*) FILTER (ordinal % 3 = 0) + count(*) FILTER (ordinal % 4 = 1) + count(*) FILTER (ordinal % 5 = 2))::BIGINT AS refused, sum(bytes)::BIGINT AS length, any_value(digest) AS digest FROM lg JOIN dg USING (session_id) GROUP BY 1"""),
    "A4_regions": (_regions, _CHUNK_SQL + " SELECT session_id, byte_offset // 1024 AS region, min(byte_offset) AS byte_offset, sum(bytes)::BIGINT AS bytes, count(*) AS chunks FROM lg GROUP BY 1, 2"),
    "L7_replay": (_replayed, _CHUNK_SQL + _DIGEST_SQL + """ SELECT session_id, count(*) FILTER (ordinal < 3) AS first, count(*) FILTER (ordinal >= 3) AS then, count(*) FILTER (ordinal < 3) AS refused, sum(bytes)::BIGINT AS length, any_value(digest) AS digest FROM lg JOIN dg USING (session_id) GROUP BY 1"""),
    "A13_remotes": (_remotes, " SELECT session_id, CASE session_id % 4 " + " ".join(f"WHEN {i} THEN concat('{k.split('{}')[0]}', session_id, '{k.split('{}')[1]}')" for i, k in _KEYS.items() if k) + " END AS remote FROM sessions"),
    "A13_aliases": (_aliased, " SELECT session_id, CASE WHEN project_id = 1 THEN concat('github.com/team/r', session_id % 9) WHEN project_id % 5 = 0 THEN concat('h', project_id, '/Team/R', session_id % 9) ELSE concat('git.p', project_id, '.org/Team/R', session_id % 9) END AS remote FROM sessions"),
    "A6_store": (_stored_blobs, """, d AS (SELECT sha256(text) AS sha256, text, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0)
 SELECT sha256, strlen(any_value(text))::BIGINT AS bytes, true AS intact, substr(hex(encode(any_value(text))), 1, 48) AS head, CASE WHEN bool_or(doc_id % 2 = 0) THEN 1 ELSE 2 END AS call FROM d GROUP BY 1"""),
    "A8_pins": (_swept_blobs, """, d AS (SELECT sha256(text) AS sha256, text, doc_id FROM documents WHERE text IS NOT NULL)
 SELECT sha256, strlen(any_value(text))::BIGINT AS bytes, count(*) FILTER (doc_id % 2 = 0) > count(*) FILTER (doc_id % 4 = 0) OR bool_or(doc_id % 7 = 0) AS kept FROM d GROUP BY 1"""),
    "A14_local_projects": (lambda x: x.sessions.select("session_id", local_project(F.col("machine"), F.col("cwd"), F.when(F.col("session_id") % 3 == 0, F.concat("cwd", F.lit("/sub\\x/")))).alias("p")).select("session_id", "p.*"),
        """ SELECT session_id, concat('local:', machine, ':', coalesce(CASE session_id % 3 WHEN 0 THEN cwd || '/sub\\x/' END, cwd, '')) AS key, CASE WHEN cwd IS NULL THEN '(unknown location)' WHEN session_id % 3 = 0 THEN 'x' ELSE replace(cwd, '/home/u/', '') END AS display_name FROM sessions"""),
    "A5_export": (lambda x: export(chunks(x.messages), LIMIT), _CHUNK_SQL + f" SELECT session_id, sha256(coalesce(string_agg(data, '' ORDER BY byte_offset) FILTER (byte_offset + bytes <= {LIMIT}), '')) AS sha256, sum(bytes)::BIGINT AS total, sum(bytes) > {LIMIT} AS truncated FROM lg GROUP BY 1"),
    "A6_blobs": (lambda x: _of(x, "documents", "text"), ", b AS (" + _SHA.format("text", "documents") + ") SELECT sha256, max(bytes) AS bytes, count(*) AS holders FROM b GROUP BY 1"),
    "A7_missing_blobs": (lambda x: missing(_of(x, "conversations", "text"), _of(x, "documents", "text")), " SELECT DISTINCT sha256(text) AS sha256 FROM conversations WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)"),
    "A8_sweep": (lambda x: unreferenced(_of(x, "documents", "text"), _of(x, "conversations", "text"), _of(x, "benchmark", "text"), _of(x, "pages", "html")).select("sha256", "bytes"),
        ", r AS (SELECT sha256(text) AS h FROM conversations UNION SELECT sha256(text) FROM benchmark UNION SELECT sha256(html) FROM pages), b AS (" + _SHA.format("text", "documents") + ") SELECT DISTINCT sha256, bytes FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.h = b.sha256)"),
    "A9_referenced": (lambda x: referenced(_docs(x).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), _of(x, "documents", "text").where("holders > 1")),
        " SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)"),
}
