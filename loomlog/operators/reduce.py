"""Folding acts into a session's tables: messages, calls, results, usage, events, attachments, fallbacks and scalars.

One window over a session's lines in byte order numbers the messages; every table is then an aggregate or an unnesting of
the numbered lines, on the same partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.sources import jsonl
from loomlog.sources.jsonl import FACTS, FORMATS, SENTINEL, number, text


def numbered(acts: DataFrame) -> DataFrame:
    """B1: acts with `ordinal` of the line's own message and `place`, where what it reports belongs; `open`: a turn is open.

    A line opens a message unless it is an assistant line whose key equals that of the open turn. Messages that come in
    between without closing the turn (act inline) take a number and leave it open.
    """
    at = W.partitionBy("session_id").orderBy("byte_offset")
    past, upto = at.rowsBetween(W.unboundedPreceding, -1), at.rowsBetween(W.unboundedPreceding, W.currentRow)
    closing = F.when(F.col("act") != "inline", F.struct("act", "key"))
    df = acts.withColumn("_last", F.last(closing, ignorenulls=True).over(past))
    goes_on = (F.col("act") == "assistant") & (F.col("_last.act") == "assistant") & (F.col("key") == F.col("_last.key"))
    df = df.withColumn("_new", F.col("act").isNotNull() & ~F.coalesce(goes_on, F.lit(False)))
    df = df.withColumn("_n", F.sum(F.col("_new").cast("long")).over(upto))
    df = df.withColumns({"_turn": F.last(F.when(F.col("_new") & (F.col("act") == "assistant"), F.col("_n") - 1), ignorenulls=True).over(upto), "open": F.coalesce(F.last(closing, ignorenulls=True).over(upto)["act"] == "assistant", F.lit(False))})
    own = F.when(F.col("_new"), F.col("_n") - 1).when(F.col("act").isNotNull(), F.col("_turn"))
    place = F.coalesce(own, F.when(F.col("open"), F.col("_turn")).when(F.col("_n") > 0, F.col("_n") - 1))
    return df.withColumns({"ordinal": own, "place": place}).drop("_last", "_new", "_n", "_turn")


def parse(lines: DataFrame) -> DataFrame:
    """Lines (session_id, agent, byte_offset, line) -> numbered acts; agents other than FORMATS raise no rows."""
    return numbered(reduce(DataFrame.unionByName, [read(lines.where(F.col("agent") == name)) for name, read in FORMATS.items()]))


def _ordered(column: str):
    """The column's arrays of a group one after the other, in byte order."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", column))), lambda x: x[column]))


def messages(acts: DataFrame) -> DataFrame:
    """(session_id, ordinal, role, content, thinking_text, thinking_bytes, model, ts, has_thinking, has_tool_use), content_length in letters.

    Echoed reasoning counts only where the turn has none of its own. Of the user messages that open a session in a row,
    all but the last are context (format B writes its framing so).
    """
    said = acts.where("ordinal IS NOT NULL").groupBy("session_id", "ordinal").agg(
        F.min_by("act", "byte_offset").alias("role"), F.min_by("from_user", "byte_offset").alias("from_user"), F.min_by("ts", "byte_offset").alias("ts"), F.array_join(_ordered("texts"), "\n").alias("content"),
        F.array_join(_ordered("thinks"), "\n").alias("own"), F.array_join(_ordered("echoes"), "\n").alias("echo"), F.sum("think_bytes").alias("weight"), F.bool_or("thought").alias("has_thinking"), F.bool_or("tool_use").alias("has_tool_use"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("byte_offset"))).alias("model"), F.min_by("open_model", "byte_offset").alias("open_model"),
    )
    at = W.partitionBy("session_id").orderBy("ordinal")
    chained = (F.col("role") == "user") & F.coalesce(F.lead("from_user").over(at), F.lit(False))
    df = said.withColumn("chained", chained)
    stop = F.sum(((F.col("role") == "assistant") | ((F.col("role") == "user") & ~F.col("chained"))).cast("int")).over(at.rowsBetween(W.unboundedPreceding, -1))
    role = F.when(F.col("role") == "inline", "context").when(F.col("chained") & (F.coalesce(stop, F.lit(0)) == 0), "context").otherwise(F.col("role"))
    think = F.when(F.col("own") == "", F.col("echo")).otherwise(F.col("own"))
    weight = F.when((F.col("own") == "") & (F.col("weight") == 0), F.octet_length("echo")).otherwise(F.col("weight")).cast("long")
    model = F.when(F.col("role") == "assistant", F.coalesce("model", "open_model")).otherwise("")
    return df.select("session_id", "ordinal", role.alias("role"), "content", think.alias("thinking_text"), weight.alias("thinking_bytes"), model.alias("model"), "ts", "has_thinking", "has_tool_use", F.char_length("content").cast("long").alias("content_length"))


def _blob(body, media: str = "media"):
    """(sha256, bytes, media) of a body that may be a reference; '' has none."""
    ref = F.startswith(body, F.lit("{")) & F.get_json_object(body, f"$.{SENTINEL}").isNotNull()
    at = lambda k: F.get_json_object(body, f"$.{k}")
    sha = F.when(ref, at("sha256")).when(body != "", F.sha2(body.cast("binary"), 256))
    return {"sha256": sha, "bytes": F.when(ref, number(at("bytes"))).otherwise(F.octet_length(body).cast("bigint")), "media": F.when(ref, at("media_type")).otherwise(F.col(media)), "ref": ref}


def tool_calls(acts: DataFrame) -> DataFrame:
    """One row a call, numbered within its message in the order of lines and blocks."""
    c = acts.select("session_id", "ordinal", "byte_offset", F.posexplode("calls").alias("pos", "c")).select("session_id", "ordinal", "byte_offset", "pos", "c.*")
    blob = _blob(F.col("input"))
    index = F.row_number().over(W.partitionBy("session_id", "ordinal").orderBy("byte_offset", "pos")) - 1
    kept = lambda k, plain: F.when(blob["ref"], text(F.get_json_object("input", f"$.{k}"))).otherwise(plain)
    path = F.coalesce(F.when(blob["ref"], F.get_json_object("input", "$.file_path")), "path")
    return c.select(
        "session_id", F.col("ordinal").alias("message_ordinal"), index.cast("long").alias("call_index"), F.col("name").alias("tool_name"), jsonl.category(F.col("name")).alias("category"), path.alias("file_path"),
        kept("detail", F.when(F.col("media") == "application/json", jsonl.detail(F.col("input"))).otherwise("")).alias("detail"), blob["sha256"].alias("input_sha256"), blob["bytes"].alias("input_bytes"), blob["media"].alias("input_media"),
        F.col("uid").alias("call_uid"), F.col("agent").alias("attribution_agent"), F.col("skill").alias("attribution_skill"), F.col("plugin").alias("attribution_plugin"),
    )


def results(acts: DataFrame) -> DataFrame:
    """One row a result, `seq` in the order of lines and blocks; bodies as blobs."""
    r = acts.select("session_id", "byte_offset", F.posexplode("results").alias("pos", "r")).select("session_id", "byte_offset", "pos", "r.*")
    blob = _blob(F.col("body"))
    held = F.when(F.col("struct_body") != "", F.sha2(F.col("struct_body").cast("binary"), 256))
    seq = F.row_number().over(W.partitionBy("session_id").orderBy("byte_offset", "pos"))
    return r.select("session_id", F.col("uid").alias("call_uid"), seq.cast("long").alias("seq"), "status", blob["sha256"].alias("result_sha256"), blob["bytes"].alias("result_bytes"), blob["media"].alias("result_media"), held.alias("struct_sha256"))


def patched_calls(acts: DataFrame) -> DataFrame:
    """Calls with the first result of their id; pending ones have no status."""
    first = results(acts).groupBy("session_id", "call_uid").agg(F.min_by(F.struct("status", "result_sha256", "result_bytes", "result_media", "struct_sha256"), "seq").alias("r"))
    return tool_calls(acts).join(first, ["session_id", "call_uid"], "left").select("*", "r.*").drop("r")


def usage(acts: DataFrame) -> DataFrame:
    """Token counts as reported, one row a line; format B's belong to the open turn, if one is open."""
    ordinal = F.when(F.col("usage_open"), F.when(F.col("open"), F.col("place"))).otherwise(F.col("ordinal"))
    return acts.where("usage IS NOT NULL").select("session_id", ordinal.alias("message_ordinal"), "usage.*", F.col("ts").alias("occurred_at"), F.col("byte_offset").alias("source_offset"), F.lit(0).cast("long").alias("source_index"))


def events(acts: DataFrame) -> DataFrame:
    """Events in the order of lines, with the open or else the last message."""
    e = acts.select("session_id", "byte_offset", "place", "ts", F.posexplode("events").alias("pos", "e"))
    seq = F.row_number().over(W.partitionBy("session_id").orderBy("byte_offset", "pos")) - 1
    return e.select("session_id", seq.cast("long").alias("seq"), F.col("place").alias("message_ordinal"), "e.kind", "e.attrs", F.col("ts").alias("occurred_at"))


def attachments(acts: DataFrame) -> DataFrame:
    """Images by content, each once a session, at its first place; values that are no image are left out."""
    i = acts.select("session_id", "byte_offset", "place", F.posexplode("images").alias("pos", "i")).select("session_id", "byte_offset", "place", "pos", "i.*")
    ref = F.startswith("data", F.lit("{")) & F.get_json_object("data", f"$.{SENTINEL}").isNotNull()
    uri = F.startswith("data", F.lit("data:")) & F.contains(F.left("data", F.lit(512)), F.lit(";base64,"))
    payload = F.when(uri, F.substring_index("data", ";base64,", -1)).otherwise(F.col("data"))
    sniffed = F.coalesce(*[F.when(F.startswith(payload, F.lit(k)), F.lit(v)) for k, v in jsonl.IMAGES.items()])
    named = F.when(uri, jsonl.some(F.regexp_extract("data", r"^data:([^;,]*)", 1)))
    content = F.try_to_binary(payload, F.lit("base64"))
    sha = F.when(ref, F.get_json_object("data", "$.sha256")).when(uri | sniffed.isNotNull(), F.sha2(content, 256))
    out = i.select("session_id", "byte_offset", "pos", F.col("place").alias("message_ordinal"), sha.alias("sha256"), F.when(ref, number(F.get_json_object("data", "$.bytes"))).otherwise(F.octet_length(content)).cast("long").alias("bytes"), F.when(ref, F.get_json_object("data", "$.media_type")).otherwise(F.coalesce(named, sniffed, F.lit("application/octet-stream"))).alias("media_type"), "filename")
    first = F.row_number().over(W.partitionBy("session_id", "sha256").orderBy("byte_offset", "pos"))
    return out.where("sha256 IS NOT NULL").withColumn("_n", first).where("_n = 1").drop("_n", "byte_offset", "pos")


def fallbacks(acts: DataFrame) -> DataFrame:
    """Markers merged by (session, key): the first ordinal with its instant, and the last value that is not empty of each field."""
    f = acts.where("fallback IS NOT NULL").select("session_id", "byte_offset", "ordinal", "ts", "fallback.*")
    at = F.col("byte_offset")
    last = lambda c: F.max_by(c, F.when((F.col(c) != "") if not c.startswith("declined") else F.col(c).isNotNull(), at)).alias(c)
    own = F.when(F.col("own"), at)
    return f.groupBy("session_id", "dedup_key").agg(
        F.min_by("ordinal", own).alias("message_ordinal"), *[text(last(c)).alias(c) for c in ("from_model", "to_model", "trigger")], *[last(c) for c in ("category", "explanation", "declined_input", "declined_output", "declined_cache_write", "declined_cache_read")],
        F.coalesce(F.min_by("ts", own), F.min_by("ts", F.when(F.col("ts").isNotNull(), at))).alias("occurred_at"),
    )


def identity(acts: DataFrame) -> DataFrame:
    """Span of all instants and the last known value of every fact of a session."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("byte_offset"))).alias(c)
    return acts.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), *[last(c) for c in FACTS.split()])
