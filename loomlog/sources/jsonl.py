"""Readers of the three log formats: one raw line -> one row of acts, without state of other lines where the format allows.

An act is what a line does to its session: it may start a message (`act`) or continue the open one (`key`), and it may
carry text, reasoning, tool calls, results, usage, events, attachments, fallback markers and facts about the session.
loomlog.operators.reduce folds acts into tables. Malformed lines have no act and no instant.

Values are read as text whatever their JSON type, missing ones as ''. Nested values keep their JSON spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The key that marks a body which a client has put into the blob store and replaced by a reference.
SENTINEL = "blob_ref"
#: Tool names by category, in lower case.
CATEGORIES = {
    "read": ["read", "readfile", "view", "cat"],
    "write": ["write", "writefile", "create"],
    "edit": ["edit", "apply_patch", "applypatch", "str_replace", "multiedit"],
    "bash": ["bash", "shell", "shell_command", "exec_command", "run", "execute"],
    "search": ["glob", "grep", "search", "find", "rg"],
}
#: Keys of a tool's input that can stand for it, in order, and the most bytes they may have.
DETAIL_KEYS, DETAIL_BYTES = ["command", "pattern", "url", "query", "description", "skill"], 2048
#: What format B's injected framing holds; two of them make a user line context.
FRAMING = ["# AGENTS.md instructions for ", "<environment_context>", "<user_instructions>", "<recommended_plugins>"]
#: First letters of an image in base64.
IMAGES = {"iVBOR": "image/png", "/9j/": "image/jpeg", "R0lGOD": "image/gif", "UklGR": "image/webp"}

_JSON = {"allowSingleQuotes": "false"}
_NAMED = lambda names: ", ".join(f"{n} string" for n in names.split())
_BLOCK = _NAMED("type text thinking signature data id name input arguments tool_use_id content is_error image_url") + ", source struct<data: string>, `from` struct<model: string>, `to` struct<model: string>"
_ITERATION = _NAMED("type model input_tokens output_tokens cache_creation_input_tokens cache_read_input_tokens")
CALL = "struct<name: string, uid: string, input: string, media: string, path: string, agent: string, skill: string, plugin: string>"
RESULT = "struct<uid: string, status: string, body: string, media: string, struct_body: string>"
USAGE = "struct<model: string, input: bigint, output: bigint, cache_write: bigint, cache_read: bigint, reasoning: bigint, dedup_key: string>"
EVENT = "struct<kind: string, attrs: string>"
IMAGE = "struct<data: string, filename: string>"
FALLBACK = "struct<dedup_key: string, own: boolean, from_model: string, to_model: string, trigger: string, category: string, explanation: string, declined_input: bigint, declined_output: bigint, declined_cache_write: bigint, declined_cache_read: bigint>"
FACTS = "cwd git_branch slug title mode effort subagent pr_number pr_url pr_repo parent_source_id"


def text(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def some(c: Column) -> Column:
    """c, or null if it is empty."""
    return F.when(c != "", c)


def number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("bigint"), F.lit(0).cast("bigint"))


def instant(c: Column) -> Column:
    """RFC 3339 with or without fractions -> timestamp, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"), c.try_cast("timestamp"))


def category(name: Column) -> Column:
    """Coarse category of a tool, '' if unknown."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.isin(names), F.lit(c)) for c, names in CATEGORIES.items()], F.lit(""))


def detail(body: Column) -> Column:
    """The first of DETAIL_KEYS that is a string, not empty and not too long; '' otherwise or if body is no JSON object."""
    v = F.try_parse_json(body)
    one = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    is_text = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING"
    return F.coalesce(*[F.when(is_text(k) & (F.octet_length(one(k)) <= DETAIL_BYTES), some(one(k))) for k in DETAIL_KEYS], F.lit(""))


def is_list(line: Column, path: str, value: Column) -> Column:
    """Whether the value at path, read as text already, is a JSON array and not a string that looks like one."""
    return F.coalesce(F.when(F.startswith(value, F.lit("[")), F.try_variant_get(F.try_parse_json(line), path, "array<variant>").isNotNull()), F.lit(False))


def blocks(content: Column) -> Column:
    """The blocks of a JSON array of typed blocks: (raw, b); null if content is none."""
    raw = F.from_json(content, "array<string>", _JSON)
    return F.transform(raw, lambda e: F.struct(e.alias("raw"), F.from_json(e, _BLOCK, _JSON).alias("b")))


def block_text(content: Column, listed: Column) -> Column:
    """A string as it is; of an array the bare strings and text blocks, joined by line ends."""
    kinds = ["text", "output_text", "input_text"]
    one = lambda x: F.when(x["b"]["type"].isin(kinds), text(x["b"]["text"])).when(~F.startswith(x["raw"], F.lit("{")), x["raw"])
    joined = F.array_join(F.transform(blocks(content), one), "\n")
    return F.when(listed, text(joined)).otherwise(text(content))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _events(*cases: tuple) -> Column:
    """The event of the first case whose test holds; attrs are given as (name, value) pairs, in the order of names."""
    out = None
    for test, kind, attrs in cases:
        one = F.array(F.struct(F.lit(kind).alias("kind"), (F.to_json(F.struct(*[v.alias(k) for k, v in sorted(attrs.items())])) if attrs else F.lit("{}")).alias("attrs")))
        out = F.when(test, one) if out is None else out.when(test, one)
    return out.otherwise(_empty(EVENT))


def _acts(df: DataFrame, **given: Column) -> DataFrame:
    """The columns of an act; what a format does not give is empty."""
    blank = {
        "act": F.lit(None).cast("string"), "key": F.lit(None).cast("string"), "from_user": F.lit(False), "texts": _empty("string"), "thinks": _empty("string"), "echoes": _empty("string"),
        "think_bytes": F.lit(0).cast("bigint"), "thought": F.lit(False), "tool_use": F.lit(False), "model": F.lit(None).cast("string"), "open_model": F.lit(""), "calls": _empty(CALL), "results": _empty(RESULT),
        "usage": F.lit(None).cast(USAGE), "usage_open": F.lit(False), "events": _empty(EVENT), "images": _empty(IMAGE), "fallback": F.lit(None).cast(FALLBACK),
    } | {f: F.lit(None).cast("string") for f in FACTS.split()}
    cols = blank | {k: v if k not in FACTS.split() else some(text(v)) for k, v in given.items()}
    return df.select("session_id", "byte_offset", "ts", *[c.alias(k) for k, c in cols.items()])


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    df = lines.withColumn("j", F.from_json("line", schema, _JSON))
    return df.withColumn("ts", instant(F.col("j.timestamp"))).withColumn("type", text("j.type"))


def _kept(values: Column) -> Column:
    return F.filter(values, lambda x: x != "")


_A = (
    _NAMED("type subtype timestamp cwd gitBranch slug isSidechain isMeta isCompactSummary attributionAgent attributionSkill attributionPlugin toolUseResult requestId customTitle permissionMode prNumber prUrl prRepository")
    + ", " + _NAMED("trigger originalModel fallbackModel apiRefusalCategory apiRefusalExplanation durationMs messageCount retryAttempt maxRetries hookCount preventedContinuation stopReason")
    + ", hookErrors array<string>, error struct<formatted: string, message: string>, compactMetadata struct<trigger: string, preTokens: string, postTokens: string, cumulativeDroppedTokens: string>"
    + ", message struct<id: string, model: string, content: string, usage: struct<input_tokens: string, output_tokens: string, cache_creation_input_tokens: string, cache_read_input_tokens: string, iterations: array<struct<" + _ITERATION.replace(" string", ": string") + ">>>>"
    + ", attachment struct<type: string, content: string, path: string, addedBlocks: array<string>, addedLines: array<string>, addedNames: array<string>, allowedTools: array<string>, skills: array<struct<content: string>>>"
)


def format_a(lines: DataFrame) -> DataFrame:
    """B2: assistant lines of one message id are one turn; lines that only deliver tool results leave it open."""
    j = lambda p: F.col(f"j.{p}")
    df = _parsed(lines, _A).withColumn("content", text(j("message.content")))
    df = df.withColumn("listed", is_list(F.col("line"), "$.message.content", F.col("content"))).withColumn("bs", F.when(F.col("listed"), blocks(F.col("content"))).otherwise(_empty(f"struct<raw: string, b: struct<{_struct(_BLOCK)}>>")))
    df = df.withColumn("said", block_text(F.col("content"), F.col("listed")))
    of = lambda *kinds: F.filter("bs", lambda x: x["b"]["type"].isin(*kinds))
    user, assistant, system = F.col("type") == "user", F.col("type") == "assistant", F.col("type") == "system"
    real = user & ((F.trim(F.regexp_replace("said", r"\s+", " ")) != "") | (F.size(of("image")) > 0))
    true = lambda c: F.coalesce(c == "true", F.lit(False))
    aside = true(j("isMeta")) | true(j("isCompactSummary"))
    context = F.when(F.col("type") == "attachment", _injected(j("attachment")))
    act = F.when(real & aside, "context").when(real, "user").when(assistant, "assistant").when(context.isNotNull(), "context")
    results = F.transform(of("tool_result"), lambda x: F.struct(text(x["b"]["tool_use_id"]).alias("uid"), F.when(true(x["b"]["is_error"]), "error").otherwise("ok").alias("status"), _body(x["raw"], "$.content", text(x["b"]["content"])).alias("body"), _media(x["raw"], "$.content", text(x["b"]["content"])).alias("media"), F.lit("").alias("struct_body")))
    # The structured result has no id, so it counts only on a line with exactly one result
    one = F.transform(results, lambda r: r.withField("struct_body", F.when(F.size(results) == 1, text(j("toolUseResult"))).otherwise("")))
    calls = F.transform(of("tool_use"), lambda x: F.struct(text(x["b"]["name"]).alias("name"), text(x["b"]["id"]).alias("uid"), text(x["b"]["input"]).alias("input"), F.lit("application/json").alias("media"), text(F.get_json_object(x["b"]["input"], "$.file_path")).alias("path"), text(j("attributionAgent")).alias("agent"), text(j("attributionSkill")).alias("skill"), text(j("attributionPlugin")).alias("plugin")))
    u = j("message.usage")
    usage = F.struct(text(j("message.model")).alias("model"), number(u["input_tokens"]).alias("input"), number(u["output_tokens"]).alias("output"), number(u["cache_creation_input_tokens"]).alias("cache_write"), number(u["cache_read_input_tokens"]).alias("cache_read"), F.lit(0).cast("bigint").alias("reasoning"), text(j("message.id")).alias("dedup_key"))
    thinking = of("thinking", "redacted_thinking")
    weight = F.aggregate(thinking, F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["b"]["type"] == "thinking", F.octet_length(text(x["b"]["thinking"])) + F.octet_length(text(x["b"]["signature"]))).otherwise(F.octet_length(text(x["b"]["data"]))))
    sub = lambda s: system & F.coalesce(j("subtype") == s, F.lit(False))
    meta = j("compactMetadata")
    events = _events(
        (sub("compact_boundary"), "compaction", {"trigger": text(meta["trigger"]), "pre_tokens": number(meta["preTokens"]), "post_tokens": number(meta["postTokens"]), "dropped_tokens": number(meta["cumulativeDroppedTokens"])}),
        (sub("turn_duration"), "turn_end", {"duration_ms": number(j("durationMs")), "message_count": number(j("messageCount"))}),
        (sub("api_error"), "api_error", {"message": F.coalesce(some(text(j("error.formatted"))), j("error.message"), F.lit("")), "retry_attempt": number(j("retryAttempt")), "max_retries": number(j("maxRetries"))}),
        (sub("stop_hook_summary"), "stop_hook", {"hook_count": number(j("hookCount")), "prevented_continuation": true(j("preventedContinuation")), "stop_reason": some(text(j("stopReason"))), "errors": F.when(F.size(j("hookErrors")) > 0, j("hookErrors"))}),
    )
    return _acts(
        df, act=act, key=F.when(assistant, some(text(j("message.id")))),
        texts=F.when(assistant, _kept(F.transform(of("text"), lambda x: text(x["b"]["text"])))).when(real, F.array("said")).when(context.isNotNull(), F.array(context)).otherwise(_empty("string")),
        thinks=F.when(assistant, _kept(F.transform(of("thinking"), lambda x: text(x["b"]["thinking"])))).otherwise(_empty("string")),
        think_bytes=F.when(assistant, weight).otherwise(0), thought=assistant & (F.size(thinking) > 0), tool_use=assistant & (F.size(of("tool_use")) > 0),
        model=F.when(assistant, some(text(j("message.model")))), calls=F.when(assistant, calls).otherwise(_empty(CALL)), results=F.when(user, F.filter(one, lambda r: r["uid"] != "")).otherwise(_empty(RESULT)),
        usage=F.when(assistant & u.isNotNull(), usage), events=events,
        images=F.when(real, F.transform(of("image"), lambda x: F.struct(text(x["b"]["source"]["data"]).alias("data"), F.lit("").alias("filename")))).otherwise(_empty(IMAGE)),
        fallback=F.when(assistant, _fallback(j, of("fallback"))).when(sub("model_refusal_fallback"), _refusal(j)),
        cwd=j("cwd"), git_branch=j("gitBranch"), slug=j("slug"), title=F.when(F.col("type") == "custom-title", j("customTitle")), mode=F.when(F.col("type") == "permission-mode", j("permissionMode")),
        subagent=F.when(true(j("isSidechain")), j("attributionAgent")), pr_number=F.when(F.col("type") == "pr-link", j("prNumber")), pr_url=F.when(F.col("type") == "pr-link", j("prUrl")), pr_repo=F.when(F.col("type") == "pr-link", j("prRepository")),
    )


def _struct(names: str) -> str:
    """Field list of a struct type from one of from_json's."""
    return ", ".join(x if ":" in x.split("<")[0] else x.replace(" ", ": ", 1) for x in _fields(names))


def _fields(s: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(s[last:i].strip())
            last = i + 1
    return [*out, s[last:].strip()]


def _body(raw: Column, path: str, value: Column) -> Column:
    """A tool's body: text of blocks if it is an array, else as it is."""
    return F.when(is_list(raw, path, value), text(F.array_join(F.transform(blocks(value), lambda x: F.when(x["b"]["type"].isin("text", "output_text", "input_text"), text(x["b"]["text"])).when(~F.startswith(x["raw"], F.lit("{")), x["raw"])), "\n"))).otherwise(value)


def _media(raw: Column, path: str, value: Column) -> Column:
    held = F.startswith(value, F.lit("{")) & F.try_variant_get(F.try_parse_json(raw), path, "map<string, variant>").isNotNull()
    return F.when(held, "application/json").when(value == "", "").otherwise("text/plain")


def _injected(a: Column) -> Column:
    """Text of the attachments that carry instructions; null for those that only carry state."""
    joined = lambda c, sep: some(F.array_join(_kept(c), sep))
    said, memory = some(text(a["content"])), some(text(F.get_json_object(a["content"], "$.content")))
    memory = F.when(text(a["path"]) != "", F.concat(F.lit("Memory from "), a["path"], F.lit(":\n\n"), memory)).otherwise(memory)
    kinds = {
        "skill_listing": F.concat(F.lit("Available skills:\n"), said), "mcp_instructions_delta": F.concat(F.lit("MCP server instructions:\n\n"), joined(a["addedBlocks"], "\n\n")),
        "agent_listing_delta": F.concat(F.lit("Available agents:\n"), joined(a["addedLines"], "\n")), "deferred_tools_delta": F.concat(F.lit("Deferred tools available: "), joined(a["addedNames"], ", ")),
        "nested_memory": memory, "command_permissions": F.concat(F.lit("Allowed tools: "), joined(a["allowedTools"], ", ")), "invoked_skills": joined(F.transform(a["skills"], lambda s: text(s["content"])), "\n\n"),
    }
    return F.coalesce(*[F.when(a["type"] == k, v) for k, v in kinds.items()])


def _fallback(j, marks: Column) -> Column:
    """Of an assistant line, from a fallback block or a fallback_message iteration; a bare change of model is none."""
    its = F.coalesce(j("message.usage.iterations"), F.array().cast(f"array<struct<{_struct(_ITERATION)}>>"))
    served, tried = F.filter(its, lambda x: x["type"] == "fallback_message"), F.filter(its, lambda x: x["type"] == "message")
    block, last = F.get(marks, 0)["b"], lambda a: F.element_at(a, -1)
    to = F.coalesce(some(text(block["to"]["model"])), F.when(F.size(served) > 0, some(text(last(served)["model"]))), j("message.model"), F.lit(""))
    declined = lambda c: F.when(F.size(served) > 0, F.aggregate(tried, F.lit(0).cast("bigint"), lambda t, x: t + number(x[c])))
    return F.when((F.size(marks) > 0) | (F.size(served) > 0), F.struct(
        F.coalesce(some(text(j("requestId"))), j("message.id"), F.lit("")).alias("dedup_key"), F.lit(True).alias("own"),
        F.when(F.size(marks) > 0, text(block["from"]["model"])).when(F.size(tried) > 0, text(last(tried)["model"])).otherwise("").alias("from_model"), to.alias("to_model"),
        F.lit("").alias("trigger"), F.lit("").alias("category"), F.lit("").alias("explanation"),
        declined("input_tokens").alias("declined_input"), declined("output_tokens").alias("declined_output"), declined("cache_creation_input_tokens").alias("declined_cache_write"), declined("cache_read_input_tokens").alias("declined_cache_read"),
    ))


def _refusal(j) -> Column:
    none = [F.lit(None).cast("bigint").alias(f"declined_{c}") for c in ("input", "output", "cache_write", "cache_read")]
    named = {"dedup_key": "requestId", "from_model": "originalModel", "to_model": "fallbackModel", "trigger": "trigger", "category": "apiRefusalCategory", "explanation": "apiRefusalExplanation"}
    f = {k: text(j(v)).alias(k) for k, v in named.items()}
    return F.struct(f["dedup_key"], F.lit(False).alias("own"), f["from_model"], f["to_model"], f["trigger"], f["category"], f["explanation"], *none)


_B = (
    "type string, timestamp string, payload struct<" + _struct(_NAMED("type role model cwd base_instructions parent_thread_id agent_path agent_nickname name call_id arguments input output result saved_path content summary encrypted_content text duration_ms time_to_first_token_ms reason agent_thread_id kind query action results"))
    + ", git: struct<branch: string>, collaboration_mode: struct<settings: struct<reasoning_effort: string, developer_instructions: string>>, sandbox_policy: struct<type: string>, state: struct<agents_md: struct<text: string>>"
    + ", info: struct<last_token_usage: struct<input_tokens: string, cached_input_tokens: string, cache_write_input_tokens: string, output_tokens: string, reasoning_output_tokens: string>>"
    + ", invocation: struct<server: string, tool: string, arguments: string>, images: array<string>>"
)


def format_b(lines: DataFrame) -> DataFrame:
    """A run of reasoning, calls and assistant text is one turn; what a user, system or changed context line says ends it."""
    p = lambda c: F.col(f"j.payload.{c}")
    df = _parsed(lines, _B).withColumn("kind", text(p("type")))
    at = W.partitionBy("session_id").orderBy("byte_offset")
    past, upto = at.rowsBetween(W.unboundedPreceding, -1), at.rowsBetween(W.unboundedPreceding, W.currentRow)
    typ, item = lambda t: F.col("type") == t, lambda k: (F.col("type") == "response_item") & (F.col("kind") == k)
    event = lambda k: (F.col("type") == "event_msg") & (F.col("kind") == k)
    other = typ("response_item") & ~F.col("kind").isin("function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output", "image_generation_call", "reasoning", "agent_message")
    prompt = F.when(typ("session_meta"), some(F.coalesce(some(text(F.get_json_object(p("base_instructions"), "$.text"))), p("base_instructions"), F.lit(""))))
    dev = F.when(typ("turn_context"), some(text(p("collaboration_mode.settings.developer_instructions"))))
    world = F.when(typ("world_state"), some(text(p("state.agents_md.text"))))
    ended = event("web_search_end") | event("mcp_tool_call_end")
    called = item("function_call") | item("custom_tool_call")
    df = df.withColumns({"prompt": prompt, "dev": dev, "world": world, "uid": F.when(called | ended, some(text(p("call_id")))), "uses": called | ended})
    df = df.withColumn("said", block_text(text(p("content")), is_list(F.col("line"), "$.payload.content", text(p("content")))))
    # an end event makes a call only if nothing named its id before
    df = df.withColumn("fresh", F.col("uid").isNotNull() & (F.row_number().over(W.partitionBy("session_id", "uid").orderBy("byte_offset")) == 1))
    changed = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.last(c, ignorenulls=True).over(past))
    df = df.withColumns({"running": text(F.last(some(text(p("model"))), ignorenulls=True).over(upto)), "new_prompt": changed("prompt"), "new_dev": changed("dev"), "new_world": changed("world")})
    user, assistant = other & F.coalesce(p("role") == "user", F.lit(False)), other & F.coalesce(p("role") == "assistant", F.lit(False))
    mail = item("agent_message") & (F.col("said") != "")
    echo = event("agent_reasoning") & (text(p("text")) != "")
    working = called | item("image_generation_call") | item("reasoning") | assistant | echo | (ended & F.col("fresh"))
    drop = event("image_generation_end") | event("user_message")  # they attach to the last message, or open a turn if there is none
    framed = sum(F.when(F.contains("said", F.lit(m)), 1).otherwise(0) for m in FRAMING) >= 2
    act = F.when(F.col("new_prompt"), "system").when(F.col("new_dev") | F.col("new_world"), "context").when(mail, "inline").when(user & framed, "context").when(user, "user").when(working, "assistant")
    df = df.withColumn("act", act)
    lead = F.sum(F.when(F.col("act").isNotNull() | drop, 1).otherwise(0)).over(past)
    df = df.withColumn("act", F.when(drop & (F.coalesce(lead, F.lit(0)) == 0), "assistant").otherwise(F.col("act")))

    summary = F.from_json(p("summary"), "array<struct<text: string>>", _JSON)
    summed = F.array_join(_kept(F.transform(summary, lambda s: text(s["text"]))), "\n")
    thought = F.array_join(_kept(F.array("said", text(summed))), "\n")
    args = text(p("arguments"))
    search_input = F.concat(F.lit("{"), F.array_join(F.filter(F.array(F.when(p("action").isNotNull(), F.concat(F.lit('"action":'), _raw(F.col("line"), "$.payload.action"))), F.when(p("query").isNotNull(), F.concat(F.lit('"query":'), _raw(F.col("line"), "$.payload.query")))), lambda x: x.isNotNull()), ","), F.lit("}"))
    name = F.when(event("web_search_end"), "web_search").when(event("mcp_tool_call_end"), F.concat(F.lit("mcp__"), text(p("invocation.server")), F.lit("__"), text(p("invocation.tool")))).otherwise(text(p("name")))
    body = F.when(event("web_search_end"), search_input).when(event("mcp_tool_call_end"), text(p("invocation.arguments"))).when(item("custom_tool_call"), text(p("input"))).otherwise(args)
    media = F.when(item("custom_tool_call"), "text/plain").otherwise("application/json")
    call = F.struct(name.alias("name"), text("uid").alias("uid"), body.alias("input"), media.alias("media"), F.when(item("function_call"), text(F.get_json_object(args, "$.file_path"))).otherwise("").alias("path"), F.lit("").alias("agent"), F.lit("").alias("skill"), F.lit("").alias("plugin"))
    output, is_out = text(p("output")), item("function_call_output") | item("custom_tool_call_output")
    got = F.when(event("web_search_end"), p("results")).otherwise(p("result"))
    failed = event("mcp_tool_call_end") & F.get_json_object("line", "$.payload.result.Err").isNotNull()
    blank = F.lit("").alias("struct_body")
    # This format's outputs do not tell failure, so they are ok
    results = F.when(is_out & (text(p("call_id")) != ""), F.array(F.struct(p("call_id").alias("uid"), F.lit("ok").alias("status"), _body(F.col("line"), "$.payload.output", output).alias("body"), _media(F.col("line"), "$.payload.output", output).alias("media"), blank)))
    results = results.when(ended & F.col("fresh") & got.isNotNull(), F.array(F.struct(F.col("uid"), F.when(failed, "error").otherwise("ok").alias("status"), got.alias("body"), F.when(got.rlike(r"^[\[{]"), "application/json").otherwise("text/plain").alias("media"), blank))).otherwise(_empty(RESULT))
    u = p("info.last_token_usage")
    cached, wrote = number(u["cached_input_tokens"]), number(u["cache_write_input_tokens"])
    usage = F.struct(F.col("running").alias("model"), F.greatest(F.lit(0).cast("bigint"), number(u["input_tokens"]) - cached - wrote).alias("input"), number(u["output_tokens"]).alias("output"), wrote.alias("cache_write"), cached.alias("cache_read"), number(u["reasoning_output_tokens"]).alias("reasoning"), F.lit("").alias("dedup_key"))
    events = _events(
        (typ("compacted"), "compaction", {}),
        (event("task_complete"), "turn_end", {"duration_ms": number(p("duration_ms")), "ttft_ms": number(p("time_to_first_token_ms"))}),
        (event("turn_aborted"), "turn_aborted", {"reason": text(p("reason")), "duration_ms": number(p("duration_ms"))}),
        (event("sub_agent_activity"), "subagent_activity", {"thread_id": text(p("agent_thread_id")), "agent_path": text(p("agent_path")), "state": text(F.get_json_object("line", "$.payload.kind"))}),
    )
    listed = is_list(F.col("line"), "$.payload.content", text(p("content")))
    pasted = F.when(listed, F.transform(F.filter(blocks(text(p("content"))), lambda x: x["b"]["image_url"].isNotNull()), lambda x: F.struct(x["b"]["image_url"].alias("data"), F.lit("").alias("filename"))))
    made = F.array(F.struct(text(p("result")).alias("data"), F.regexp_extract(text(p("saved_path")), r"([^/\\]*)$", 1).alias("filename")))
    images = F.when(user & (F.col("act") == "user"), pasted).when(item("image_generation_call") | event("image_generation_end"), made).when(event("user_message"), F.transform(p("images"), lambda x: F.struct(x.alias("data"), F.lit("").alias("filename"))))
    last = F.regexp_extract(text(p("agent_path")), r"([^/\\]*)$", 1)
    return _acts(
        df, act=F.col("act"), key=F.when(F.col("act") == "assistant", "turn"), from_user=user,
        texts=F.when(F.col("new_prompt"), F.array("prompt")).when(F.col("new_dev"), F.array("dev")).when(F.col("new_world"), F.array("world")).when(assistant, _kept(F.array("said"))).when(user | mail, F.array("said")).otherwise(_empty("string")),
        thinks=F.when(item("reasoning"), _kept(F.array(thought))).otherwise(_empty("string")), think_bytes=F.when(item("reasoning"), F.octet_length(thought) + F.octet_length(text(p("encrypted_content")))).otherwise(0).cast("bigint"),
        echoes=F.when(echo, F.array(p("text"))).otherwise(_empty("string")), thought=item("reasoning") | echo, tool_use=called | item("image_generation_call") | (ended & F.col("fresh")),
        model=F.when(assistant, some(F.col("running"))), open_model=F.col("running"), calls=F.when(called | (ended & F.col("fresh")), F.array(call)).otherwise(_empty(CALL)), results=results,
        usage=F.when(event("token_count") & u.isNotNull(), usage), usage_open=F.lit(True), events=events, images=F.coalesce(images, _empty(IMAGE)),
        cwd=F.when(typ("session_meta"), p("cwd")), git_branch=F.when(typ("session_meta"), p("git.branch")), effort=F.when(typ("turn_context"), p("collaboration_mode.settings.reasoning_effort")), mode=F.when(typ("turn_context"), p("sandbox_policy.type")),
        parent_source_id=F.when(typ("session_meta"), p("parent_thread_id")), subagent=F.when(typ("session_meta"), F.coalesce(F.when(last != "root", some(last)), p("agent_nickname"))),
    )


def _raw(line: Column, path: str) -> Column:
    """The value at path in its JSON spelling."""
    return F.to_json(F.try_variant_get(F.try_parse_json(line), path, "variant"))


_C = _NAMED("type timestamp id cwd provider modelId thinkingLevel") + ", message struct<role: string, model: string, content: string, toolCallId: string, isError: string, usage: struct<input: string, output: string>>"


def format_c(lines: DataFrame) -> DataFrame:
    """Every message line is a message of its own; reasoning is in the clear."""
    j = lambda c: F.col(f"j.{c}")
    df = _parsed(lines, _C).withColumn("content", text(j("message.content"))).withColumn("role", F.when(F.col("type") == "message", text(j("message.role"))).otherwise(""))
    df = df.withColumn("listed", is_list(F.col("line"), "$.message.content", F.col("content"))).withColumn("bs", F.when(F.col("listed"), blocks(F.col("content"))).otherwise(_empty(f"struct<raw: string, b: struct<{_struct(_BLOCK)}>>")))
    of = lambda kind: F.filter("bs", lambda x: x["b"]["type"] == kind)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    said = block_text(F.col("content"), F.col("listed"))
    calls = F.transform(of("toolCall"), lambda x: F.struct(text(x["b"]["name"]).alias("name"), text(x["b"]["id"]).alias("uid"), text(x["b"]["arguments"]).alias("input"), F.lit("application/json").alias("media"), text(F.get_json_object(x["b"]["arguments"], "$.file_path")).alias("path"), F.lit("").alias("agent"), F.lit("").alias("skill"), F.lit("").alias("plugin")))
    result = F.struct(j("message.toolCallId").alias("uid"), F.when(j("message.isError") == "true", "error").otherwise("ok").alias("status"), _body(F.col("line"), "$.message.content", F.col("content")).alias("body"), _media(F.col("line"), "$.message.content", F.col("content")).alias("media"), F.lit("").alias("struct_body"))
    zero = F.lit(0).cast("bigint")
    usage = F.struct(text(j("message.model")).alias("model"), number(j("message.usage.input")).alias("input"), number(j("message.usage.output")).alias("output"), zero.alias("cache_write"), zero.alias("cache_read"), zero.alias("reasoning"), text(j("id")).alias("dedup_key"))
    return _acts(
        df, act=F.when(user, "user").when(assistant, "assistant"),
        # an assistant's text blocks are joined even where they are empty
        texts=F.when(assistant, F.transform(of("text"), lambda x: text(x["b"]["text"]))).when(user, F.array(said)).otherwise(_empty("string")),
        thinks=F.when(assistant, _kept(F.transform(of("thinking"), lambda x: text(x["b"]["thinking"])))).otherwise(_empty("string")),
        think_bytes=F.when(assistant, F.aggregate(of("thinking"), zero, lambda t, x: t + F.octet_length(text(x["b"]["thinking"])))).otherwise(0), thought=assistant & (F.size(of("thinking")) > 0), tool_use=assistant & (F.size(of("toolCall")) > 0),
        model=F.when(assistant, some(text(j("message.model")))), calls=F.when(assistant, calls).otherwise(_empty(CALL)),
        results=F.when((F.col("role") == "toolResult") & (text(j("message.toolCallId")) != ""), F.array(result)).otherwise(_empty(RESULT)), usage=F.when(assistant & j("message.usage").isNotNull(), usage),
        events=_events((F.col("type") == "model_change", "model_change", {"provider": text(j("provider")), "model": text(j("modelId"))}), (F.col("type") == "thinking_level_change", "thinking_level_change", {"level": text(j("thinkingLevel"))})),
        cwd=F.when(F.col("type") == "session", j("cwd")),
    )


FORMATS = {"format_a": format_a, "format_b": format_b, "format_c": format_c}
