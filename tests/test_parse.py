"""The three log formats on sessions made by random steps: each step writes lines and states what they must become."""

import hashlib
import json
import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest

from loomlog.operators import reduce

SESSIONS = 8
WORDS = ["kettle", "örtlich", "plum", "日記", "quartz", "ravel", "sable", "tundra"]


class Script:
    """Lines of one session, and its tables as they must come out."""

    def __init__(self, agent, seed):
        self.agent, self.rng, self.lines, self.clock = agent, random.Random(f"{agent}-{seed}"), [], datetime(2026, 3, seed + 1, 7, tzinfo=UTC)
        self.messages, self.calls, self.results, self.usage, self.events = [], [], {}, [], []
        self.falls, self.images, self.facts, self.stamps, self.ids = {}, {}, {}, [], 0
        for _ in range(14):
            self.rng.choice(self.steps())()

    def say(self, n=3):
        return " ".join(self.rng.choice(WORDS) for _ in range(n))

    def name(self, kind):
        self.ids += 1
        return f"{kind}-{self.ids}"

    def put(self, line, stamped=True):
        """One line; returns its instant, or None."""
        self.clock += timedelta(seconds=self.rng.randrange(1, 90), milliseconds=250)
        if stamped and isinstance(line, dict):
            line = {"timestamp": self.clock.isoformat(timespec="milliseconds").replace("+00:00", "Z"), **line}
            self.stamps.append(self.clock)
        self.lines.append(line if isinstance(line, str) else json.dumps(line, ensure_ascii=self.rng.random() < 0.5))
        return self.clock if stamped else None

    def message(self, role, content, ts, think="", weight=0, model=""):
        self.messages.append([role, content, think, weight, model, ts])
        return len(self.messages) - 1

    def fall(self, key, own, ordinal, ts, **fields):
        f = self.falls.setdefault(key, {"ordinal": None, "own_at": None, "any_at": None})
        if own and f["ordinal"] is None:
            f["ordinal"], f["own_at"] = ordinal, ts
        f["any_at"] = f["any_at"] or ts
        f.update({k: v for k, v in fields.items() if v not in ("", None)})

    def junk(self):
        self.put(self.rng.choice(["", "[1]", "null", '{"type":"user","message":', '{"type":"of-no-kind"}']), stamped=False)


class FormatA(Script):
    def steps(self):
        return [self.ask, self.ask, self.reply, self.reply, self.reply, self.aside, self.blank, self.junk, self.pause, self.refused, self.pasted, self.link, self.outcome_of_earlier]

    def user(self, content, **extra):
        return self.put({"type": "user", "cwd": (cwd := f"/srv/{self.rng.choice(WORDS)}"), **extra, "message": {"content": content}}), cwd

    def ask(self):
        text = self.say()
        ts, self.facts["cwd"] = self.user(text if self.rng.random() < 0.5 else [{"type": "text", "text": text}])
        self.message("user", text, ts)

    def aside(self):
        text = self.say(2)
        ts, self.facts["cwd"] = self.user(text, **{self.rng.choice(["isMeta", "isCompactSummary"]): True})
        self.message("context", text, ts)

    def blank(self):
        _, self.facts["cwd"] = self.user(self.rng.choice([" \t", [], ""]))

    def link(self):
        n = self.rng.randrange(90)
        self.put({"type": "pr-link", "prNumber": n, "prUrl": f"http://x/{n}", "prRepository": "x"})
        self.facts |= {"pr_number": str(n), "pr_url": f"http://x/{n}"}

    def pasted(self):
        data = "R0lGOD" + self.rng.choice(["lhAA", "lhBB"])
        ts, self.facts["cwd"] = self.user([{"type": "image", "source": {"data": data}}])
        self.images.setdefault(data, self.message("user", "", ts))

    def pause(self):
        n = self.rng.randrange(500)
        self.put({"type": "system", "subtype": "turn_duration", "durationMs": n})
        self.events.append((len(self.messages) - 1 if self.messages else None, "turn_end", n))

    def refused(self):
        """A notice that comes without its turn, before it or after it."""
        key = self.rng.choice(["req-x", "req-y", self.name("req")])
        ts = self.put({"type": "system", "subtype": "model_refusal_fallback", "requestId": key, "originalModel": "elder", "fallbackModel": "younger", "trigger": "refusal", "apiRefusalCategory": "weather"})
        self.fall(key, False, None, ts, from_model="elder", to_model="younger", trigger="refusal", category="weather")

    def outcome_of_earlier(self):
        """Results of any call so far, of which only the first counts."""
        if self.calls:
            uid = self.rng.choice(self.calls)["uid"]
            self.result(uid, self.say(2), self.rng.random() < 0.5)

    def result(self, uid, body, bad):
        self.put({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": uid, "is_error": bad, "content": [{"type": "text", "text": body}]}]}})
        self.results.setdefault(uid, ("error" if bad else "ok", len(body.encode())))

    def reply(self):
        """A turn of some lines with one id; what comes in between leaves it open, unless it is a message."""
        mid, ordinal, parts = self.name("msg"), None, self.rng.randrange(1, 5)
        marks = self.rng.random() < 0.4
        request = self.rng.choice([None, "req-x", "req-y", self.name("req")])
        index = 0
        for k in range(parts):
            kind, blocks, texts, thinks, weight = self.rng.choice(["text", "think", "call", "call", "hidden"]), [], [], [], 0
            call = None
            if kind == "text":
                texts = [self.say()]
                blocks = [{"type": "text", "text": texts[0]}]
            elif kind == "think":
                thinks = [self.say(2)]
                blocks = [{"type": "thinking", "thinking": thinks[0], "signature": "sgn"}]
                weight = len(thinks[0].encode()) + 3
            elif kind == "hidden":
                blocks, weight = [{"type": "redacted_thinking", "data": "0123456"}], 7
            else:
                tool, category, held, path, detail = self.rng.choice([("Bash", "bash", {"command": "make"}, "", "make"), ("view", "read", {"file_path": "k.c"}, "k.c", ""), ("MultiEdit", "edit", {"file_path": "é.c", "query": "q"}, "é.c", "q"), ("Odd", "", {}, "", "")])
                call = {"uid": self.name("call"), "tool": tool, "category": category, "path": path, "detail": detail, "index": index}
                blocks = [{"type": "tool_use", "id": call["uid"], "name": tool, "input": held}]
                index += 1
            body = {"id": mid, "model": f"model-{self.rng.randrange(2)}", "content": blocks}
            marked = marks and self.rng.random() < 0.5
            if marked:
                body["content"] = [*blocks, {"type": "fallback", "from": {"model": "first"}, "to": {"model": "second"}}]
            iterated = self.rng.random() < 0.3
            n = [self.rng.randrange(1, 60) for _ in range(6)]
            if iterated:
                tries = [{"type": "message", "model": f"tried-{i}", "input_tokens": n[i], "output_tokens": n[i + 2]} for i in range(2)]
                served = [{"type": "fallback_message", "model": "served"}] if self.rng.random() < 0.6 else []
                body["usage"] = {"input_tokens": n[4], "output_tokens": n[5], "iterations": tries + served}
            ts = self.put({"type": "assistant", "message": body} | ({"requestId": request} if request else {}))
            if ordinal is None:
                ordinal = self.message("assistant", "", ts)
            m = self.messages[ordinal]
            m[1] = "\n".join([x for x in [m[1]] if x] + texts)
            m[2] = "\n".join([x for x in [m[2]] if x] + thinks)
            m[3], m[4] = m[3] + weight, body["model"]
            if call:
                self.calls.append(call | {"ordinal": ordinal})
            if iterated:
                self.usage.append((ordinal, n[4], n[5], mid))
            declined = {"declined_input": n[0] + n[1], "declined_output": n[2] + n[3]} if iterated and served else {}
            if marked or declined:
                old, new = ("first", "second") if marked else ("tried-1", "served")
                self.fall(request or mid, True, ordinal, ts, from_model=old, to_model=new, **declined)
            if call and self.rng.random() < 0.5:
                self.result(call["uid"], self.say(1), self.rng.random() < 0.3)
            if self.rng.random() < 0.2:
                self.junk()
            if k + 1 < parts and self.rng.random() < 0.15:
                self.aside()  # closes the turn: its later lines are a message of their own
                ordinal, index = None, 0


class FormatB(Script):
    def __init__(self, *a):
        self.model, self.open, self.dev, self.index = "", None, None, 0
        super().__init__(*a)
        for i, (role, *_) in enumerate(self.messages):  # framing: of the user messages that open the session, the last one counts
            later = self.messages[i + 1][0] if i + 1 < len(self.messages) else None
            if role != "user" or later != "user":
                break
            self.messages[i][0] = "context"

    def steps(self):
        return [self.ask, self.turn, self.turn, self.turn, self.counted, self.settings, self.letter, self.ended, self.junk]

    def item(self, **p):
        return self.put({"type": "response_item", "payload": p})

    def event(self, **p):
        return self.put({"type": "event_msg", "payload": p})

    def ask(self):
        text = self.say()
        self.message("user", text, self.item(role="user", content=[{"type": "input_text", "text": text}]))
        self.open = None

    def turn(self):
        kind = self.rng.choice(["think", "call", "text", "find"])
        if kind == "think":
            text = self.say(1)
            ts = self.item(type="reasoning", summary=[{"type": "summary_text", "text": text}], encrypted_content="abcd")
        elif kind == "call":
            uid = self.name("call")
            ts = self.item(type="function_call", name="exec_command", call_id=uid, arguments=json.dumps({"command": "pwd"}))
        elif kind == "find":
            uid = self.name("find")
            ts = self.event(type="web_search_end", call_id=uid, query="weather", results=[{"n": 1}])
        else:
            text = self.say(2)
            ts = self.item(role="assistant", content=[{"type": "output_text", "text": text}])
        if self.open is None:
            self.open, self.index = self.message("assistant", "", ts, model=self.model), 0
        m = self.messages[self.open]
        m[4] = self.model or m[4]
        if kind == "think":
            m[2], m[3] = "\n".join([x for x in [m[2]] if x] + [text]), m[3] + len(text.encode()) + 4
        elif kind == "text":
            m[1] = "\n".join([x for x in [m[1]] if x] + [text])
        else:
            tool, category, detail = ("exec_command", "bash", "pwd") if kind == "call" else ("web_search", "", "weather")
            self.calls.append({"uid": uid, "tool": tool, "category": category, "path": "", "detail": detail, "index": self.index, "ordinal": self.open})
            self.index += 1
            if kind == "find":
                self.results.setdefault(uid, ("ok", 9))
            elif self.rng.random() < 0.6:
                for body in (self.say(1), "later"):
                    self.item(type="function_call_output", call_id=uid, output=body)
                    self.results.setdefault(uid, ("ok", len(body.encode())))

    def counted(self):
        whole, cached, wrote, out = (self.rng.randrange(10, 99) for _ in range(4))
        self.event(type="token_count", info={"last_token_usage": {"input_tokens": whole, "cached_input_tokens": cached, "cache_write_input_tokens": wrote, "output_tokens": out}})
        self.usage.append((self.open, max(0, whole - cached - wrote), out, ""))

    def settings(self):
        self.model, self.dev, before = f"codec-{self.rng.randrange(3)}", self.rng.choice(["be brief", "be long"]), self.dev
        ts = self.put({"type": "turn_context", "payload": {"model": self.model, "collaboration_mode": {"settings": {"reasoning_effort": (e := self.rng.choice(["low", "high"])), "developer_instructions": self.dev}}}})
        self.facts["effort"] = e
        if self.dev != before:
            self.message("context", self.dev, ts)
            self.open = None

    def letter(self):
        text = self.say(1)
        self.message("context", text, self.item(type="agent_message", content=[{"type": "input_text", "text": text}]))  # leaves the turn open

    def ended(self):
        n = self.rng.randrange(500)
        self.event(type="turn_aborted", reason="halt", duration_ms=n)
        self.events.append((self.open if self.open is not None else len(self.messages) - 1 if self.messages else None, "turn_aborted", n))


class FormatC(Script):
    def steps(self):
        return [self.ask, self.reply, self.reply, self.outcome, self.level, self.junk, self.began]

    def ask(self):
        text = self.say()
        self.message("user", text, self.put({"type": "message", "id": self.name("u"), "message": {"role": "user", "content": [{"type": "text", "text": text}]}}))

    def reply(self):
        think, text, uid, mid, n = self.say(1), self.say(2), self.name("call"), self.name("a"), self.rng.randrange(50)
        blocks = [{"type": "thinking", "thinking": think}, {"type": "toolCall", "id": uid, "name": "grep", "arguments": {"pattern": "x+"}}, {"type": "text", "text": text}]
        ts = self.put({"type": "message", "id": mid, "message": {"role": "assistant", "model": "m-c", "content": blocks, "usage": {"input": n, "output": 2}}})
        at = self.message("assistant", text, ts, think, len(think.encode()), "m-c")
        self.calls.append({"uid": uid, "tool": "grep", "category": "search", "path": "", "detail": "x+", "index": 0, "ordinal": at})
        self.usage.append((at, n, 2, mid))

    def outcome(self):
        if self.calls:
            uid, body, bad = self.rng.choice(self.calls)["uid"], self.say(1), self.rng.random() < 0.5
            self.put({"type": "message", "id": self.name("r"), "message": {"role": "toolResult", "toolCallId": uid, "isError": bad, "content": [{"type": "text", "text": body}]}})
            self.results.setdefault(uid, ("error" if bad else "ok", len(body.encode())))

    def level(self):
        self.put({"type": "thinking_level_change", "thinkingLevel": "low"})
        self.events.append((len(self.messages) - 1 if self.messages else None, "thinking_level_change", None))

    def began(self):
        self.facts["cwd"] = f"/c/{self.say(1)}"
        self.put({"type": "session", "cwd": self.facts["cwd"]})


SCRIPTS = [f(agent, k) for agent, f in (("format_a", FormatA), ("format_b", FormatB), ("format_c", FormatC)) for k in range(SESSIONS)]


@pytest.fixture(scope="module")
def acts(spark):
    rows = []
    for sid, s in enumerate(SCRIPTS):
        at = 0
        for line in s.lines:
            rows.append((sid, s.agent, at, line))
            at += len(line.encode()) + 1
    rows += [(900, "of no kind", 0, SCRIPTS[0].lines[0])]
    out = reduce.parse(spark.createDataFrame(rows, "session_id long, agent string, byte_offset long, line string").repartition(5))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/acts"
    out.write.mode("overwrite").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def by_session(df, *cols):
    out = defaultdict(list)
    for r in df.select("session_id", *cols).collect():
        out[r["session_id"]].append(tuple(r)[1:])
    assert 900 not in out
    return [sorted(out[i], key=repr) for i in range(len(SCRIPTS))]


def want(rows_of):
    return [sorted(map(tuple, rows_of(s)), key=repr) for s in SCRIPTS]


def naive(ts):
    return ts.replace(tzinfo=None) if ts else None


def test_scripts_meet_the_hard_cases():
    a = [s for s in SCRIPTS if s.agent == "format_a"]
    assert any(len(s.falls) > 1 for s in a) and any(f["ordinal"] is None for s in a for f in s.falls.values()) and any("declined_input" in f for s in a for f in s.falls.values())
    assert any({"req-x", "req-y"} & set(s.falls) & set(t.falls) for s in a for t in a if s is not t)  # one key in two sessions
    assert any(u[0] is None for s in SCRIPTS for u in s.usage) and any(e[0] is None for s in SCRIPTS for e in s.events)


def test_messages(acts):
    m = reduce.messages(acts)
    assert by_session(m, "ordinal", "role", "content", "thinking_text", "thinking_bytes", "model", "ts") == want(lambda s: [(i, *x[:4], x[4] if x[0] == "assistant" else "", naive(x[5])) for i, x in enumerate(s.messages)])


def test_calls_take_their_first_result(acts):
    cols = ("message_ordinal", "call_index", "call_uid", "tool_name", "category", "file_path", "detail", "status", "result_bytes")
    assert by_session(reduce.patched_calls(acts), *cols) == want(lambda s: [(c["ordinal"], c["index"], c["uid"], c["tool"], c["category"], c["path"], c["detail"], *s.results.get(c["uid"], (None, None))) for c in s.calls])


def test_usage(acts):
    assert by_session(reduce.usage(acts), "message_ordinal", "input", "output", "dedup_key") == want(lambda s: s.usage)


def test_events(acts):
    got = by_session(reduce.events(acts), "seq", "message_ordinal", "kind", "attrs")
    plain = [sorted(((q, o, k, json.loads(a).get("duration_ms")) for q, o, k, a in e), key=repr) for e in got]
    assert plain == want(lambda s: [(i, *e) for i, e in enumerate(s.events)])


def test_attachments_once_a_session(acts):
    import base64

    got = by_session(reduce.attachments(acts), "message_ordinal", "sha256", "media_type")
    assert got == want(lambda s: [(at, hashlib.sha256(base64.b64decode(d + "=" * (-len(d) % 4))).hexdigest(), "image/gif") for d, at in s.images.items()])


def test_span_and_facts(acts):
    facts = {r["session_id"]: r for r in reduce.identity(acts).collect()}
    for i, s in enumerate(SCRIPTS):
        assert (facts[i]["started_at"], facts[i]["ended_at"]) == (naive(min(s.stamps)), naive(max(s.stamps)))
        assert {k: facts[i][k] for k in s.facts} == s.facts


def test_fallbacks(acts):
    named = ("from_model", "to_model", "trigger", "category", "declined_input", "declined_output")
    got = by_session(reduce.fallbacks(acts), "dedup_key", "message_ordinal", "occurred_at", *named)
    blank = {"from_model": "", "to_model": "", "trigger": ""}
    assert got == want(lambda s: [(k, f["ordinal"], naive(f["own_at"] or f["any_at"]), *[f.get(c, blank.get(c)) for c in named]) for k, f in s.falls.items()])
