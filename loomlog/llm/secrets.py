"""Secret scanning: fixed patterns, and windows of high Shannon entropy within candidate strings."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import read

KINDS = ("assign", "access", "hex", "entropy")
#: The patterns as specified; letters of an assignment in either case, ASCII only.
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run is maximal, so runs of 24 or more are the long ones of all runs
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes of a candidate, most narrow first, and the bits a character that a window must reach.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 3.0),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("letters", re.compile(r"[A-Za-z+/_=-]+"), 4.0),  # words and paths repeat letters; 17 of 20 letters differ here
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8),
)
WINDOW = 20
#: Strings that look random but are no secrets: placeholders, alphabets, content digests written as such, data URIs.
ALLOW = (
    re.compile(r"(?i)example|sample|placeholder|dummy|xxxx|changeme"),
    re.compile(r"(?i)abcdefghij" + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz") + ")?" * 16 + "|0123456789|qwertyuiop"),
    re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
)
#: What stands before a candidate, up to marks and blanks, that is a published digest, not a secret.
ALLOW_BEFORE = ("sha1", "sha256", "sha384", "sha512", "md5")
#: Host and path of an address, which are no secret; what stands before '@' or in the query may be.
_URL = re.compile(r"""(?i)https?://(?:[^\s/?#"'<>,@]*@)?([^\s"'`<>(){}|,;@?=&#]*)""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def hot_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged ranges of s covered by windows whose entropy reaches `bits`.

    Entropy is log2(w) - sum(c * log2(c)) / w; a step changes two counts, so only their terms are updated. Counts are
    whole numbers up to w + 1, whose terms come from one table.
    """
    w = min(window, len(s))
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
    count: dict[str, int] = {}
    total, out, limit = 0.0, [], w * (math.log2(w) - bits) + 1e-9
    for i, ch in enumerate(s):
        c = count.get(ch, 0)
        total += term[c + 1] - term[c]
        count[ch] = c + 1
        if i >= w:
            old = s[i - w]
            c = count[old]
            total += term[c - 1] - term[c]
            count[old] = c - 1
        if i >= w - 1 and total <= limit:
            if out and i - w + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - w + 1, i + 1))
    return out


def _clear(s: str, at: int, urls: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of the candidate s, which starts at `at`, that no allow-list covers; a window that touches one is no secret."""
    near = urls[max(0, bisect_left(urls, (at, at)) - 1) : bisect_left(urls, (at + len(s), 0))]  # urls are in order and apart
    known = [m.span() for p in ALLOW for m in p.finditer(s)] + [(max(0, a - at), b - at) for a, b in near if b > at]
    last = 0
    for a, b in sorted(known):
        if a > last:
            yield last, a
        last = max(last, b)
    if last < len(s):
        yield last, len(s)


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """Spans the entropy method adds: windows of candidates that touch nothing on the allow-lists."""
    spans, urls = [], [m.span(1) for m in _URL.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        before = m.start()
        while before and text[before - 1] in "-:= ":
            before -= 1
        if text[max(0, before - 6) : before].lower().endswith(ALLOW_BEFORE):
            continue
        for s, e in _clear(m[0], m.start(), urls):
            if e - s < window:
                continue
            part = m[0][s:e]
            bits = next(b for _, p, b in CLASSES if p.fullmatch(part))
            spans += [(m.start() + s + a, m.start() + s + b, "entropy") for a, b in hot_windows(part, window, bits)]
    return spans


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, end exclusive, by start and then kind; null counts as empty."""
    text = text or ""
    return sorted(base_spans(text) + entropy_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [find_secrets(x) for x in pdf["text"]]
        out = pdf[["doc_id"]].copy()
        out["spans"] = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
        yield out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of kind, start, end): a row for each row of docs, in one pass without a shuffle.

    Documents without a finding have an empty array, and null texts count as empty. Texts are scanned whole, in time in
    proportion to their length; repeated rows are scanned one by one. Other columns are not read; an empty table gives
    no rows.
    """
    ids = docs.select(F.col("doc_id").cast("string"), "text")  # pandas would turn ids beside a null into floats
    return ids.mapInPandas(_scan, "doc_id string, spans array<struct<kind: string, start: int, end: int>>").withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """text with all found spans, merged where they overlap, replaced by the mask."""
    if text is None:
        return None
    merged: list[list[int]] = []
    for s, e, _ in find_secrets(text):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + mask + text[e:]
    return text


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, count = F.col("spans"), lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind"] != "entropy")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
