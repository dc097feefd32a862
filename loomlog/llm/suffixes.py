"""Suffix-array deduplication: maximal repeats of a corpus, and the removal of bytes that repeat earlier ones.

No suffix array of the whole corpus is built. Positions of least hash (minimizers of 32-byte strings) are anchors: each
100-byte string holds at least one, and equal strings hold equal anchors at equal places. So all occurrences of a
repeat meet in the hash partition of its anchor, with as many bytes around as its 100-byte strings can reach, and that
partition builds an enhanced suffix array over these contexts. Longer repeats are unions of such strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import by_bucket, counted, pack, parts, read, totals_of, written

MIN_BYTES, ANCHOR = 100, 32
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 3 << 20
#: Bytes of runs whose suffixes are sorted at once, and of text that is hashed at once.
BLOCK, PIECE = 400_000, 1 << 17
#: An anchor that occurs more often is split by the bytes around it, into so many parts.
HOT, PARTS = 20_000, 4
_DIVERSE = -1
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def _string_hashes(data: bytes, k: int) -> np.ndarray:
    """A hash of every k bytes: differences of a running sum of byte codes times powers, brought to one scale and mixed."""
    n = len(data)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=total[1:])
    return _mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def _pieces(texts: list[bytes], k: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts side by side in pieces of about PIECE bytes: (bytes, text number and offset of every start of k bytes; -1: none).

    A long text is cut so that each of its k-byte strings is in one piece.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - k + 1, PIECE):
            part = t[a : a + PIECE + k - 1]
            held.append((i, a, part))
            size += len(part)
            if size >= PIECE:
                yield _laid(held, k)
                held, size = [], 0
    if held:
        yield _laid(held, k)


def _laid(held: list[tuple[int, int, bytes]], k: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for _, _, x in held], np.int64)
    ends = np.cumsum(lens)
    at = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
    owner = np.repeat(np.array([i for i, _, _ in held], np.int64), lens)
    owner[at > np.repeat(lens, lens) - k] = -1
    return b"".join(x for _, _, x in held), owner[: len(owner) - k + 1], (at + np.repeat(np.array([a for _, a, _ in held], np.int64), lens))[: len(owner) - k + 1]


def anchors(texts: list[bytes], min_bytes: int = MIN_BYTES, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, start, stop, position, hash): the strings of min_bytes that start from `start` to `stop` - 1 have their anchor there.

    The anchor of a string is its k-byte string of least hash, the leftmost of equals, so it depends on the string alone
    and equal strings hold equal anchors at equal places. Every string is in one row.
    """
    out = []
    for data, owner, offset in _pieces(texts, min_bytes):
        h = _string_hashes(data, k)
        place = np.arange(len(h), dtype=np.uint64)
        at = (_least((h & ~_PLACE) | place, min_bytes - k + 1) & _PLACE).astype(np.int64)
        new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))
        own = owner[first] >= 0
        first, last = first[own], last[own]
        out.append((owner[first], offset[first], offset[first] + last - first, offset[first] + at[first] - first, h[at[first]]))
    if not out:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def maximal_repeats(texts: list[bytes], min_bytes: int = MIN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, text numbers, offsets) of every maximal repeat of at least min_bytes in short texts, with ALL of its occurrences."""
    for length, first, last, owner, offset in repeat_intervals(texts, min_bytes):
        for n, a, b in zip(length.tolist(), first.tolist(), last.tolist(), strict=True):
            yield n, owner[a : b + 1], offset[a : b + 1]


def repeat_intervals(texts: list[bytes], min_bytes: int = MIN_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (length, first, last) of common-prefix intervals and (text number, offset) of the suffixes they range over.

    An enhanced suffix array (order, common-prefix lengths, byte before) is scanned with a stack of common-prefix
    intervals. An interval is right-maximal by itself; it is output if the bytes before its suffixes differ, where
    the start of a text differs from everything. Suffixes whose first min_bytes bytes no other shares are in no repeat,
    so the array is built batch by batch over groups that share them, which bounds its memory by the largest group
    times the longest text.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    every_owner, every_offset, h = _start_hashes(texts, min_bytes)
    base, width = np.cumsum(lens) - lens, int(lens.max(initial=0))
    data = np.frombuffer(b"".join(texts) + bytes(width + 1), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, max(1, width))
    for starts in _shared(h):
        owner, offset = every_owner[starts], every_offset[starts]
        first, size = base[owner] + offset, lens[owner] - offset
        rows = windows[first]
        rows[np.arange(width) >= size[:, None]] = 0
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        rows, size = rows[order], size[order]
        differ = rows[1:] != rows[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
        owner, offset, first = owner[order], offset[order], first[order]
        before = np.where(offset > 0, data[first - 1].astype(np.int64), -2 - np.arange(len(first)))
        found = _intervals(np.where(lcp >= min_bytes, lcp, 0).tolist(), before.tolist())
        if found:
            yield *np.array(found, np.int64).T, owner, offset


def _start_hashes(texts: list[bytes], min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, hash) of every string of min_bytes bytes within a text."""
    out = []
    for data, owner, offset in _pieces(texts, min_bytes):
        own = np.flatnonzero(owner >= 0)
        out.append((owner[own], offset[own], _string_hashes(data, min_bytes)[own]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shared(h: np.ndarray, most: int = 20_000):
    """Numbers of the entries that have an equal one, in batches of about `most` that keep equal ones together."""
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.append(np.diff(h[order]) != 0, True)) + 1 if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(edge, prepend=0)
    many, ends = order[np.repeat(sizes > 1, sizes)], np.cumsum(sizes[sizes > 1])
    if len(ends):
        batch = (ends - 1) // most
        yield from np.split(many, ends[:-1][np.diff(batch) > 0])


def _intervals(lcp: list[int], before: list[int]) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of differing left neighbours, by one scan with a stack."""
    out, stack = [], []
    lcp.append(0)
    for i, (shared, left) in enumerate(zip(lcp, before, strict=True)):
        start = i
        while stack and stack[-1][0] > shared:
            length, start, was = stack.pop()
            left = left if was == left else _DIVERSE
            if left == _DIVERSE:
                out.append((length, start, i))
        if shared:
            if stack and stack[-1][0] == shared:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == left else _DIVERSE
            else:
                stack.append([shared, start, left])
    return out


def _collapsed(docs: DataFrame) -> DataFrame:
    """(id, sha, data): equal texts of a task once, so that a group of copies costs a row for each task; null id: least."""

    def once(batches):
        low: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                sha = sha256(data).digest()
                if sha not in low:
                    rows.append((i, sha, data))
                elif i < low[sha]:
                    rows.append((i, sha, None))
                else:
                    continue
                low[sha] = i
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "sha", "data"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("id", pa.int64()), ("sha", pa.binary()), ("data", pa.binary())]))

    return docs.select(_id(), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")).mapInArrow(once, "id long, sha binary, data binary")


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id")


def _texts(pdf: pd.DataFrame) -> list[tuple[int, bytes, bytes]]:
    """A chunk's distinct texts as (least id, sha, data), in the order of sha."""
    best: dict[bytes, list] = {}
    for i, sha, data in zip(pdf["id"], pdf["sha"], pdf["data"], strict=True):
        x = best.setdefault(sha, [i, data])
        x[0], x[1] = min(i, x[0]), data if x[1] is None else x[1]
    return [(best[sha][0], sha, best[sha][1]) for sha in sorted(best)]


_CONTEXTS = "bucket int, chunk long, anchors binary, lens binary, data binary, ids binary, shas binary, docs binary, at binary, cuts binary, times binary, members binary"
_CUTS = "chunk long, cuts binary"


def _slices(kept: np.ndarray, anchor: np.ndarray, lens: np.ndarray, size: int = 1 << 20):
    """Rows in the order of anchors, cut between anchors into slices of about `size` bytes; lone rows of an anchor are left out."""
    if not len(kept):
        return
    edge = np.flatnonzero(np.append(np.diff(anchor[kept]) != 0, True)) + 1
    sizes = np.diff(edge, prepend=0)
    many = kept[np.repeat(sizes > 1, sizes)]
    edge = np.cumsum(sizes[sizes > 1])
    if len(edge):
        at = (np.cumsum(lens[many])[edge - 1] - 1) // size
        yield from np.split(many, edge[:-1][np.diff(at) > 0])


def repeated_runs(texts: list[bytes], keys: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, length) of the runs of texts whose min_bytes strings all occur twice or more under their key.

    What is left out has no repeat to report, so the suffix array is built over the runs alone. Hashes decide, so an
    unlucky run may be too long, which the suffix array sorts out; none is missed.
    """
    owner, offset, h = _start_hashes(texts, min_bytes)
    h ^= _mixed(keys[owner])
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    fresh = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    begin = np.flatnonzero(twice & (fresh | ~np.append(False, twice[:-1])[: len(twice)]))
    end = np.flatnonzero(twice & (np.append(fresh[1:], True) | ~np.append(twice[1:], False))[: len(twice)])
    return owner[begin], offset[begin], offset[end] - offset[begin] + min_bytes


def _unpacked(pdf: pd.DataFrame) -> tuple[dict, list[bytes], np.ndarray, np.ndarray]:
    """One hash partition of contexts: columns, bytes, and of equal contexts of a key the earliest and the others.

    Equal contexts are one text of the suffix array, which counts as often as it was sent.
    """
    cols = {c: [np.frombuffer(x, t) for x in pdf[c]] for c, t in (("anchors", "<u8"), ("lens", "<i4"), ("ids", "<i8"), ("shas", ">u8"), ("docs", "<i4"), ("at", "<i4"))}
    a = {c: np.concatenate(v) for c, v in cols.items()}
    a["row"] = np.repeat(np.arange(len(pdf)), [len(x) for x in cols["anchors"]])
    ends = np.cumsum(a["lens"])
    blob = b"".join(pdf["data"])
    texts = [blob[e - n : e] for n, e in zip(a["lens"].tolist(), ends.tolist(), strict=True)]
    order = np.lexsort((a["at"], a["shas"], a["ids"], a["anchors"]))  # by anchor, then earliest first
    a["first"] = np.empty(len(texts), np.int64)
    seen, last = {}, None
    for i in order.tolist():
        if a["anchors"][i] != last:
            seen, last = {}, a["anchors"][i]
        a["first"][i] = seen.setdefault(texts[i], i)
    kept = order[a["first"][order] == order]
    return a, texts, kept, np.flatnonzero(a["first"] != np.arange(len(texts)))


def _scan(a: dict, texts: list[bytes], kept: np.ndarray, min_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (length, first, last) of the intervals over the contexts of each key, and (context, offset) of their suffixes."""
    for own in _slices(kept, a["anchors"], a["lens"]):
        who, off, size = repeated_runs([texts[i] for i in own.tolist()], a["anchors"][own], min_bytes)
        who = own[who]
        for block in _slices(np.arange(len(who)), a["anchors"][who], size, BLOCK):
            runs = [texts[w][s : s + n] for w, s, n in zip(who[block].tolist(), off[block].tolist(), size[block].tolist(), strict=True)]
            for length, lo, hi, t, x in repeat_intervals(runs, min_bytes):
                yield length, lo, hi, who[block][t], off[block][t] + x


def _cut_repeats(pdf: pd.DataFrame, min_bytes: int) -> pd.DataFrame:
    """One hash partition of contexts -> per chunk the ranges (text, start, end) that repeat an earlier string."""
    a, texts, kept, again = _unpacked(pdf)
    cut = [(again, a["at"][again], a["at"][again] + a["lens"][again])]
    for length, lo, hi, w, x in _scan(a, texts, kept, min_bytes):
        begin = a["at"][w] + x
        cut += _later(length, lo, hi, w, begin, _places(a["ids"][w], a["shas"][w], begin))
    which, begin, end = (np.concatenate(x) for x in zip(*cut, strict=True))
    chunk = pdf["chunk"].to_numpy()
    out = [(c, x) for c, x in zip(pdf["chunk"], pdf["cuts"], strict=True) if x]
    sent = chunk[a["row"][which]]
    for c in np.unique(sent):
        own = sent == c
        out.append((c, np.stack([a["docs"][which[own]], begin[own], end[own]], axis=1).astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "cuts"])


def _groups(pdf: pd.DataFrame, min_bytes: int) -> pd.DataFrame:
    """One hash partition of contexts -> (repeat, length, chunk, nth, shift): its maximal repeats, in each context that was sent."""
    a, texts, kept, _ = _unpacked(pdf)
    order = np.argsort(a["first"], kind="stable")
    edge = np.searchsorted(a["first"][order], np.arange(len(texts) + 1))
    times = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["times"]])
    nth = np.concatenate([np.arange(n) for n in np.bincount(a["row"], minlength=len(pdf))])
    chunk = pdf["chunk"].to_numpy()[a["row"]]
    out, whole = [], set()

    def tell(length: int, held: list[tuple[int, int]]) -> None:
        name = sha256(texts[held[0][0]][held[0][1] : held[0][1] + length]).digest()[:16]
        for w, x in held:
            for i in order[edge[w] : edge[w + 1]].tolist():
                out.append((name, length, int(chunk[i]), int(nth[i]), x))

    for length, lo, hi, w, x in _scan(a, texts, kept, min_bytes):
        for n, s, t in zip(length.tolist(), lo.tolist(), hi.tolist(), strict=True):
            held = list(zip(w[s : t + 1].tolist(), x[s : t + 1].tolist(), strict=True))
            whole.update(i for i, y in held if y == 0 and len(texts[i]) == n)
            tell(n, held)
    for i in kept.tolist():  # contexts that occur only as wholes
        if i not in whole and times[order[edge[i] : edge[i + 1]]].sum() > 1:
            tell(len(texts[i]), [(i, 0)])
    return pd.DataFrame(out, columns=["repeat", "length", "chunk", "nth", "shift"])


def _places(ids: np.ndarray, shas: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Numbers of places (id, sha, begin) in their order; equal places have equal numbers."""
    order = np.lexsort((begin, shas, ids))
    new = np.append(False, (ids[order][1:] != ids[order][:-1]) | (shas[order][1:] != shas[order][:-1]) | (begin[order][1:] != begin[order][:-1]))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def _later(length: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: np.ndarray, begin: np.ndarray, place: np.ndarray, most: int = 2_000_000):
    """Ranges of all occurrences but the first of every interval lo..hi of suffixes; runs overlap, so one occurrence may be in several."""
    sizes, out = hi - lo + 1, []
    edges = np.flatnonzero(np.diff(np.append(-1, (np.cumsum(sizes) - 1) // most)))
    for part in np.split(np.arange(len(sizes)), edges[1:]):
        n = sizes[part]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n - lo[part], n)
        least = np.minimum.reduceat(place[at], ends - n)
        later = place[at] != np.repeat(least, n)
        at, long = at[later], np.repeat(length[part], n)[later]
        out.append(_joined(which[at], begin[at], begin[at] + long))
    return out


def _joined(which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each `which` with those that touch or overlap made one."""
    if not len(which):
        return which, begin, end
    order = np.lexsort((begin, which))
    w, b = which[order], begin[order]
    span = int(end.max()) + 1
    top = np.maximum.accumulate(end[order] + w * span)
    at = np.flatnonzero(np.append(True, b[1:] + w[1:] * span > top[:-1]))
    return w[at], b[at], top[np.append(at[1:] - 1, len(w) - 1)] - w[at] * span


def merged(cuts: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, cuts.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _split(texts: list, doc, start, stop, place, key, hot, min_bytes: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first byte, end, key) of the contexts of anchors; those of hot anchors in PARTS parts with keys of their own.

    The strings of a part hold the anchor at neighbouring places, so all hold what they share around it, and that is
    the part's key: only contexts that agree in more than half of min_bytes bytes still meet.
    """
    cold, out = ~hot, [[], [], [], []]
    w = min_bytes - k + 1
    for d, s, t, p in zip(*(x[hot].tolist() for x in (doc, start, stop, place)), strict=True):
        for j in range(PARTS):
            a, b = w * j // PARTS, w * (j + 1) // PARTS - 1
            lo, hi = max(s, p - b), min(t, p - a + 1)
            if lo < hi:
                for column, x in zip(out, (d, lo, hi, xxhash.xxh64_intdigest(texts[d][2][p - a : p - b + min_bytes], j)), strict=True):
                    column.append(x)
    parts = [np.array(x, np.uint64 if i == 3 else np.int64) for i, x in enumerate(out)]
    whole = [doc[cold], start[cold], stop[cold], key[cold]]
    d, s, t, key = (np.concatenate(x) for x in zip(whole, parts, strict=True))
    return d, s, t + (min_bytes - 1), key


def _around(docs: DataFrame, min_bytes: int, k: int, members: bool) -> tuple[DataFrame, DataFrame]:
    """(distinct texts dealt to chunks, contexts of their repeated anchors packed by chunk and hash partition).

    A chunk sends a context once, with the ranges of its other occurrences in the chunk as cuts, or as members if asked for.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, anchor_parts, buckets = parts(n_bytes, CHUNK_BYTES), parts(n_bytes, 48 << 20), parts(n_bytes, BUCKET_BYTES)
    dealt = _collapsed(docs).withColumn("chunk", F.pmod(F.xxhash64("sha"), F.lit(chunks)))

    def request(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(anchors([data for _, _, data in _texts(pdf)], min_bytes, k)[4], return_counts=True)
        return pack(int(pdf["chunk"].iloc[0]), keys, counts, anchor_parts)

    def contexts(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[x.split()[0] for x in _CONTEXTS.split(", ")])
        texts, chunk = _texts(pdf), int(pdf["chunk"].iloc[0])
        owner, start, stop, place, every = anchors([data for _, _, data in texts], min_bytes, k)
        keys, at = np.unique(every, return_inverse=True)
        total = totals_of(keys, anchor_parts, replies)[at]
        many = total > 1
        doc, begin, end, key = _split(texts, *(x[many] for x in (owner, start, stop, place, every)), total[many] > HOT, min_bytes, k)
        order = np.array(sorted(range(len(texts)), key=lambda i: texts[i][:2]), np.int64)
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(texts))
        seen, first = {}, np.empty(len(doc), np.int64)
        order = np.lexsort((begin, rank[doc]))
        for i, d, s, e in zip(order.tolist(), doc[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
            first[i] = seen.setdefault((key[i], texts[d][2][s:e]), i)
        new, again = order[first[order] == order], order[first[order] != order]
        times = np.bincount(first, minlength=len(doc)).astype("<i4")
        ids, heads = np.array([t[0] for t in texts], "<i8"), [t[1][:8] for t in texts]
        by, edges = by_bucket(key[new], buckets)
        cuts, rows, nth = np.stack([doc[again], begin[again], end[again]], axis=1).astype("<i4").tobytes(), [], np.empty(len(doc), np.int64)
        for b, s, t in edges:
            x = new[by[s:t]]
            nth[x] = np.arange(len(x))
            data = b"".join(texts[d][2][p:q] for d, p, q in zip(doc[x].tolist(), begin[x].tolist(), end[x].tolist(), strict=True))
            sent = [key[x].astype("<u8"), (end - begin)[x].astype("<i4"), None, ids[doc[x]], None, doc[x].astype("<i4"), begin[x].astype("<i4")]
            sent = [y if y is None else y.tobytes() for y in sent]
            sent[2], sent[4] = data, b"".join(heads[d] for d in doc[x].tolist())
            held = None
            if members:
                every_one = np.flatnonzero(np.isin(first, x))
                held = np.stack([nth[first[every_one]], ids[doc[every_one]], begin[every_one]], axis=1).astype("<i8").tobytes()
            rows.append((b, chunk, *sent, None if members or rows else cuts, times[x].tobytes() if members else None, held))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _CONTEXTS.split(", ")])

    replies = counted(dealt, request)
    return dealt, dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(contexts, _CONTEXTS)


def maximal_repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, k: int = ANCHOR) -> DataFrame:
    """(repeat: 16 bytes that name its text, length, doc_id, start): repeats of the corpus, a row for each occurrence.

    They are the maximal repeats among the strings of at least min_bytes around one anchor. So every string of min_bytes
    that occurs twice lies in one repeat with exactly its occurrences or more of them, and a repeat that is longer than
    its anchor's reach comes as a chain of such pieces, which overlap by min_bytes - 1. Equal texts are one text, named
    by its least doc_id; nulls are as in dedup_suffixes. Occurrences are joined in by (chunk, context), so no task
    holds a whole group.
    """
    _, around = _around(docs, min_bytes, k, True)
    around = written(around, "contexts")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c, m in zip(pdf["bucket"], pdf["chunk"], pdf["members"], strict=True):
                nth, ids, at = np.frombuffer(m, "<i8").reshape(-1, 3).T
                yield pd.DataFrame({"bucket": b, "chunk": c, "nth": nth, "doc_id": ids, "at": at})

    held = around.select("bucket", "chunk", "members").mapInPandas(places, "bucket int, chunk long, nth long, doc_id long, at long")
    found = around.drop("members").groupBy("bucket").applyInPandas(lambda key, pdf: _groups(pdf, min_bytes).assign(bucket=key[0]), "repeat binary, length long, chunk long, nth long, shift long, bucket int")
    no_id = F.lit(-(1 << 63)).cast("long")
    return found.join(held, ["bucket", "chunk", "nth"]).select("repeat", "length", F.nullif("doc_id", no_id).alias("doc_id"), (F.col("at") + F.col("shift")).alias("start"))


def dedup_suffixes(docs: DataFrame, min_bytes: int = MIN_BYTES, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, cuts: array of start, end; kept: binary): every row of docs without its repeated bytes.

    A byte goes if a string of min_bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. Matches are of UTF-8 bytes, never cross documents and are judged on the input. Null texts count as
    empty; a null doc_id comes before all others. Rows that share doc_id and text are one document and keep the same
    bytes; rows that share only the doc_id come in the order of the text's SHA-256. Empty tables give no rows.

    Copies of a text are collapsed before anything is compared, and a chunk sends a context once however often it
    holds it, so a passage that a third of all documents hold comes to a row for each chunk. Texts of any length are
    taken whole. Other columns of docs are neither read nor returned.
    """
    dealt, around = _around(docs, min_bytes, k, False)

    def cleared(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(pdf)
        every = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 3) for x in cuts["cuts"]] or [np.zeros((0, 3), "<i4")])
        every = every[np.argsort(every[:, 0], kind="stable")]
        edge = np.searchsorted(every[:, 0], np.arange(len(texts) + 1))
        out = []
        for d, (i, sha, data) in enumerate(texts):
            gone = merged(every[edge[d] : edge[d + 1], 1:])
            ends = [0, *[x for s in gone for x in s], len(data)]
            out.append((i, sha, [{"start": s, "end": e} for s, e in gone], b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True))))
        return pd.DataFrame(out, columns=["first_id", "sha", "cuts", "kept"])

    cuts = around.groupBy("bucket").applyInPandas(lambda pdf: _cut_repeats(pdf, min_bytes), _CUTS)
    done = dealt.groupBy("chunk").cogroup(cuts.groupBy("chunk")).applyInPandas(cleared, "first_id long, sha binary, cuts array<struct<start: int, end: int>>, kept binary")
    rows = docs.select("doc_id", _id(), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("sha"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    copy = (F.col("id") != F.col("first_id")) & (F.col("n") >= min_bytes)
    return rows.join(done, "sha").select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.when(copy, whole).otherwise(F.col("cuts")).alias("cuts"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(read(spark, sf_dir, "documents"))
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("cuts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * MIN_BYTES})) AS h FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {MIN_BYTES - 1})) AS i FROM t)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER d + {MIN_BYTES} THEN 0 ELSE 1 END AS new FROM r WHERE k > 1 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
c AS (SELECT doc_id, span, min(i) AS s, max(i) + {MIN_BYTES} AS e FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM c),
q AS (SELECT t.doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM k JOIN t USING (doc_id) GROUP BY t.doc_id)
SELECT t.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN q ON t.doc_id = q.doc_id
"""
