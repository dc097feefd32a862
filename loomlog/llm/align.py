"""Alignment of two tokenizers: tokens that overlap form groups, found by pointer jumping; links are counted over the corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import read, written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text whose tokens a worker holds at a time, and text of a chunk of documents that asks for its counts at once.
BATCH_BYTES, CHUNK_BYTES = 1 << 19, 16 << 20
#: Pairs whose counts may be broadcast (17 bytes each); beyond that, chunks fetch theirs by a join.
SMALL_PAIRS = 4_000_000
#: Characters of parts that a worker keeps the alignment of.
MEMO_CHARS = 4_000_000

# How byte-level BPE splits a text before merging, its white space, and the bytes that it writes as themselves.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = [(33, 126), (161, 172), (174, 255)]
#: A part ends before a space that follows something else than white space, or with the text.
PART = re.compile(f"[{BLANKS}]*[^{BLANKS}]+(?:(?! )[{BLANKS}]+[^{BLANKS}]*)*|[{BLANKS}]+")


class Coder:
    """Both tokenizers, and the alignment of every part of a text that a worker has met.

    Byte-level BPE never joins what comes before white space with it, and the pieces of the other model hold spaces in
    front alone. So the tokens of both end where a part ends, neither they nor their groups depend on the parts around,
    and a text's alignment is that of its parts in a row. Parts are mostly words, so only new ones are encoded and
    aligned, many at a time. A model whose pieces do cross spaces gets whole texts as parts.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_bpe.decode()), SentencePieceProcessor(model_proto=piece_bpe)
        self.a.encode_special_tokens = True
        plain = [x for s, t in PLAIN for x in range(s, t + 1)]
        other = [x for x in range(256) if x not in set(plain)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in t) if set(t) <= byte_of.keys() else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lens_a, self.lens_b = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = [self.b.piece_to_id("▁")]
        self.split = (lambda t: [t]) if any(re.search("[^▁]▁", p) for p in pieces) else PART.findall
        self.code = "<u8" if len(self.a_bytes) * len(self.b_bytes) > 1 << 32 else "<u4"
        said = lambda n, end: np.array([*(f"{i}," for i in range(n)), *(f"{i}{end}" for i in range(n))], object)
        self.a_text, self.b_text = said(len(self.a_bytes), "|"), said(len(self.b_bytes), ";")
        self.forget()

    def forget(self) -> None:
        none = lambda: np.empty(0, np.int64)
        self.index, self.chars, self.text = Index(), 0, []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.links, self.whole = none(), none(), none(), none(), none(), np.empty(0, bool)
        self.words, self.word_ids, self.word_n = Index(), none(), none()  # pieces of parts, as byte-level BPE splits them

    def _a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte-level ids of parts in a row, and how many each has."""
        words = [SPLIT.findall(p) for p in parts]
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64)
        new, self.words.new = self.words.new, []
        ids = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        self.word_ids = np.append(self.word_ids, np.fromiter(chain.from_iterable(ids), np.int64))
        self.word_n = np.append(self.word_n, np.array([len(x) for x in ids], np.int64))
        n = np.concatenate([[0], np.cumsum(self.word_n[at])])[np.cumsum([len(w) for w in words])]
        return _spread(self.word_ids, self.word_n, at), np.diff(n, prepend=0)

    def _b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The other model's ids; it puts the first space of a part there by itself, and gives nothing for it alone."""
        ids = [self.blank if p == " " else x for p, x in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1), strict=True)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)

    def learn(self) -> None:
        """Align the parts that have been met for the first time, all at once: the end of a part is an end of both."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        self.chars += sum(map(len, new))
        (a, n_a), (b, n_b) = self._a(new), self._b(new)
        # parts that the tokens of either do not give back byte by byte have none
        data = [p.encode() for p in new]
        same = np.ones(len(new), bool)
        for tokens, n, held in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            octets, stop = list(map(held.__getitem__, tokens.tolist())), np.cumsum(n).tolist()
            same &= np.fromiter((b"".join(octets[s:t]) == d for s, t, d in zip([0, *stop], stop, data, strict=False)), bool, len(new))
        a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a * same, n_b * same
        ends_a, ends_b = np.cumsum(self.lens_a[a]), np.cumsum(self.lens_b[b])
        to = terminals(ends_a, ends_b)
        last = to[: len(a)] == np.arange(len(a))  # terminal tokens, one a group
        order = np.cumsum(last) - 1
        of_a, of_b = order[to[: len(a)]], order[to[len(a) :]]
        # groups as text: the A tokens of a group, then its B tokens
        size_a, size_b = np.bincount(of_a), np.bincount(of_b)
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[of_a]] = self.a_text[a + last * len(self.a_bytes)]
        last_b = np.append(of_b[1:] != of_b[:-1], True)[: len(b)]
        said[np.arange(len(b)) + np.cumsum(size_a)[of_b]] = self.b_text[b + last_b * len(self.b_bytes)]
        said, stop = said.tolist(), np.cumsum(n_a + n_b).tolist()
        self.text += ["".join(said[s:t])[:-1] for s, t in zip([0, *stop], stop, strict=False)]
        # a segment between neighbouring ends of either lies in one token of each: that is a link
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)[: len(cuts)]]
        links = a[np.searchsorted(ends_a, cuts)] * len(self.b_bytes) + b[np.searchsorted(ends_b, cuts)]
        upto = lambda x: np.concatenate([[0], x])[np.cumsum(n_a)]
        n_groups, n_links = np.diff(upto(order + 1), prepend=0), np.diff(np.searchsorted(cuts, upto(ends_a), "right"), prepend=0)
        self.whole, self.links = np.append(self.whole, same), np.append(self.links, links)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.append(x, y) for x, y in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)))

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns of align_groups for some texts."""
        if self.chars > MEMO_CHARS:
            self.forget()
        parts = [self.split(f" {t}") if t else [] for t in texts]
        stop = np.cumsum([len(p) for p in parts])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(stop[-1]) if len(stop) else 0)
        self.learn()
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[stop], prepend=0)
        lost = total(~self.whole) > 0
        sums = {c: np.where(lost, 0, total(getattr(self, c))).tolist() for c in ("n_a", "n_b", "n_groups", "n_links")}
        links, ends = _spread(self.links, self.n_links, at), np.cumsum(self.n_links[at])
        bounds = np.concatenate([[0], np.concatenate([[0], ends])[stop]]).tolist()
        at, stop, lost = at.tolist(), [0, *stop.tolist()], lost.tolist()
        groups, pairs, times = [], [], []
        for i in range(len(texts)):
            groups.append("" if lost[i] else ";".join(map(self.text.__getitem__, at[stop[i] : stop[i + 1]])))
            code, n = np.unique(links[bounds[i] : bounds[i] if lost[i] else bounds[i + 1]], return_counts=True)
            pairs.append(code.astype(self.code).tobytes())
            times.append(n.astype("<u4").tobytes())
        return sums | {"groups": groups, "pairs": pairs, "times": times}


def _spread(values: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs number at[0], at[1], ... of values, in a row; run i has n[i] values."""
    each = n[at]
    begin = (np.cumsum(n) - n)[at] - (np.cumsum(each) - each)
    return values[np.repeat(begin, each) + np.arange(int(each.sum()))]


class Index(dict):
    """Numbers of parts in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


@lru_cache(maxsize=1)
def _coder(byte_bpe: bytes, piece_bpe: bytes) -> Coder:
    return Coder(byte_bpe, piece_bpe)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every A token, then every B token: the A token that ends its group of overlapping tokens.

    Both lists of ends are ascending, and end at the same byte. Every token points to its farthest-right overlapping
    token, the one that holds its last byte, if that ends later; an A token whose end is an end of both is terminal,
    and the B token that ends there points to it. Doubling successors until nothing changes takes as many rounds as
    the logarithm of the longest group.
    """
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    to = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def align_groups(docs: DataFrame, folder: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, chunk, n_a, n_b, n_groups, n_links, groups, pairs, times): tokens of every whole text by both tokenizers, aligned.

    groups lists the ids of a group of tokens as `a1,a2|b1;a3|b2,b3`; pairs and times are packed: the distinct linked
    ids (A id times the number of B ids, plus B id, as u4 or u8) and how often a text links them. A row for each row of
    docs. Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros and
    an empty string. Neighbouring rows of a task share a chunk. The vocabulary files are read by the driver and travel
    as a broadcast; their size is that of the files. Columns other than doc_id and text are neither read nor returned.
    """
    files = []
    for name in (byte_bpe, piece_bpe):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast(files)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, read_ = _coder(*held.value), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum([len(x.as_py() or "") for x in texts])
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BATCH_BYTES)))
                some = coder.align([x.as_py() or "" for x in texts[start:end]])
                read_ += int(sizes[end - 1] - (sizes[start - 1] if start else 0))
                some |= {"doc_id": ids[start:end], "chunk": [task + read_ // CHUNK_BYTES] * (end - start)}
                yield pa.RecordBatch.from_arrays([pa.array(some[f.name], f.type) if isinstance(some[f.name], list) else some[f.name] for f in SCHEMA], schema=SCHEMA)
                start = end

    ddl = "doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(each, ddl)


def _unpack(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _counted(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(times)).astype(np.int64)


def chunk_pairs(aligned: DataFrame, most: int = 1 << 21) -> DataFrame:
    """(chunk, code, n): how often a chunk links a pair of ids, added up within a task; a pair comes again if a task or `most` ends its chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(chunk: int, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(code), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code[part]), chunk)), pa.array(code[part]), pa.array(n[part])], ["chunk", "code", "n"])

        now, codes, times, held = None, [], [], 0
        for batch in batches:
            for chunk, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if codes and (chunk != now or held > most):
                    code, total = _counted(codes, times)
                    if chunk != now or len(code) > most // 2:
                        yield from rows(now, code, total)
                        codes, times, held = [], [], 0
                    else:
                        codes, times, held = [code], [total], len(code)
                now = chunk
                if n:
                    codes.append(_unpack(pairs, len(n) // 4))
                    times.append(_unpack(n, len(n) // 4))
                    held += len(n) // 4
        if codes:
            yield from rows(now, *_counted(codes, times))

    return aligned.select("chunk", "pairs", "times").mapInArrow(each, "chunk long, code long, n long")


def pair_counts(asked: DataFrame, b_size: int) -> DataFrame:
    """(code, n, best): links of every pair of ids in the corpus, and whether no other A id has more with its B id."""
    total = asked.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.col("code") % b_size)
    # a B id has at most as many rows as there are A ids
    return total.select("code", "n", (F.col("n") == F.max("n").over(W.partitionBy("b"))).alias("best"))


def _scored(pdf: pd.DataFrame, code: np.ndarray, n: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    n_best, count_sum = [], []
    for pairs, times in zip(pdf["pairs"], pdf["times"], strict=True):
        t = _unpack(times, len(times) // 4)
        at = np.searchsorted(code, _unpack(pairs, len(t)))
        n_best.append(int(t[best[at]].sum()))
        count_sum.append(int((t * n[at]).sum()))
    return pdf.drop(columns=["pairs", "times"]).assign(n_best=n_best, count_sum=count_sum)


def align(docs: DataFrame, digest: bool = False, small_pairs: int = SMALL_PAIRS, **files: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum): the alignment of each text, and how usual its links are.

    count_sum adds up, over a text's links, how many links of the corpus join the same two ids; n_best counts the links
    to which no other A id has more with that B id. With `digest`, groups is replaced by the SHA-256 of its text, which
    the tables on the way then hold instead. See align_groups for texts without tokens; their sums are 0. Rows that
    repeat count each time. An empty table gives no rows. Counts of all pairs are broadcast if they are at most
    `small_pairs`; else each chunk of documents is joined with the counts of its own distinct pairs.
    """
    groups = F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("") if digest else F.col("groups")
    aligned = align_groups(docs, **files).withColumn("groups", groups)
    aligned = written(aligned, "aligned", compression="zstd")
    b_size = _piece_count(docs.sparkSession, **files)
    asked = chunk_pairs(aligned)
    if small_pairs:
        counts = written(pair_counts(asked, b_size), "pairs")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    ddl = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in own) + ", n_best long, count_sum long"
    if small_pairs and counts.count() <= small_pairs:
        table = counts.orderBy("code").toPandas()
        held = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("code", "n", "best")))

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield _scored(pdf, *held.value)

        return aligned.select(*own, "pairs", "times").mapInPandas(each, ddl)
    asked = written(asked, "asked")
    replies = asked.select("chunk", "code").distinct().join(pair_counts(asked, b_size), "code")

    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("code")
        return _scored(left.drop(columns="chunk"), *(right[c].to_numpy() for c in ("code", "n", "best")))

    return aligned.select("chunk", *own, "pairs", "times").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(fetch, ddl)


def _piece_count(spark: SparkSession, folder: str = TOKENIZERS, piece_bpe: str = PIECE_BPE, **_: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=os.path.join(folder, piece_bpe)).get_piece_size()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
