"""Mixture-controlled packing: deficit round-robin over source queues.

Every document is its token ids and an end id; the documents of a source form its queue, in the order of the tokenised
table. The queues are served in rounds of one window. In a round a queue earns a credit of window * share tokens and is
served as many whole tokens as its deficit (credit earned and not spent) allows; the fraction of a token that is left goes
on to the next queue, round the ring and into the next window, so that no queue is ever a whole token behind or ahead of its
target. Documents may be cut, so every window is full and only the last one can need padding.

With credits in exact integers the state of the ring after any number of rounds has a closed form: the queues up to s have
been served floor(window * rounds * tokens up to s / tokens of all) tokens. A task therefore finds the deficits at the window
where its documents start without running the rounds before it, which is how they carry across partitions: what tasks share is
one row for each source and partition, and the total of each source's queue.

With given target shares a queue can run dry before the others. The rounds then go on in phases: in each, the queues that are
left share the windows by their renormalised targets; each phase has the closed form above.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.shared import enter, slices, small_batches, text_or_empty, trim, written

WINDOW = 4096
END_ID = 2
MAX_WORDS = 250_000

_coders: dict[str, "WordCoder"] = {}


class WordCoder(dict):
    """Ids of the word-level BPE vocabulary, by a bounded cache of words (little-endian unsigned 16-bit ids of each).

    The tokenizer's pattern drops white space and matches within words, so a text's ids are those of its words on end. Words
    of printable characters below U+0250, which its normaliser only lower-cases, are cut by its pattern and coded by tiktoken:
    a piece is its bytes and MARK, which stands for the vocabulary's word end, so that ranks are ids. All other words, and
    those in which its special tokens could stand, go through the tokenizer itself.
    """

    MARK = "\0"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        byte = {c: b for b, c in byte_characters().items()}
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {self.MARK.encode(): max(vocab.values()) + 1}
        for token, i in vocab.items():
            if token not in special:
                ends = token.endswith(suffix)
                ranks[bytes(byte[c] for c in (token[: -len(suffix)] if ends else token)) + self.MARK.encode() * ends] = i
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch

    @classmethod
    def at(cls, path: str) -> "WordCoder":
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        if self.plain(word) and "<|" not in word:
            low = word.lower()
            ids = self.coder((low if low.isalpha() else self.MARK.join(self.pieces(low))) + self.MARK)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = self[word] = array("H", ids).tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


TOKENISED = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, queue, part, before, n_tokens, ids: each document's ids with end_id, and the tokens of its queue before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing", _coders.clear)
        coder, end = WordCoder.at(tokenizer), np.array([end_id], "<u2").tobytes()
        part, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, "text"):
                ids = [x + end for x in coder.ids(some.column("text").to_pylist())]
                counts = [len(x) // 2 for x in ids]
                queues, before = some.column("queue").to_pylist(), []
                for q, n in zip(queues, counts):
                    before.append(served.get(q, 0))
                    served[q] = before[-1] + n
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("queue"), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=TOKENISED)
        trim()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"), text_or_empty("source").alias("queue"))
    return written(rows.mapInArrow(run, "doc_id bigint, queue string, part bigint, before bigint, n_tokens bigint, ids binary"), "tokenised")


class Phase:
    """Rounds in which the same queues are served. first: tokens served before it; quota: tokens of each queue in it."""

    def __init__(self, window: int, first: int, quota: list[int], done: list[int]):
        self.window, self.first, self.quota, self.done, self.total = window, first, quota, done, sum(quota)
        self.upto = [0, *itertools.accumulate(quota)]

    def served(self, s: int, rounds: int) -> int:
        """Tokens that the queues before s have been served after so many rounds."""
        return min(self.window * rounds, self.total) * self.upto[s] // self.total

    def pieces(self, s: int, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """Places in the output of the tokens [start, stop) that queue s is served in this phase: first place and length."""
        k = start * self.total // (self.quota[s] * self.window) if self.quota[s] else 0
        spent = lambda r: self.served(s + 1, r) - self.served(s, r)
        while k and spent(k) > start:
            k -= 1
        here, after = spent(k), spent(k + 1)
        while start < stop:
            while after <= start:
                k += 1
                here, after = after, spent(k + 1)
            place = self.first + self.window * k + self.served(s, k + 1) - self.served(s, k) + start - here
            n = min(stop, after) - start
            yield place, n
            start += n


def phases(window: int, totals: list[int], shares: list[Fraction]) -> list[Phase]:
    """The phases in which queues with these totals drain at these shares (0: only when all others are empty)."""
    left, out, first, done = list(totals), [], 0, [0] * len(totals)
    while any(left):
        live = [s for s, n in enumerate(left) if n and shares[s] > 0] or [s for s, n in enumerate(left) if n]
        share = {s: shares[s] if shares[s] > 0 else Fraction(left[s]) for s in live}
        t = min(left[s] / share[s] for s in live)
        quota = [0] * len(left)
        for s in live:
            quota[s] = min(left[s], int(share[s] * t))
        out.append(Phase(window, first, quota, list(done)))
        first += sum(quota)
        left = [n - q for n, q in zip(left, quota)]
        done = [n + q for n, q in zip(done, quota)]
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shares: dict[str, float] | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Packs all documents into windows; a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids.

    shares: target token proportions by source; without them, each source's share of all tokens, so that all queues drain
    together. Sources not named there come last. Null text is empty (its only token is end_id), null source is the source "",
    repeated rows are packed as often as they occur, and an empty table gives no rows. Other columns are not looked at.
    ids: little-endian unsigned 32-bit, null if not with_ids.
    """
    small_batches(docs.sparkSession)
    shares = {k: Fraction(v) for k, v in (shares or {}).items()}
    rows = tokenised(docs, tokenizer, end_id)
    each = rows.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    names = {r["queue"]: int(r["n"]) for r in each.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    order = sorted(names)
    plan = phases(window, [names[q] for q in order], [shares.get(q, Fraction(0)) if shares else Fraction(names[q]) for q in order])
    place = {q: s for s, q in enumerate(order)}
    offsets = written(each.withColumn("earlier", F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("queue", "part", F.coalesce("earlier", F.lit(0)).alias("earlier")), "offsets", each.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "ids"):
                cols: list[list] = [[] for _ in PIECES]
                for doc, q, first, n, raw in zip(*(some.column(c).to_pylist() for c in ("doc_id", "queue", "first", "n_tokens", "ids"))):
                    ids, s, at = np.frombuffer(raw, "<u2").astype("<u4").tobytes(), place[q], 0
                    for p in plan:
                        a, b = max(first + at, p.done[s]), min(first + n, p.done[s] + p.quota[s])
                        if a >= b:
                            continue
                        for spot, length in p.pieces(s, a - p.done[s], b - p.done[s]):
                            while length:
                                room = min(length, window - spot % window)
                                piece = ids[4 * at : 4 * (at + room)]
                                for c, v in zip(cols, (doc, at, room, zlib.crc32(piece), n, spot // window, spot % window, q, piece if with_ids else None)):
                                    c.append(v)
                                at, spot, length = at + room, spot + room, length - room
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    placed = rows.join(offsets, ["queue", "part"]).select("doc_id", "queue", (F.col("earlier") + F.col("before")).alias("first"), "n_tokens", "ids")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string, ids binary")
