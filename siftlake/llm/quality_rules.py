"""Quality rules: counts over words and lines, and a linear-chain conditional random field that labels lines.

Viterbi decoding marks each line of a text as content or boilerplate; the text stays if it passes the count rules and content
holds enough of its characters. Quality labels mark whole documents, so training lines are labelled by their traits: a line of
a bad document is boilerplate if one of its traits stands in many bad training documents and hardly in good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.crf import Chain, fit
from siftlake.llm.shared import U64, bytes_of, mix, slices, small_batches, span_hashes, text_or_empty, words_of
from siftlake.llm.toxicity import distinct_rows, is_first, runs, surprise, training_rows

LEAST_WORDS, MOST_REPEATED = 50, 50
#: The least share of characters in content lines, and the labelled rows of each class that training reads at most.
CONTENT_SHARE, MOST_ROWS = 0.5, 2000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LOWER, DIGIT, PUNCT = (np.zeros(256, bool) for _ in range(4))
UPPER[ord("A") : ord("Z") + 1] = True
LOWER[ord("a") : ord("z") + 1] = True
DIGIT[ord("0") : ord("9") + 1] = True
PUNCT[list(b"!?.,;:'\"()-_/\\@=+~^`{}[]")] = True
#: Trait numbers are kind * LEVELS + level + 1; 0 is none.
LEVELS = 12
KINDS = ("size", "upper", "symbols", "digits", "marks", "word length", "echo", "end", "again", "bangs", "first letter", "place")
WIDTH = len(KINDS) * LEVELS + 1


def lines_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops (without the line feed) of the lines of each text, and the lines before each text; every text has one."""
    feeds = np.flatnonzero(raw == 10)
    owner = np.searchsorted(at, feeds, side="right") - 1
    counts = np.bincount(owner, minlength=len(at) - 1) + 1 if len(at) > 1 else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts, stops = np.zeros(before[-1], np.int64), np.zeros(before[-1], np.int64)
    inner = np.ones(before[-1], bool)
    inner[before[:-1]] = False
    starts[before[:-1]] = at[:-1]
    starts[inner] = feeds + 1
    stops[before[1:] - 1] = at[1:]
    ends = np.ones(before[-1], bool)
    ends[before[1:] - 1] = False
    stops[ends] = feeds
    return starts, stops, before


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key stands earlier, and whether it stands anywhere else."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    earlier, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return earlier, twice


class Counted:
    """Words, lines and counts of the texts of a slice."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at, n = raw, at, len(at) - 1
        self.word_a, self.word_z, self.words_before = words_of(raw, at)
        self.n_words = np.diff(self.words_before)
        point = (raw & 0xC0) != 0x80
        self.points = np.concatenate([[0], np.cumsum(point)])
        per_word = self.points[self.word_z] - self.points[self.word_a]
        owner = np.repeat(np.arange(n), self.n_words)
        self.word_chars = np.bincount(owner, per_word, n).astype(np.int64)
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])
        self.n_symbols = symbols[at[1:]] - symbols[at[:-1]]
        self.h = span_hashes(raw, self.word_a, self.word_z)
        salt = mix(np.arange(1, n + 1, dtype=U64))
        self.n_repeat_words = np.zeros(n, np.int64)
        if len(self.h) > 2:
            grams = mix(mix(mix(self.h[:-2]) + self.h[1:-1]) + self.h[2:])
            whole = owner[:-2] == owner[2:]
            place = np.flatnonzero(whole)
            _, twice = again(grams[place] ^ salt[owner[place]])
            hit = np.zeros(len(self.h), bool)
            for k in range(3):
                hit[place[twice] + k] = True
            self.n_repeat_words = np.bincount(owner, hit, n).astype(np.int64)
        self.line_a, self.line_z, self.lines_before = lines_of(raw, at)
        line_owner = np.repeat(np.arange(n), np.diff(self.lines_before))
        self.line_words = np.searchsorted(self.word_a, np.stack([self.line_a, self.line_z]))
        has_word = self.line_words[1] > self.line_words[0]
        keys = span_hashes(raw, self.line_a, self.line_z) ^ salt[line_owner] if n else np.zeros(0, U64)
        self.line_again, _ = again(keys)
        self.line_again &= has_word
        self.n_dup_lines = np.bincount(line_owner, self.line_again, n).astype(np.int64)
        self.n_lines = len(line_owner)
        self.base_failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

    def in_lines(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.line_z] - total[self.line_a]

    def traits(self) -> np.ndarray:
        """A row of trait numbers for each line; lines without a word have none."""
        raw, size = self.raw, self.in_lines(np.ones(len(self.raw), bool))
        words = self.line_words[1] - self.line_words[0]
        shift = np.concatenate([[0], raw[:-1]]) if len(raw) else raw
        latin = (shift == 0xC3) & (raw >= 0x80) & (raw <= 0x9E)
        upper, lower = self.in_lines(UPPER[raw] | latin), self.in_lines(LOWER[raw] | ((shift == 0xC3) & (raw > 0x9E)))
        level = lambda part, whole: np.minimum(np.ceil(part * 10 / np.maximum(whole, 1)), LEVELS - 1)
        echo = np.zeros(len(self.h) + 1, np.int64)
        if len(self.h) > 1:
            echo[2:] = np.cumsum(self.h[1:] == self.h[:-1])
        repeated = np.where(words > 1, echo[np.maximum(self.line_words[1], 1)] - echo[np.minimum(self.line_words[0] + 1, len(echo) - 1)], 0)
        final = raw[np.maximum(self.word_z[np.maximum(self.line_words[1] - 1, 0)] - 1, 0)] if len(self.word_z) else np.zeros(len(size), np.uint8)
        initial = raw[self.word_a[np.minimum(self.line_words[0], max(0, len(self.word_a) - 1))]] if len(self.word_a) else np.zeros(len(size), np.uint8)
        kind_of = lambda b: np.select([b == 46, b == 33, b == 124, SYMBOLS[b], UPPER[b], LOWER[b], DIGIT[b], PUNCT[b]], range(8), 8)
        place = np.arange(self.n_lines) - np.repeat(self.lines_before[:-1], np.diff(self.lines_before))
        columns = (
            np.minimum(np.log2(size + 1), LEVELS - 1), level(upper, upper + lower), level(self.in_lines(SYMBOLS[raw]), words), level(self.in_lines(DIGIT[raw]), size),
            level(self.in_lines(PUNCT[raw]), words), np.minimum(size / np.maximum(words, 1), LEVELS - 1), level(repeated, words), kind_of(final), self.line_again,
            level(self.in_lines(raw == 33), words), kind_of(initial), np.minimum(place, 3),
        )
        out = np.stack([np.asarray(c).astype(np.int64) + k * LEVELS + 1 for k, c in enumerate(columns)], axis=1)
        out[words == 0] = 0
        return out

    def summary(self) -> tuple[np.ndarray, np.ndarray]:
        """Traits of all lines, and the number of lines of each text."""
        return self.traits(), np.diff(self.lines_before)

    def line_chars(self) -> np.ndarray:
        return self.points[self.line_z] - self.points[self.line_a]


@dataclass
class Labeller:
    weight: np.ndarray
    chain: Chain

    def boilerplate(self, c: Counted) -> np.ndarray:
        """Whether each line is boilerplate, by the best path of its text."""
        if not c.n_lines:
            return np.zeros(0, bool)
        emit = self.weight[c.traits()].sum(axis=1) + self.weight[-1]
        return self.chain.viterbi(emit, is_first(c.lines_before, c.n_lines)).astype(bool)

    def content_share(self, c: Counted) -> np.ndarray:
        """Share of the characters of lines that stand in content lines; 1 for a text without any."""
        owner = np.repeat(np.arange(len(c.at) - 1), np.diff(c.lines_before))
        chars, n = c.line_chars(), len(c.at) - 1
        total = np.bincount(owner, chars, n)
        good = np.bincount(owner, np.where(self.boilerplate(c), 0, chars), n)
        return np.where(total > 0, good / np.maximum(total, 1), 1.0)


def train(texts: list[bytes], good: np.ndarray, epochs: int = 40) -> Labeller:
    """Fits the field to labelled texts; near copies count once. Without both classes every line is content."""
    rows = distinct_rows(texts)
    texts, bad = [texts[k] for k in rows], good[rows] == 0
    none = np.zeros(WIDTH + 1, np.float32)
    none[-1] = -1
    if not bad.any() or bad.all():
        return Labeller(none, Chain())
    counted = [Counted(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])])).summary() for some in runs(texts)]
    traits = np.concatenate([t for t, _ in counted])
    lines = np.concatenate([n for _, n in counted])
    before, owner = np.concatenate([[0], np.cumsum(lines)]), np.repeat(np.arange(len(texts)), lines)
    yes, no = np.zeros(WIDTH), np.zeros(WIDTH)
    for k in range(traits.shape[1]):
        pairs = np.unique(traits[:, k] * len(texts) + owner)
        np.add.at(yes, pairs[bad[pairs % len(texts)]] // len(texts), 1)
        np.add.at(no, pairs[~bad[pairs % len(texts)]] // len(texts), 1)
    strong = (yes >= 3) & ((yes + 0.1) / bad.sum() > 15 * (no + 0.1) / (~bad).sum()) & (surprise(yes, no, bad.mean()) > np.log(100 * WIDTH))
    strong[0] = False
    labels = strong[traits].any(axis=1) & bad[owner]
    if not labels.any():
        return Labeller(none, Chain())
    use = ((np.bincount(owner, labels, len(texts)) > 0) | ~bad)[owner]
    weight, chain = fit(traits[use], WIDTH, labels[use].astype(np.int8), is_first(before, len(owner))[use], epochs, rate=0.3, penalty=1e-4)
    return Labeller(weight, chain)


def train_on(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Labeller:
    """Trains on at most so many labelled rows of each class: see training_rows."""
    return train(*training_rows(docs, labels, "quality", {1: most, 0: most}))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, labeller: Labeller, content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, n_boilerplate_lines.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; null text is empty, has no words and fails the base rule. kept is false if
    the base rule fails, else whether content lines hold content_share of the lines' characters. Repeated rows get equal
    results, an empty table gives no rows, and other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                c = Counted(*bytes_of(pc.fill_null(some.column("text"), "")))
                share = shared.value.content_share(c)
                owner = np.repeat(np.arange(len(share)), np.diff(c.lines_before))
                dropped = np.bincount(owner, shared.value.boilerplate(c), len(share)).astype(np.int64)
                counts = [pa.array(getattr(c, name).astype(np.int64)) for name in COUNTS]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *counts, pa.array(c.base_failed), pa.array(~c.base_failed & (share >= content_share)), pa.array(share), pa.array(dropped)], names=["doc_id", *COUNTS, "base_failed", "kept", "content_share", "n_boilerplate_lines"])

    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in COUNTS) + ", base_failed boolean, kept boolean, content_share double, n_boilerplate_lines bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
