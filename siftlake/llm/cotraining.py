"""Document quality by co-training.

Two classifiers see different views of a document: its text, and its metadata. Both start from the labelled rows. In each
round each view labels the unlabelled rows that it is surest of, in the proportion of the classes, and these become training
rows of the other view; a view that is sure of rows of one class only labels none, for it would teach that class alone. All unlabelled rows take part: their features are written once, a histogram of the log-odds gives each
round's thresholds, the sums of Newton's method are added up over the table, and a row's pseudo-labels follow from its features
and the steps so far, so none are stored. At the end each view's log-odds are calibrated on labelled rows that took no part in
training, the calibrated views are combined on others that took none, neither with a negative weight, and every document is
scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.crf import rising
from siftlake.llm.quality_rules import DIGIT, LOWER, PUNCT, SYMBOLS, UPPER, Counted
from siftlake.llm.shared import U64, bytes_of, mix, slices, small_batches, text_or_empty, written

#: Labelled rows of each class that training reads at most, chosen by the hash of doc_id; of unlabelled rows it reads all.
MOST_LABELLED = 3000
#: Bins of the log-odds, by which the surest rows are found; partial sums that the driver is sent at once.
BINS, MOST_SUMS = 1 << 14, 4
ROUNDS, SURE, SHARE = 5, 0.95, 0.1
WORD_SLOTS, META_SLOTS = 64, 48
KNOTS = (0.01, 0.05, 0.2, 0.5)


def text_view(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features of each text: rates over words and bytes, each with hinges at KNOTS, and shares of hashed words."""
    c, n = Counted(raw, at), len(at) - 1
    words, size = np.maximum(c.n_words, 1), np.maximum(np.diff(at), 1)

    def share(mask: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]) / by

    letters = np.maximum(share(UPPER[raw] | LOWER[raw], 1), 1)
    same = np.zeros(len(c.h), bool)
    same[1:] = c.h[1:] == c.h[:-1]
    owner = np.repeat(np.arange(n), c.n_words)
    rates = [
        share(UPPER[raw], letters), share(SYMBOLS[raw], words), share(DIGIT[raw], size), share(PUNCT[raw], words) / 4, share(raw == 33, words), share(raw == 124, words),
        c.n_dup_lines / np.maximum(np.diff(c.lines_before), 1), c.n_repeat_words / words, np.bincount(owner, same, n) / words, share(raw >= 128, size), c.word_chars / words / 20,
    ]
    columns = [np.log1p(c.n_words) / 10, np.log1p(np.diff(c.lines_before)) / 10]
    for r in rates:
        columns += [r, *(np.maximum(r - k, 0) for k in KNOTS)]
    slot = owner * WORD_SLOTS + (mix(c.h) >> U64(58)).astype(np.int64)
    counts = np.bincount(slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS) / words[:, None]
    return np.hstack([np.stack(columns, axis=1), counts]).astype(np.float32)


def meta_view(lang: np.ndarray, source: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """One-hot slots of the hashes of language and source, and hinges of the logarithm of the size."""
    half = META_SLOTS // 2
    slots = np.zeros((len(lang), META_SLOTS), np.float32)
    rows = np.arange(len(lang))
    slots[rows, lang % half] = 1
    slots[rows, half + source % half] = 1
    size = np.log1p(np.maximum(n_chars, 0)) / 10
    return np.hstack([slots, np.stack([size, *(np.maximum(size - k, 0) for k in (0.4, 0.6, 0.8, 1.0))], axis=1)]).astype(np.float32)


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Views:
    text: np.ndarray
    meta: np.ndarray
    joint: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score and each view's own, all probabilities of good quality."""
        a, b = odds(text, self.text), odds(meta, self.meta)
        sure = lambda z: 1 / (1 + np.exp(-z))
        return sure(odds(np.stack([a, b], axis=1), self.joint)), sure(a), sure(b)


#: A step of a round: the view that labels, its coefficients, and the last bin of bad and the first of good rows for the other view.
Step = tuple[int, np.ndarray, int, int]


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.minimum(((z + 30) * (BINS / 60)).astype(np.int64), BINS - 1)


def sure_rows(z: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-z))
    return p < 1 - sure, p > sure


def pseudo_labels(views: list[np.ndarray], steps: list[Step], sure: float) -> list[np.ndarray]:
    """What each view has been told of these unlabelled rows by the steps so far: 1, 0, or -1 for nothing."""
    known = [np.full(len(views[0]), -1), np.full(len(views[0]), -1)]
    for k, w, low, high in steps:
        z = odds(views[k], w)
        bins, (bad, good), other = bins_of(z), sure_rows(z, sure), known[1 - k]
        open_rows = other < 0
        other[open_rows & bad & (bins <= low)] = 0
        other[open_rows & good & (bins >= high)] = 1
    return known


def tally_of(views: list[np.ndarray], steps: list[Step], k: int, sure: float) -> np.ndarray:
    """Rows in each bin of view k's log-odds that it is sure of and that the other view has not been told."""
    open_rows = pseudo_labels(views, steps[:-1], sure)[1 - k] < 0
    z = odds(views[k], steps[-1][1])
    bad, good = sure_rows(z, sure)
    return np.bincount(bins_of(z)[open_rows & (bad | good)], minlength=BINS)


def moments_of(views: list[np.ndarray], steps: list[Step], k: int, w: np.ndarray, sure: float) -> np.ndarray:
    """Gradient, second derivatives and value, at w, of the log-likelihood of view k's pseudo-labelled rows, in one row."""
    y = pseudo_labels(views, steps, sure)[k]
    own = y >= 0
    return moments(views[k][own], y[own], w)


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [-np.logaddexp(0, np.where(y > 0, -z, z)).sum()]])


class Rows:
    """Unlabelled rows in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = [text, meta]

    def count(self) -> int:
        return len(self.views[0])

    def tally(self, *args) -> np.ndarray:
        return tally_of(self.views, *args)

    def moments(self, *args) -> np.ndarray:
        return moments_of(self.views, *args)


class StoredRows:
    """Unlabelled rows in a table (lang, source, n_chars, a: the text view); each question is one pass over all of them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def count(self) -> int:
        return self.rows.count()

    def tally(self, *args) -> np.ndarray:
        out = np.zeros(BINS, np.int64)
        for part in self.summed(tally_of, np.int64, args):
            out += part
        return out

    def moments(self, *args) -> np.ndarray:
        return sum(self.summed(moments_of, np.float64, args), 0.0)

    def summed(self, what: Callable, kind: type, args: tuple) -> list[np.ndarray]:
        """Sums of what over the parts of the table; the driver is sent MOST_SUMS of them at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    a = np.frombuffer(b"".join(batch.column("a").to_pylist()), np.float32).reshape(batch.num_rows, -1)
                    one = what([a, meta_view(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "source", "n_chars")))], *args)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column("v").to_pylist():
                    one = np.frombuffer(raw, kind)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        sums = self.rows.mapInArrow(run, "v binary").repartition(MOST_SUMS).mapInArrow(add, "v binary")
        return [np.frombuffer(bytes(r["v"]), kind) for r in sums.collect()]


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE) -> Views:
    """labels: 1 good, 0 bad, -1 unlabelled. One class only: every score is that class's."""
    told, free = labels >= 0, labels < 0
    return co_train_over(text[told], meta[told], labels[told], Rows(text[free], meta[free]), rounds, sure, share)


def co_train_over(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, free: "Rows | StoredRows", rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE) -> Views:
    """co_train with the labelled rows in memory and the unlabelled ones wherever they are."""
    if len(labels) == 0 or len(np.unique(labels)) < 2:
        level = 5.0 if len(labels) == 0 or labels[0] else -5.0
        zero = lambda x: np.append(np.zeros(x.shape[1]), level)
        return Views(zero(text), zero(meta), np.array([0.5, 0.5, 0.0]))
    views, steps = [text.astype(np.float64), meta.astype(np.float64)], []
    holds = np.zeros(len(labels), bool)
    holds[::4] = True  # for calibration
    good = labels.mean()
    weights = [np.zeros(v.shape[1] + 1) for v in views]

    def trained(k: int) -> np.ndarray:
        """Newton's method from the view's last coefficients, with halved steps where a whole one would lose; pseudo-labelled rows weigh 0.3."""
        w, d = weights[k], len(weights[k])

        def sums_at(w: np.ndarray) -> np.ndarray:
            sums = moments(views[k][~holds], labels[~holds], w)
            if any(step[0] == 1 - k for step in steps):
                sums = sums + 0.3 * free.moments(steps, k, w, sure)
            sums[-1] -= 0.05 * w @ w
            return sums

        sums = sums_at(w)
        for _ in range(20):
            step = np.linalg.solve(sums[d:-1].reshape(d, d) + 0.1 * np.eye(d), sums[:d] - 0.1 * w)
            if np.abs(step).max() < 1e-3:
                break
            after = sums_at(w + step)
            while after[-1] < sums[-1] and np.abs(step).max() >= 1e-3:
                step = step / 2
                after = sums_at(w + step)
            w, sums = w + step, after
        weights[k] = w
        return w

    n = free.count()
    pool = max(1, int(share * n))
    for _ in range(rounds if n else 0):
        for k in (0, 1):
            w = trained(k).copy()
            counts = free.tally([*steps, (k, w, 0, 0)], k, sure)
            low, high = np.cumsum(counts[: BINS // 2]), np.cumsum(counts[::-1][: BINS // 2])
            # the bin in which the number is reached goes as a whole
            if not (low[-1] and high[-1]):
                continue
            low_bin = int(np.searchsorted(low, max(1, int(pool * (1 - good)))))
            high_bin = BINS - 1 - int(np.searchsorted(high, max(1, int(pool * good))))
            steps.append((k, w, low_bin, high_bin))
    weights = [trained(0), trained(1)]
    stacked = np.stack([odds(views[0], weights[0]), odds(views[1], weights[1])], axis=1)
    kept = np.flatnonzero(holds)
    first, second = kept[::2], kept[1::2]
    for k in (0, 1):  # calibrate each view, then combine
        a, b = rising(stacked[first][:, k : k + 1], labels[first].astype(float))
        weights[k] = np.append(weights[k][:-1] * a, weights[k][-1] * a + b)
        stacked[:, k] = odds(views[k], weights[k])
    return Views(weights[0], weights[1], rising(stacked[second], labels[second].astype(float)))


def viewed(docs: DataFrame) -> DataFrame:
    """doc_id, text and what the metadata view reads: hashes of lang and source (empty where there is no such column), and n_chars
    (the text's own where null or not there)."""
    there = {c.lower() for c in docs.columns}
    own = F.length(text_or_empty("text")).cast("bigint")
    size = F.coalesce(F.col("n_chars").cast("bigint"), own) if "n_chars" in there else own
    hashed = [F.crc32((text_or_empty(c) if c in there else F.lit("")).cast("binary")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"), *hashed, size.alias("n_chars"))


def features_of(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = bytes_of(pc.fill_null(some.column("text"), ""))
    meta = [some.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "source", "n_chars")]
    return text_view(raw, at), meta_view(*meta)


def train_on(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Views:
    """Co-trains on at most so many labelled rows of each class and on all unlabelled rows; the former's features are collected, the latter's are written once."""
    small_batches(docs.sparkSession)
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda which: told.where(F.col("quality") == which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = pick(1).unionByName(pick(0)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
    base = viewed(docs)
    rows = base.join(F.broadcast(chosen), base["doc_id"] == chosen["__id"]).drop("__id")
    extra = ("lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                a, _ = features_of(part)
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x.tobytes() for x in a], pa.binary())], names=[*names, "a"])

    kinds = "doc_id bigint, lang bigint, source bigint, n_chars bigint"
    found = rows.mapInArrow(run, f"{kinds}, quality int, a binary").orderBy(F.xxhash64("doc_id"), "doc_id", "a").limit(2 * most_labelled).collect()
    if not found:
        return co_train(text_view(np.zeros(0, np.uint8), np.zeros(1, np.int64)), meta_view(*np.zeros((3, 0), np.int64)), np.zeros(0, np.int64))
    a = np.frombuffer(b"".join(bytes(r["a"]) for r in found), np.float32).reshape(len(found), -1)
    b = meta_view(*(np.array([r[c] for r in found], np.int64) for c in extra))
    # features, not texts, go through the join
    unknown = base.where("doc_id IS NOT NULL").mapInArrow(run, f"{kinds}, a binary").join(told.select("doc_id"), "doc_id", "left_anti").select(*extra, "a")
    return co_train_over(a, b, np.array([r["quality"] for r in found], np.int64), StoredRows(written(unknown, "views")))


def quality(docs: DataFrame, views: Views) -> DataFrame:
    """doc_id, score, kept (score >= 0.5), text_score, meta_score of every row, from its whole text and its metadata.

    Null text, language and source are empty; a null n_chars is the text's. Repeated rows get equal results and an empty table
    gives no rows. Columns that docs has besides are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                joint, a, b = shared.value.score(*features_of(some))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(joint), pa.array(joint >= 0.5), pa.array(a), pa.array(b)], names=["doc_id", "score", "kept", "text_score", "meta_score"])

    return viewed(docs).mapInArrow(run, "doc_id bigint, score double, kept boolean, text_score double, meta_score double")
