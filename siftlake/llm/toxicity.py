"""Toxic spans and scores by a linear-chain conditional random field over tokens.

Labels mark whole documents. A token of a toxic document counts as labelled toxic if one of its features (its form or a
prefix) stands in many toxic training documents and hardly in clean ones; near copies (Jaccard index of 0.8 or more) are counted
once. The field is trained on these tokens; the forward-backward marginals of a document's tokens give its spans and, combined
to the log of the expected number of toxic tokens and the strongest token, its score, which is calibrated on training documents
that fields trained without them have scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.crf import Chain, fit, rising
from siftlake.llm.shared import U64, bytes_of, enter, mix, slices, small_batches, span_hashes, text_or_empty, trim

#: Labelled rows of each class that training reads at most, chosen by the hash of doc_id, and their bytes in all; rows of more
#: than ROW_BYTES are not trained on.
MOST_TOXIC, MOST_CLEAN = 1200, 3000
MOST_BYTES, ROW_BYTES = 16 << 20, 1 << 18
TABLE_BITS = 18
#: Features: the token's form and its first 4, 5 and 6 bytes.
PREFIXES = (4, 5, 6)
#: The share of the features taken for evidence that may be so by chance.
CHANCE = 0.05
#: Parts of the training rows for calibration: few when there are many rows.
FOLDS, MANY_ROWS = (4, 2), 1500

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def lower_case(raw: np.ndarray) -> np.ndarray:
    """ASCII letters and the Latin-1 letters of two UTF-8 bytes in lower case, byte by byte."""
    out = LOWER[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[upper] += 32
    return out


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the runs of letters and digits (every byte from 128 on counts) in lower-cased texts, and the tokens before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = LETTER[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, at)


def features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Feature hashes of each token; 0 where it has no such feature."""
    out = np.zeros((len(starts), 1 + len(PREFIXES)), U64)
    out[:, 0] = span_hashes(raw, starts, stops)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lead, size = np.zeros(len(starts), U64), stops - starts
    for k in range(max(PREFIXES)):
        lead = (lead << U64(8)) | padded[starts + k].astype(U64)
        if k + 1 in PREFIXES:
            column = 1 + PREFIXES.index(k + 1)
            out[:, column] = np.where(size > k, mix(lead + (U64(k) << U64(56))) | U64(1), U64(0))
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == 0, 0, (hashes >> U64(64 - TABLE_BITS)) | U64(1)).astype(np.int32)


def is_first(ends: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[ends[:-1][ends[:-1] < size]] = True
    return out


@dataclass
class Tagger:
    weight: np.ndarray
    chain: Chain
    level: np.ndarray

    def token_odds(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, stops, tokens before each text, and each token's log-odds of being toxic."""
        low = lower_case(raw) if len(raw) else raw
        starts, stops, before = tokens(low, at)
        if not len(starts):
            return starts, stops, before, np.zeros(0, np.float32)
        emit = self.weight[slots(features(low, starts, stops))].sum(axis=1) + self.weight[-1]
        return starts, stops, before, self.chain.marginals(emit, is_first(before, len(starts)))

    def evidence(self, odds: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For each text the log of the expected toxic tokens and the strongest token's log-odds."""
        n = len(before) - 1
        owner = np.repeat(np.arange(n), np.diff(before))
        weight = np.logaddexp(0, np.minimum(odds, 12)).astype(np.float64)
        total = np.bincount(owner, np.where(odds > -4, weight, 0), n)
        top = np.full(n, -12.0)
        np.maximum.at(top, owner, np.maximum(odds, -12))
        return np.stack([np.log(total + 0.01), np.minimum(top, 12)], axis=1)

    def scores(self, odds: np.ndarray, before: np.ndarray) -> np.ndarray:
        if not len(self.level):
            return np.zeros(len(before) - 1)
        x = self.evidence(odds, before) @ self.level[:-1] + self.level[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def runs(texts: list[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    """Successive texts, about so many bytes at a time."""
    some: list[bytes] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def distinct_rows(texts: list[bytes], similarity: float = 0.8) -> list[int]:
    """Rows that are no near copies of a row kept before: of the kept rows that share one of 8 minima over 3-grams of tokens, with
    the same salt, none has a Jaccard index of its 3-grams of `similarity` or more."""
    seen: dict[tuple[int, int], list[int]] = {}
    sets: dict[int, np.ndarray] = {}
    salts = mix(np.arange(1, 9, dtype=U64))
    for k, text in enumerate(texts):
        raw = lower_case(np.frombuffer(text, np.uint8)) if text else np.zeros(0, np.uint8)
        starts, stops, _ = tokens(raw, np.array([0, len(raw)]))
        h = span_hashes(raw, starts, stops)
        grams = np.unique(mix(mix(h[:-2]) + h[1:-1]) + h[2:] if len(h) > 2 else h)
        marks = [(j, int(mix(grams ^ s).min())) for j, s in enumerate(salts)] if len(grams) else [(-1, 0)]
        others = {r for m in marks for r in seen.get(m, ()) if similarity * len(grams) <= len(sets[r]) and similarity * len(sets[r]) <= len(grams)}
        if any(alike(grams, sets[r], similarity) for r in others):
            continue
        sets[k] = grams
        for m in marks:
            seen.setdefault(m, []).append(k)
    return list(sets)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def surprise(yes: np.ndarray, no: np.ndarray, rate: float) -> np.ndarray:
    """An upper bound's -log of the probability that so many of a feature's documents are toxic by chance (Chernoff)."""
    n = np.maximum(yes + no, 1)
    share = yes / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    return np.where(share > rate, n * gap, 0)


def beyond_chance(surprises: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """The features whose evidence holds if a share `chance` of them may be wrong (Benjamini and Hochberg's rule): the more of them are
    sure, the less each one needs."""
    order = np.argsort(-surprises, kind="stable")
    need = np.log(len(surprises) / (chance * np.arange(1, len(surprises) + 1)))
    held = np.flatnonzero(surprises[order] > need)
    out = np.zeros(len(surprises), bool)
    out[order[: held[-1] + 1 if len(held) else 0]] = True
    return out


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = 12) -> Tagger:
    """Fits the field and the calibration to labelled texts. Without both classes the tagger scores everything 0."""
    rows = distinct_rows(texts)
    texts, toxic = [texts[k] for k in rows], toxic[rows].astype(bool)
    tagger = field_of(texts, toxic, epochs)
    if not len(tagger.level):
        return tagger
    folds, found = FOLDS[len(texts) >= MANY_ROWS], np.zeros((len(texts), 2))
    for f in range(folds):
        mine = np.arange(len(texts)) % folds == f
        other = field_of([t for t, m in zip(texts, mine) if not m], toxic[~mine], epochs)
        place = 0
        at = np.flatnonzero(mine)
        for some in runs([texts[k] for k in at]):
            raw = np.frombuffer(b"".join(some), np.uint8)
            _, _, before, odds = other.token_odds(raw, np.concatenate([[0], np.cumsum([len(t) for t in some])]))
            found[at[place : place + len(some)]] = other.evidence(odds, before)
            place += len(some)
    tagger.level = rising(found, toxic.astype(np.float64))
    return tagger


def field_of(texts: list[bytes], toxic: np.ndarray, epochs: int) -> Tagger:
    """A tagger whose field is fitted to these texts; its level is a stand-in, or empty if nothing was learnt."""
    empty = Tagger(np.zeros((1 << TABLE_BITS) + 1, np.float32), Chain(), np.zeros(0))
    if not toxic.any() or toxic.all():
        return empty

    def tokenised() -> Iterator[tuple[np.ndarray, ...]]:
        for some in runs(texts, 1 << 19):
            raw = lower_case(np.frombuffer(b"".join(some), np.uint8))
            yield raw, *tokens(raw, np.concatenate([[0], np.cumsum([len(t) for t in some])]))

    before = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, _, _, b in tokenised()]))])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(before))
    evidence = np.zeros(len(owner), bool)
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    columns = np.empty((len(owner), 1 + len(PREFIXES)), np.int32)
    for k in range(columns.shape[1]):  # one kind of feature at a time: the driver's memory holds no more
        hashes = np.empty(len(owner), U64)
        place = 0
        for raw, starts, stops, _ in tokenised():
            hashes[place : place + len(starts)] = features(raw, starts, stops)[:, k]
            place += len(starts)
        columns[:, k] = slots(hashes)
        kinds, ids = np.unique(hashes, return_inverse=True)
        del hashes
        ids = ids.astype(np.int32)
        pairs = ids.astype(np.int64)
        pairs *= len(texts)
        pairs += owner
        pairs.sort()
        new = np.ones(len(pairs), bool)
        np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
        pairs = pairs[new]
        bad = toxic[pairs % len(texts)]
        pairs //= len(texts)
        yes = np.bincount(pairs[bad], minlength=len(kinds))
        no = np.bincount(pairs[~bad], minlength=len(kinds))
        del pairs, bad, new
        strong = (yes >= 3) & ((yes + 0.1) / n_toxic > 20 * (no + 0.1) / n_clean) & (kinds != 0)
        strong &= beyond_chance(surprise(yes, no, n_toxic / (n_toxic + n_clean)))
        evidence |= strong[ids]
    labels = evidence & toxic[owner]
    has = np.bincount(owner, labels, len(texts)) > 0
    use = (has | ~toxic)[owner]
    if not labels.any():
        return empty
    first, columns, labels = is_first(before, len(owner))[use], columns[use], labels[use].astype(np.int8)
    del owner, ids, evidence, use
    weight, chain = fit(columns, 1 << TABLE_BITS, labels, first, epochs)
    return Tagger(weight, chain, np.array([1.0, 0.0, 0.0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], where: F.Column | None = None) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels for training: of each class at most so many rows, and MOST_BYTES in all classes together, by the hash of doc_id.

    Rows of more than ROW_BYTES are left out. A doc_id with several labels has the greatest. Only doc_id and text of docs are
    looked at.
    """
    told = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    told = (told.where(where) if where is not None else told).groupBy("id").agg(F.max("y").alias("y"))
    some = None
    for y, n in most.items():
        one = told.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        some = one if some is None else some.unionByName(one)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty("text").cast("binary").alias("t")).where(F.octet_length("t") <= ROW_BYTES)
    rows = rows.join(F.broadcast(some), "id").withColumn("h", F.xxhash64("id")).orderBy("h", "id", "t").limit(sum(most.values()))
    # over rows bounded by the limit before it
    upto = F.sum(F.octet_length("t")).over(W.orderBy("h", "id", "t").rowsBetween(W.unboundedPreceding, 0))
    got = rows.withColumn("upto", upto).where(F.col("upto") <= MOST_BYTES).select("t", "y").toArrow()
    return got.column("t").to_pylist(), got.column("y").to_numpy()


def train_on(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Tagger:
    """Trains on labelled rows outside the held-out fold: see training_rows."""
    return train(*training_rows(docs, labels, "toxic", {1: most_toxic, 0: most_clean}, ~held_out(F.col("id"))))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, tagger: Tagger, with_text: bool = False) -> DataFrame:
    """docs' columns (text only if with_text), with score (0 to 1), predicted (score >= 0.5) and spans: places in code points of toxic runs.

    Whole texts are scored; null text is empty and gets the score of no evidence. Columns of docs named like the results are
    replaced. Repeated rows get equal results; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted", "spans") and (with_text or c.lower() != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        tagger = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for some in slices(batch, "text", 1 << 21):
                raw, at = bytes_of(pc.fill_null(some.column("text"), ""))
                starts, stops, before, odds = tagger.token_odds(raw, at)
                score = tagger.scores(odds, before)
                hits = np.flatnonzero(odds > 0)
                spans: list[list] = [[] for _ in range(len(score))]
                if len(hits):
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    owner = np.searchsorted(before, hits, side="right") - 1
                    new = np.ones(len(hits), bool)
                    new[1:] = (hits[1:] != hits[:-1] + 1) | (owner[1:] != owner[:-1])
                    a = np.flatnonzero(new)
                    z = np.append(a[1:], len(hits)) - 1
                    base = points[at[owner[a]]]
                    for o, b, c in zip(owner[a].tolist(), (points[starts[hits[a]]] - base).tolist(), (points[stops[hits[z]]] - base).tolist()):
                        spans[o].append({"start": b, "stop": c})
                cols = [some.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)], names=[*names, "score", "predicted", "spans"])
        trim()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return docs.select(*names, *(["text"] if not with_text else [])).mapInArrow(run, schema + "score double, predicted int, spans array<struct<start: bigint, stop: bigint>>")
