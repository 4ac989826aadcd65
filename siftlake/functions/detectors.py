"""Plug-ins that look at pictures: a registry, and three-valued decisions about them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.report import signature
from siftlake.operators.cache import faces_reusable, person_reusable


class Detector(Protocol):
    """Scores a path's frames; one is made in each task and closed at its end."""

    def score(self, path: str) -> float: ...

    def close(self) -> None: ...


_makers: dict[str, Callable[[], Detector]] = {}


def register(backend: str, make: Callable[[], Detector]) -> None:
    _makers[backend] = make


def maker(backend: str) -> Callable[[], Detector]:
    if backend not in _makers:
        raise ValueError(f"unknown backend: {backend}")
    return _makers[backend]


def ensemble(first: Callable[[], Detector], second: Callable[[], Detector]) -> Callable[[], Detector]:
    """The first one's score, or the second one's where that is 0."""

    class Both:
        def __init__(self) -> None:
            self.a, self.b = first(), second()

        def score(self, path: str) -> float:
            return self.a.score(path) or self.b.score(path)

        def close(self) -> None:
            self.a.close()
            self.b.close()

    return Both


def presence(records: DataFrame, make: Callable[[], Detector], backend: str, confidence: float = 0.25) -> DataFrame:
    """records with human_detection_status, _signature and human_max_confidence; a decision of the same signature is kept, a failure is no decision."""
    key = signature(S.HUMAN_VERSION, backend, confidence)
    reuse = person_reusable(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        try:
            for batch in batches:
                rows = []
                for path in batch["path"]:
                    try:
                        s = float(detector.score(path))
                        rows.append((path, S.PERSON if s >= confidence else S.NO_PERSON, s, None))
                    except Exception as e:  # fails closed: the row stays undecided
                        rows.append((path, S.FAILED, None, f"person detection: {e}"))
                yield pd.DataFrame(rows, columns=["path", "status", "score", "problem"])
        finally:
            detector.close()

    fresh = records.where(~reuse).select("path").mapInPandas(run, "path string, status string, score double, problem string")
    out = records.withColumn("__keep", reuse).join(fresh, "path", "left")
    new = lambda own, other: F.when(F.col("__keep"), F.col(own)).otherwise(other)
    return out.withColumns({
        "human_detection_status": new("human_detection_status", F.col("status")), "human_max_confidence": new("human_max_confidence", F.col("score")),
        "human_detection_signature": new("human_detection_signature", F.lit(key)), "error": F.coalesce("problem", "error"),
    }).drop("__keep", "status", "score", "problem")


def sample_order(n: int) -> list[int]:
    """The order in which n frames are looked at: middle, first, last, the rest."""
    head = [n // 2, 0, n - 1]
    return list(dict.fromkeys([k for k in head if 0 <= k < n] + list(range(n))))


def best_score(frames: Iterable[object], score: Callable[[object], float], enough: float) -> float:
    """The greatest score of the frames; frames after one with `enough` are not looked at, nor decoded if they come lazily."""
    best = 0.0
    for frame in frames:
        best = max(best, float(score(frame)))
        if best >= enough:
            break
    return best


def scales(height: int, width: int, sides: tuple[int, ...] = (960, 480)) -> list[tuple[int, int]]:
    """Sizes in which a picture is looked at: its longest side shrunk to each of sides; sizes that repeat are left out."""
    out = []
    for side in sides:
        by = min(1.0, side / max(height, width, 1))
        size = max(1, round(height * by)), max(1, round(width * by))
        if size not in out:
            out.append(size)
    return out


class FaceCounter(Protocol):
    """Counts the faces in each frame of a path, at each of its scales; one is made in each task."""

    def counts(self, path: str) -> Iterable[int]: ...

    def close(self) -> None: ...


def face_counts(records: DataFrame, make: Callable[[], FaceCounter], backend: str) -> DataFrame:
    """records with face_count (the most faces of any frame and scale) and face_detection_signature; a count of this signature is kept.

    A failure leaves no count and is told.
    """
    key = signature(S.FACE_VERSION, backend)
    keep = faces_reusable(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = make()
        try:
            for batch in batches:
                rows = []
                for path in batch["path"]:
                    try:
                        rows.append((path, max(map(int, counter.counts(path)), default=0), None))
                    except Exception as e:
                        rows.append((path, None, f"face detection: {e}"))
                yield pd.DataFrame(rows, columns=["path", "found", "problem"]).astype({"found": "Int64"})
        finally:
            counter.close()

    fresh = records.where(~keep).select("path").distinct().mapInPandas(run, "path string, found bigint, problem string")
    out = records.withColumn("__keep", keep).join(fresh, "path", "left")
    new = lambda own, other: F.when(F.col("__keep"), F.col(own)).otherwise(other)
    marked = F.when(F.col("found").isNotNull(), F.lit(key))
    return out.withColumns({"face_count": new("face_count", F.col("found").cast("int")), "face_detection_signature": new("face_detection_signature", marked), "error": F.coalesce("problem", "error")}).drop("__keep", "found", "problem")
