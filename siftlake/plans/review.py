"""State of a review beside the data: versions, one-use previews, progress and cancelling of jobs."""

from __future__ import annotations

import hashlib
import json
import secrets
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

PREVIEW_SECONDS = 600


class Stale(RuntimeError):
    """What is asked for was made for another state."""


def manifest(plan: DataFrame) -> str:
    """A digest of a plan's paths, actions and sizes, the same whatever their order."""
    from pyspark.sql import functions as F

    row = plan.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "action", "size")).alias("a"), F.sum(F.crc32(F.concat_ws("|", "path", "action", "size"))).alias("b")).head()
    return hashlib.sha256(json.dumps([row["n"], row["a"], row["b"]]).encode()).hexdigest()


@dataclass
class Previews:
    """Tokens that allow one execution of exactly the plan that was shown."""

    seconds: float = PREVIEW_SECONDS
    clock: Callable[[], float] = time.monotonic
    _open: dict[str, tuple[str, float]] = field(default_factory=dict)

    def issue(self, plan_digest: str) -> str:
        token = secrets.token_urlsafe(16)
        self._open = {t: x for t, x in self._open.items() if x[1] >= self.clock()}
        self._open[token] = (plan_digest, self.clock() + self.seconds)
        return token

    def redeem(self, token: str, plan_digest: str) -> str:
        """valid, missing, expired or changed; the token is used up in any case."""
        found = self._open.pop(token, None)
        if found is None:
            return "missing"
        if self.clock() > found[1]:
            return "expired"
        return "valid" if found[0] == plan_digest else "changed"


@dataclass
class Versioned:
    """A members table that changes only for those who have seen its latest version."""

    members: DataFrame
    version: int = 0

    def change(self, seen: int, how: Callable[[DataFrame], DataFrame]) -> int:
        if seen != self.version:
            raise Stale(f"version {seen} was changed; the present one is {self.version}")
        self.members, self.version = how(self.members), self.version + 1
        return self.version


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag; cancel(spark, tag) ends them from another thread."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)


@contextmanager
def progress(spark: SparkSession, tell: Callable[[int, int], None], every: float = 0.5):
    """Calls tell(tasks done, tasks known) while jobs run inside."""
    tracker, done = spark.sparkContext.statusTracker(), threading.Event()

    def watch() -> None:
        while not done.wait(every):
            infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s)) is not None]
            tell(sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
