"""Scans of arriving records, batch by batch, against a stored fingerprint table; and de-duplication of an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake.operators.cache import hydrate, lookup, upsert
from siftlake.storage import settled


def recompute_changed(records: DataFrame, cache: DataFrame, version: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """records with fingerprints and the new cache: compute only sees records that the cache of this version does not describe."""
    hits = lookup(records, cache, version).select("path")
    known = hydrate(records.join(hits, "path", "left_semi"), cache, version).drop("from_cache")
    fresh = settled(compute(records.join(hits, "path", "left_anti")), "computed")
    done = known.unionByName(fresh, allowMissingColumns=True)
    return done, upsert(cache, fresh.withColumn("algorithm_version", F.lit(version)))


def by_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs handle on each batch of the records that are there and ends; handle must bear being run twice with one batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_once(events: DataFrame, key: list[str], time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each key once within the lateness, of a stream or a table."""
    if events.isStreaming:
        return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
