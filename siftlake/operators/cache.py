"""Reuse of stored fingerprints: lookup with a fallback key, merging, upserts and reviewed-distinct pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake import schema as S

HASH_COLUMNS = ("sha256", "partial_hash", "phash", "dhash", "tiles", "frames", "duration", "width", "height", "human_detection_status", "human_detection_signature", "human_max_confidence", "face_count", "face_detection_signature")


def unchanged(record: str = "r", cached: str = "c") -> Column:
    """Whether a cached row still describes the record: time of change (to the nanosecond, or to less than a millisecond), device and inode where both know them."""
    r, c = (lambda x: F.col(f"{record}.{x}")), (lambda x: F.col(f"{cached}.{x}"))
    time = F.when(r("mtime_ns").isNotNull() & c("mtime_ns").isNotNull(), r("mtime_ns") == c("mtime_ns")).otherwise(F.abs(r("mtime") - c("mtime")) < 0.001)
    same = lambda x: F.coalesce(r(x) == c(x), F.lit(True))
    return F.coalesce(time, F.lit(True)) & same("device") & same("inode")


def lookup(records: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """path, hit (the cached row as a struct) of the records that the cache still describes.

    A row is found by path and size; else by size, device, inode and medium (a renamed file; the least path of several). A row
    found by path that has changed is no hit and does not fall back.
    """
    now = cache.where(F.col("algorithm_version") == version)
    whole = F.struct(*[F.col(f"c.{x}").alias(x) for x in now.columns])
    r = records.alias("r")
    by_path = r.join(now.alias("c"), (F.col("r.path") == F.col("c.path")) & (F.col("r.size") == F.col("c.size")))
    direct = by_path.select(F.col("r.path").alias("path"), F.when(unchanged(), whole).alias("hit"))
    one = W.partitionBy("size", "device", "inode", "media_type").orderBy("path")
    moved = now.where("device IS NOT NULL AND inode IS NOT NULL").withColumn("__k", F.row_number().over(one)).where("__k = 1").drop("__k").alias("c")
    keys = [F.col(f"r.{x}") == F.col(f"c.{x}") for x in ("size", "device", "inode", "media_type")]
    rest = records.join(direct.select("path"), "path", "left_anti").alias("r")
    renamed = rest.join(moved, keys[0] & keys[1] & keys[2] & keys[3]).where(unchanged()).select(F.col("r.path").alias("path"), whole.alias("hit"))
    return direct.where("hit IS NOT NULL").union(renamed)


def hydrate(records: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """records with what the cache knows: a cached value that is not null (or empty) wins, the medium included; and from_cache."""
    found = lookup(records, cache, version)
    out = records.join(found, "path", "left")
    known = [c for c in (*HASH_COLUMNS, "media_type") if c in records.columns and c in cache.columns]
    kinds = dict(records.dtypes)
    value = lambda c: F.nullif(F.col(f"hit.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"hit.{c}")
    return out.withColumns({c: F.coalesce(value(c), F.col(c)) for c in known} | {"from_cache": F.col("hit").isNotNull()}).drop("hit")


def cacheable() -> Column:
    """A row worth storing: any hash, a size in pixels, or a decision with its signature."""
    any_hash = F.coalesce("sha256", "partial_hash", F.col("phash").cast("string"), F.col("dhash").cast("string")).isNotNull()
    person = F.col("human_detection_status").isin(S.PERSON, S.NO_PERSON, S.CONFIRMED) & F.col("human_detection_signature").isNotNull()
    faces = F.col("face_count").isNotNull() & F.col("face_detection_signature").isNotNull()
    return any_hash | F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)) | F.coalesce(person, F.lit(False)) | faces


def upsert(cache: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """cache with the rows of new in place of those with their keys."""
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def needs_codes() -> Column:
    return F.col("phash").isNull() | F.col("dhash").isNull()


def person_reusable(signature: str) -> Column:
    """A confirmed person always; else a decision of exactly this signature that is none of a failure."""
    status = F.col("human_detection_status")
    return F.coalesce((status == S.CONFIRMED) | ((F.col("human_detection_signature") == signature) & status.isin(S.PERSON, S.NO_PERSON)), F.lit(False))


def faces_reusable(signature: str) -> Column:
    """A face count of exactly this signature."""
    return F.coalesce(F.col("face_count").isNotNull() & (F.col("face_detection_signature") == signature), F.lit(False))


def identity() -> Column:
    return F.to_json(F.struct("size", "mtime_ns", "mtime", "device", "inode"), {"ignoreNullFields": "false"})


def all_pairs(group: DataFrame) -> DataFrame:
    """path_a < path_b, identity_a, identity_b of all pairs within each reviewer-chosen set (set_id, path): its size is a person's choice."""
    a, b = group.alias("a"), group.alias("b")
    return a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.path") < F.col("b.path"))).select(F.col("a.path").alias("path_a"), F.col("a.identity").alias("identity_a"), F.col("b.path").alias("path_b"), F.col("b.identity").alias("identity_b")).distinct()


def valid_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """path_a, path_b of the pairs whose files are both as they were."""
    now = records.select("path", identity().alias("identity"))
    side = lambda s: now.select(F.col("path").alias(f"path_{s}"), F.col("identity").alias(f"identity_{s}"))
    return pairs.join(side("a"), ["path_a", "identity_a"], "left_semi").join(side("b"), ["path_b", "identity_b"], "left_semi").select("path_a", "path_b")


