"""Groups and their members in long form: building, keepers, identifiers, sizes and counts.

A members table has a row for each member of each group: group_id, kind, ord (place in the group's list), path, the record's
columns, is_keep, is_selected, is_reviewed, sel_ord (place among the selected).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.paths import depth
from siftlake.functions.report import signature_version
from siftlake.operators import places
from siftlake.operators.cluster import keep_rank
from siftlake.storage import settled


def of_group():
    return W.partitionBy("group_id")


def buckets(records: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """The records whose values of keys occur so often at least. Counts are combined before anything is shuffled."""
    often = records.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return records.join(often, list(keys), "left_semi")


def exact_members(records: DataFrame, root: str | None = None) -> DataFrame:
    """group_key, path and record columns of records with equal content: size, then the first bytes, then all bytes narrow them.

    What has an equal size is written once, so that records is read twice: for its sizes, and for the rest of those.

    Empty files and records without a hash are in no group; repeated paths count once. With root, groups stay within its values.
    """
    own = [root] if root else []
    near = settled(buckets(records.where("size > 0"), *own, "size"), "equal-sizes").dropDuplicates(["path"])
    near = buckets(near, *own, "size", "partial_hash").where("sha256 IS NOT NULL")
    return buckets(near, *own, "sha256").withColumn("group_key", F.concat_ws("|", *own, "sha256"))


def group_ids(members: DataFrame, kind: str) -> DataFrame:
    """group_key, group_id: 12 digits of the sha1 of the kind and the ascending paths, joined by bars."""
    paths = F.concat_ws("|", F.lit(kind), F.array_sort(F.collect_list("path")))
    return members.groupBy("group_key").agg(F.substring(F.sha1(paths), 1, 12).alias("group_id"))


def build_groups(members: DataFrame, kind: str, first: Column | None = None) -> DataFrame:
    """The members table of the groups of group_key: keeper, identifier, paths in order, all but the keeper selected.

    The keeper is the best by keep_rank; first breaks ties (ascending; path if not given).
    """
    own = W.partitionBy("group_key")
    tie = first if first is not None else F.col("path")
    best = F.row_number().over(own.orderBy(keep_rank().desc(), tie))
    members = settled(members, "members")
    out = members.withColumn("is_keep", best == 1).join(group_ids(members, kind), "group_key")
    out = out.withColumn("ord", F.row_number().over(own.orderBy("path")).cast("bigint"))
    return out.withColumns({"kind": F.lit(kind), "is_selected": ~F.col("is_keep"), "is_reviewed": F.lit(False), "sel_ord": F.col("ord")}).drop("group_key")


def independent_group(records: DataFrame, kind: str, wanted: Column, order: list[Column]) -> DataFrame:
    """The one group of a review kind: the records that are wanted, in order, none selected and no keeper.

    Its identifier is that of group_ids, from the sorted paths one after the other: one task reads them, and holds a batch.
    """
    chosen = settled(records.where(wanted).dropDuplicates(["path"]), "chosen")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha1(kind.encode(), usedforsecurity=False)
        for batch in batches:
            for p in batch.column("path").to_pylist():
                h.update(b"|" + p.encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()[:12]])], names=["group_id"])

    key = chosen.select("path").orderBy("path").coalesce(1).mapInArrow(digest, "group_id string")
    numbered = places.numbered(chosen, order)
    flags = {"kind": F.lit(kind), "is_keep": F.lit(False), "is_selected": F.lit(False), "is_reviewed": F.lit(False), "sel_ord": F.col("ord")}
    return numbered.crossJoin(F.broadcast(key)).withColumns(flags)


def trusted_no_person() -> Column:
    """A decision of the current detector version that no person is seen."""
    known = signature_version(F.col("human_detection_signature")) == S.HUMAN_VERSION
    return F.coalesce((F.col("human_detection_status") == S.NO_PERSON) & known, F.lit(False))


def low_resolution(bounds: dict[str, int]) -> Column:
    """Fewer pixels than the bound of the medium, but some."""
    count = S.pixels(F.col("width"), F.col("height"))
    hit = F.lit(False)
    for medium, bound in bounds.items():
        hit = hit | ((F.col("media_type") == medium) & (count > 0) & (count < max(1, bound)))
    return hit


def without_kept(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records without those that were decided to be kept and have not changed since (path, size, mtime_ns)."""
    kept = decisions.select("path", F.col("size").try_cast("bigint").alias("__s"), F.col("mtime_ns").try_cast("bigint").alias("__m"))
    stamp = S.mtime_stamp(F.col("mtime_ns"), F.col("mtime"))
    return records.withColumn("__stamp", stamp).join(kept, (records["path"] == kept["path"]) & (F.col("size") == F.col("__s")) & (F.col("__stamp") == F.col("__m")), "left_anti").drop("__stamp")


def random_review(records: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n records, drawn evenly without replacement: those with the least md5 of seed and path."""
    return records.dropDuplicates(["path"]).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path").limit(max(0, n))


def dominant_media_type(members: DataFrame) -> DataFrame:
    """group_id, media_type: the most frequent one of a duplicate group, of equals the one seen first."""
    counted = members.groupBy("group_id", "media_type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy("group_id").agg(F.max(F.struct("n", -F.col("first"), "media_type")).alias("m")).select("group_id", F.col("m.media_type").alias("media_type"))


def single_media_type(members: DataFrame) -> DataFrame:
    """group_id, media_type: the one of all members, or mixed."""
    one = F.when(F.count_distinct("media_type") == 1, F.min("media_type")).otherwise(S.MIXED)
    return members.groupBy("group_id").agg(one.alias("media_type"))


def reclaimable(members: DataFrame) -> DataFrame:
    """group_id, kind, member_count, reclaimable_bytes.

    Of a duplicate group all but the keeper (without one, all but the largest); of a review group what is selected and
    reviewed, and for no_humans still trusted.
    """
    trusted = (F.col("kind") != S.NO_HUMANS) | trusted_no_person()
    chosen = F.col("is_selected") & F.col("is_reviewed") & trusted
    summed = members.groupBy("group_id", "kind").agg(
        F.count("*").alias("member_count"), F.sum("size").alias("total"), F.max(F.when(F.col("is_keep"), F.col("size"))).alias("keep"), F.max("size").alias("top"),
        F.sum(F.when(chosen, F.col("size")).otherwise(0)).alias("chosen"),
    )
    one = F.greatest(F.lit(0), F.col("total") - F.coalesce("keep", "top"))
    return summed.select("group_id", "kind", "member_count", F.when(S.policy(F.col("kind")) == S.KEEP_ONE, one).otherwise(F.col("chosen")).alias("reclaimable_bytes"))


def smart_select(members: DataFrame, rule: str) -> DataFrame:
    """The members table after a rule chose keepers and selections anew.

    A duplicate group's keeper is the rule's best (the first by path of equals) and all others are selected; automatic takes
    the present keeper if there is one. A review group only follows select_candidates (what is reviewed is selected), which
    duplicate groups ignore; any other rule leaves its selection and takes its keeper away. deselect_all empties all.
    """
    if rule not in S.SMART_RULES:
        raise ValueError(f"unknown rule: {rule}")
    if rule == "deselect_all":
        return members.withColumn("is_selected", F.lit(False))
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    if rule == "select_candidates":
        return members.withColumns({"is_keep": F.col("is_keep") & ~alone, "is_selected": F.when(alone, F.col("is_reviewed")).otherwise(F.col("is_selected"))})
    count = S.pixels(F.col("width"), F.col("height"))
    orders = {
        "automatic": [F.col("is_keep").desc(), keep_rank().desc()],
        "newest": [F.col("mtime").desc()],
        "oldest": [F.col("mtime")],
        "largest": [count.desc(), F.col("size").desc()],
        "smallest": [F.when(count > 0, count).otherwise(F.col("size")), F.col("size")],
        "shortest_path": [depth(F.col("path")), F.length("path")],
    }
    best = F.row_number().over(of_group().orderBy(*orders[rule], "ord")) == 1
    return members.withColumn("__best", best).withColumns({"is_keep": F.col("__best") & ~alone, "is_selected": F.when(alone, F.col("is_selected")).otherwise(~F.col("__best"))}).drop("__best")


def summary(members: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: groups and files by kind, and the bytes of the effective selection (path, size)."""
    groups = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("group_id")))
    files = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    counts = members.agg(
        groups(S.EXACT).alias("exact_groups"), groups(S.SIMILAR).alias("similar_groups"), F.coalesce(files(S.NO_HUMANS), F.lit(0)).alias("no_human_files"),
        F.coalesce(files(S.LOW_RESOLUTION), F.lit(0)).alias("low_resolution_files"), F.coalesce(files(S.RANDOM_REVIEW), F.lit(0)).alias("random_review_files"),
    )
    freed = selected.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimable_bytes"), F.count("*").alias("selected_count"))
    return counts.crossJoin(freed)
