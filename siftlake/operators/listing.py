"""What a reviewer's list shows: filters over groups and members, sorts, pages and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.paths import path_matches
from siftlake.functions.report import MIB
from siftlake.operators.groups import reclaimable
from siftlake.operators.places import ranged

SORTS = ("reclaimable", "members", "newest", "media")


def member_filter(min_mib: float | None = None, max_mib: float | None = None, min_width: int = 0, min_height: int = 0, path: str = "") -> Column:
    """Whether a member passes; unknown widths and heights count as 0."""
    hit = path_matches(F.col("path"), path) & (F.coalesce("width", F.lit(0)) >= min_width) & (F.coalesce("height", F.lit(0)) >= min_height)
    if min_mib is not None:
        hit = hit & (F.col("size") >= min_mib * MIB)
    if max_mib is not None:
        hit = hit & (F.col("size") <= max_mib * MIB)
    return hit


def group_states(members: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """group_id and what its rows sum up to: member_count, selected, reviewed, complete, needs_attention, newest, media_type, reclaimable_bytes, group_ord."""
    gone = deleted.select("path", F.lit(True).alias("gone")).distinct() if deleted is not None else None
    rows = members.join(gone, "path", "left") if gone is not None else members.withColumn("gone", F.lit(False))
    count = lambda hit: F.sum(F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))
    stats = rows.groupBy("group_id", "kind").agg(
        count(F.col("is_selected")).alias("selected"), count(F.col("is_reviewed")).alias("reviewed"), F.max("mtime").alias("newest"), F.min("group_ord").alias("group_ord"),
        F.when(F.count_distinct("media_type") == 1, F.min("media_type")).otherwise(S.MIXED).alias("media_type"), (count(F.col("error").isNotNull() | F.col("gone")) > 0).alias("issue"),
    )
    out = stats.join(reclaimable(members), ["group_id", "kind"])
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    out = out.withColumn("complete", F.when(alone, F.col("reviewed") >= F.col("member_count")).otherwise(F.col("selected") >= F.col("member_count") - 1))
    return out.withColumn("needs_attention", F.col("issue") | ~F.col("complete")).drop("issue")


def listed(states: DataFrame, members: DataFrame, member: Column | None = None, search: str = "", only: str = "all", hide_completed: bool = False, scope: str | tuple[str, ...] = "all") -> DataFrame:
    """The groups of a view: of a scope, with a member that passes and one that the search finds; only: all, selected, unselected or issues."""
    out = states.where(S.kind_scope(F.col("kind"), scope))
    if hide_completed:
        out = out.where("NOT complete")
    out = out.where({"all": F.lit(True), "selected": F.col("selected") > 0, "unselected": F.col("selected") == 0, "issues": F.col("needs_attention")}[only])
    for hit in ([member] if member is not None else []) + ([path_matches(F.col("path"), search)] if search else []):
        out = out.join(members.where(hit).select("group_id").distinct(), "group_id", "left_semi")
    return out


def order_of(sort: str) -> list[Column]:
    keys = {"reclaimable": F.col("reclaimable_bytes").desc(), "members": F.col("member_count").desc(), "newest": F.col("newest").desc(), "media": F.col("media_type")}
    return [keys[sort], F.col("group_ord"), F.col("group_id")]


def page(states: DataFrame, sort: str = "reclaimable", offset: int = 0, limit: int | None = 50) -> DataFrame:
    """One page of a view; no limit gives all from the offset on."""
    out = states.orderBy(*order_of(sort)).offset(offset)
    return out if limit is None else out.limit(limit)


def neighbours(states: DataFrame, sort: str = "reclaimable") -> DataFrame:
    """group_id, previous and next in the view, and the next that needs attention (going round).

    Each shard of the order finds its own; what lies beyond its ends is one row a shard.
    """
    rows = ranged(states, order_of(sort), "__pos")
    own, line = W.partitionBy("__shard").orderBy("__pos"), W.orderBy("__shard")
    todo = F.when(F.col("needs_attention"), F.col("group_id"))
    ends = rows.groupBy("__shard").agg(F.min_by("group_id", "__pos").alias("head"), F.max_by("group_id", "__pos").alias("tail"), F.min(F.when(F.col("needs_attention"), F.struct("__pos", "group_id"))).alias("t"))
    open_ = F.col("t.group_id")
    ends = ends.select(
        "__shard", F.lag("tail").over(line).alias("before"), F.lead("head").over(line).alias("after"),
        F.first(open_, ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("later"),
        F.first(open_, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("earliest"),
    )
    here = F.first(todo, ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    return rows.join(F.broadcast(ends), "__shard").select(
        "group_id", F.coalesce(F.lag("group_id").over(own), "before").alias("previous"), F.coalesce(F.lead("group_id").over(own), "after").alias("next"), F.coalesce(here, "later", "earliest").alias("next_attention")
    )


def tab_counts(states: DataFrame) -> DataFrame:
    """kind, groups, members: what the tabs show."""
    return states.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("member_count").alias("members"))


def one_group(members: DataFrame, group_id: str, deleted: DataFrame | None = None) -> DataFrame:
    """The members of one group in order, with deleted: whether a path has been deleted since. An unknown group has no rows."""
    mine = members.where(F.col("group_id") == group_id)
    if deleted is None:
        return mine.withColumn("deleted", F.lit(False)).orderBy("ord")
    gone = deleted.select("path", F.lit(True).alias("deleted")).distinct()
    return mine.join(gone, "path", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False))).orderBy("ord")
