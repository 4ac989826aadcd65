"""What a selection amounts to: vetoes, keep-one safety, scopes, bulk operations and counts by kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.operators.components import components
from siftlake.operators.groups import of_group, trusted_no_person
from siftlake.operators.places import SHARDS
from siftlake.storage import settled


def vetoed(members: DataFrame) -> DataFrame:
    """Paths that a review group has reviewed and not selected: kept, whatever else suggests."""
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    return members.where(alone & F.col("is_reviewed") & ~F.col("is_selected")).select("path").distinct()


def effective_selection(members: DataFrame, protection: DataFrame | None = None) -> DataFrame:
    """path, size of what a selection removes, each path once: vetoes hold, and every duplicate group keeps a member.

    members must have group_ord, the groups' order. Vetoes come from protection (all groups) if given. A review group's path
    counts only if reviewed, a no_humans one only while its decision is trusted. A duplicate group all of whose members are
    selected releases its keeper (its first member without one). Where groups that are wholly selected overlap, they release
    in their order, for one release can save another; only such overlaps are walked one by one.
    """
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    trusted = (F.col("kind") != S.NO_HUMANS) | trusted_no_person()
    picked = members.where(F.col("is_selected") & (~alone | F.col("is_reviewed")) & trusted)
    picked = picked.join(vetoed(protection if protection is not None else members), "path", "left_anti")
    selected = picked.groupBy("path").agg(F.min(F.struct("group_ord", "sel_ord", "size")).alias("f")).select("path", F.col("f.size").alias("size"))
    dup = members.where(~alone).select("group_id", "group_ord", "ord", "path", "is_keep").dropDuplicates(["group_id", "path"])
    marked = dup.join(selected.select("path", F.lit(True).alias("hit")), "path", "left")
    full = marked.groupBy("group_id", "group_ord").agg(F.every(F.coalesce("hit", F.lit(False))).alias("all"), F.max(F.struct(F.col("is_keep"), -F.col("ord"), F.col("path"))).alias("k"))
    full = full.where("all").select("group_id", "group_ord", F.col("k.path").alias("keep"))
    touched = dup.join(full.select("group_id", "keep"), "group_id").select("group_id", "group_ord", "path", "keep")
    shared = touched.groupBy("path").agg(F.count("*").alias("n"), F.min("group_id").alias("low")).where("n > 1")
    links = touched.join(shared, "path").select(F.col("group_id").alias("a"), F.col("low").alias("b")).where("a != b")
    webs = components(links)
    simple = full.join(webs, full["group_id"] == webs["node"], "left_anti").select(F.col("keep").alias("path"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        left, out = set(group["path"]), []
        for _, g in group.sort_values(["group_ord", "group_id"]).groupby(["group_ord", "group_id"], sort=True):
            if set(g["path"]) <= left:
                keep = g["keep"].iloc[0]
                left.discard(keep)
                out.append(keep)
        return pd.DataFrame({"path": out})

    woven = touched.join(webs, touched["group_id"] == webs["node"]).select("root", "group_ord", "group_id", "path", "keep")
    released = simple.union(woven.groupBy("root").applyInPandas(walk, "path string"))
    return selected.join(released, "path", "left_anti")


def kind_counts(members: DataFrame) -> DataFrame:
    """kind, selected_count: effective paths of each kind on its own, among the overall ones, each counted for the first kind."""
    overall = effective_selection(members)
    found = None
    for k, kind in enumerate(S.KINDS):
        own = effective_selection(members.where(F.col("kind") == kind), members).join(overall, "path", "left_semi").select("path", F.lit(k).alias("rank"))
        found = own if found is None else found.union(own)
    first = found.groupBy("path").agg(F.min("rank").alias("rank"))
    names = F.array(*(F.lit(k) for k in S.KINDS))
    return first.groupBy("rank").agg(F.count("*").alias("selected_count")).select(F.element_at(names, F.col("rank") + 1).alias("kind"), "selected_count")


def matches(criteria: dict) -> Column:
    """Whether a member (with keeper_size) meets all criteria; an unknown face count never meets min_faces."""
    known = {"min_size", "max_size", "path_contains", "smaller_than_keeper", "min_faces"}
    if set(criteria) - known:
        raise ValueError(f"unknown criteria: {sorted(set(criteria) - known)}")
    hit = F.lit(True)
    if "min_size" in criteria:
        hit = hit & (F.col("size") >= criteria["min_size"])
    if "max_size" in criteria:
        hit = hit & (F.col("size") <= criteria["max_size"])
    if "path_contains" in criteria:
        hit = hit & F.lower("path").contains(criteria["path_contains"].lower())
    if criteria.get("smaller_than_keeper"):
        hit = hit & (F.col("size") < F.col("keeper_size"))
    if "min_faces" in criteria:
        hit = hit & (F.col("face_count") >= criteria["min_faces"])
    return F.coalesce(hit, F.lit(False))


def bulk_select(members: DataFrame, operation: str, criteria: dict | None = None, scope: str | tuple[str, ...] = "all") -> DataFrame:
    """The members table after an operation on the groups of a scope: select_all, select_none, invert or criteria.

    A duplicate group's keeper is never picked (without one, its first member); what is picked in a review group is reviewed.
    """
    first = F.row_number().over(of_group().orderBy(F.col("is_keep").desc(), "ord")) == 1
    out = members.withColumns({"__first": first, "keeper_size": F.max(F.when(F.col("is_keep"), F.col("size"))).over(of_group())})
    wanted = {"select_all": F.lit(True), "select_none": F.lit(False), "invert": ~F.col("is_selected"), "criteria": matches(criteria or {})}[operation]
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    picked = wanted & (alone | ~F.col("__first"))
    here = S.kind_scope(F.col("kind"), scope)
    out = out.withColumn("__picked", picked).withColumns({"is_selected": F.when(here, F.col("__picked")).otherwise(F.col("is_selected")), "is_reviewed": F.col("is_reviewed") | (here & alone & F.col("__picked"))})
    return out.drop("__first", "__picked", "keeper_size")


def apply_decisions(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """The members table after a reviewer's decisions (path, decision: delete, keep or clear, decided_at), the newest of a path.

    delete selects, keep unselects, clear takes both back; delete and keep mark review groups' members as reviewed. In a
    duplicate group that this would select wholly the keeper (or first member) stays unselected.
    """
    last = decisions.groupBy("path").agg(F.max(F.struct("decided_at", "decision")).alias("d")).select("path", F.col("d.decision").alias("decision"))
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    out = members.join(last, "path", "left")
    chosen = F.when(F.col("decision") == "delete", True).when(F.col("decision").isin("keep", "clear"), False).otherwise(F.col("is_selected"))
    seen = F.when(alone & F.col("decision").isin("delete", "keep"), True).when(alone & (F.col("decision") == "clear"), False).otherwise(F.col("is_reviewed"))
    out = out.withColumns({"is_selected": chosen, "is_reviewed": seen})
    full = F.every("is_selected").over(of_group())
    first = F.row_number().over(of_group().orderBy(F.col("is_keep").desc(), "ord")) == 1
    out = out.withColumns({"__full": full, "__first": first})
    return out.withColumn("is_selected", F.col("is_selected") & (alone | ~F.col("__full") | ~F.col("__first"))).drop("__full", "__first", "decision")


def routed(selected: DataFrame, members: DataFrame) -> DataFrame:
    """selected with route: review_quarantine for paths that a low_resolution or random_review group selects, else trash."""
    review = members.where(F.col("kind").isin(S.LOW_RESOLUTION, S.RANDOM_REVIEW) & F.col("is_selected")).select("path", F.lit("review_quarantine").alias("route")).distinct()
    return selected.join(review, "path", "left").withColumn("route", F.coalesce("route", F.lit("trash")))


def next_unreviewed(members: DataFrame) -> DataFrame:
    """group_id, ord, next_ord: the first member not reviewed after each one, going round; null if all are.

    A review group may hold most of the records: its rows are ranged into shards, a row of each shard and group says where
    the later ones go on, and frames grow from the end on, so that a row is looked at once.
    """
    rows = members.select("group_id", "ord", F.when(~F.col("is_reviewed"), F.col("ord")).alias("__open"))
    rows = settled(rows.repartitionByRange(SHARDS, "group_id", "ord").withColumn("__shard", F.spark_partition_id()), "in-order")
    after = lambda w: F.min("__open").over(w.rowsBetween(W.unboundedPreceding, -1))
    ends = rows.groupBy("group_id", "__shard").agg(F.min("__open").alias("__open"))
    ends = ends.select("group_id", "__shard", after(W.partitionBy("group_id").orderBy(F.col("__shard").desc())).alias("__later"), F.min("__open").over(of_group()).alias("__first"))
    own = rows.withColumn("__next", after(W.partitionBy("group_id", "__shard").orderBy(F.col("ord").desc())))
    return own.join(ends, ["group_id", "__shard"]).select("group_id", "ord", F.coalesce("__next", "__later", "__first").alias("next_ord"))


def bulk_in_view(members: DataFrame, view: DataFrame, operation: str, criteria: dict | None = None) -> DataFrame:
    """bulk_select on the groups that a view shows (group_id), the others as they are."""
    shown = view.select("group_id").distinct()
    return bulk_select(members.join(shown, "group_id", "left_semi"), operation, criteria).unionByName(members.join(shown, "group_id", "left_anti"))
