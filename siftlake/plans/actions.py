"""Plans of what to do with a selection: identity checks, preflight, moves, folders to review in, and the way back.

Everything here is rows; nothing is touched. execute_moves at the end carries a checked plan out, on the machine it runs on.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.codes import hamming
from siftlake.functions.paths import in_roots, name
from siftlake.operators.groups import dominant_media_type, of_group
from siftlake.operators.ranking import folder_numbers, unique_names
from siftlake.storage import settled


def validated(records: DataFrame, now: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """path, error: the first reason against each record, compared with what an inventory sees now (null: none).

    now: path, size, mtime, mtime_ns, device, inode, is_symlink, is_regular.
    """
    c, r = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"r.{x}"))
    pair = records.alias("r").join(now.alias("n"), r("path") == c("path"), "left")
    drift = F.when(r("mtime_ns").isNotNull() & c("mtime_ns").isNotNull(), r("mtime_ns") != c("mtime_ns")).otherwise(F.abs(r("mtime") - c("mtime")) >= 0.001)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    error = (
        F.when(c("path").isNull(), text("[Errno 2] No such file or directory: '", r("path"), "'"))
        .when(c("is_symlink"), "refusing to act on a symbolic link")
        .when(~c("is_regular"), "file no longer exists")
        .when(~in_roots(r("path"), roots), "file is outside the scanned roots")
        .when(r("size") != c("size"), text("file changed since scan (size ", r("size"), " -> ", c("size"), ")"))
        .when(r("device") != c("device"), "file changed since scan (device differs)")
        .when(r("inode") != c("inode"), "file changed since scan (inode differs)")
        .when(drift, "file changed since scan (modified time differs)")
    )
    return pair.select(r("path").alias("path"), error.alias("error"))


def only_metadata_drifted(error: Column, same_size: Column) -> Column:
    hit = error.contains("modified time") | error.contains("inode") | error.contains("device")
    return F.coalesce(hit & same_size, F.lit(False))


def keeper_error(code_threshold: int = 6, frame_threshold: int = 8) -> Column:
    """What speaks against a keeper whose metadata alone has drifted, by what was stored of it (keep_*) and what is so now (now_*).

    The strongest evidence stored decides: equal bytes, else a near code, else every frame near, else the size (checked already).
    """
    frames = F.when(F.size("keep_frames") == F.size("now_frames"), F.forall(F.zip_with("keep_frames", "now_frames", hamming), lambda d: d <= frame_threshold))
    return (
        F.when(F.col("keep_sha256").isNotNull(), F.when(~F.coalesce(F.col("keep_sha256") == F.col("now_sha256"), F.lit(False)), "retained member content no longer matches its scan hash"))
        .when(F.col("keep_phash").isNotNull(), F.when(~F.coalesce(hamming(F.col("keep_phash"), F.col("now_phash")) <= code_threshold, F.lit(False)), "retained member perceptual hash no longer matches"))
        .when(F.col("keep_frames").isNotNull(), F.when(~F.coalesce(frames, F.lit(False)), "retained member video fingerprint no longer matches"))
    )


def preflight(members: DataFrame, selected: DataFrame, now: DataFrame, roots: tuple[str, ...] = (), destination_device: int | None = None) -> DataFrame:
    """path, error of selected paths that must not be acted on: stale, out of scope, across devices, their group's last, or no longer equal to a sound keeper.

    now as for validated, with sha256, phash and frames as they are now.
    """
    records = members.dropDuplicates(["path"])
    own = settled(validated(records, now, roots), "validated")
    seen = now.select("path", F.col("sha256").alias("now_sha256"), F.col("phash").alias("now_phash"), F.col("frames").alias("now_frames"), F.col("size").alias("now_size"), F.col("device").alias("now_device"))
    checked = selected.select("path").join(own.join(records.select("path", "sha256"), "path"), "path", "left").join(seen, "path", "left")
    error = F.when(F.col("sha256").isNull() & F.col("error").isNull() & F.col("now_size").isNull(), "selection is not present in the scan result").otherwise(F.col("error"))
    if destination_device is not None:
        error = F.coalesce(error, F.when(F.col("now_device") != destination_device, "destination is on another device"))
    first = checked.select("path", error.alias("error"))

    dup = members.where(S.policy(F.col("kind")) == S.KEEP_ONE)
    marked = dup.join(selected.select("path", F.lit(True).alias("hit")), "path", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    stored = ("path", "size", "sha256", "phash", "frames")
    keeper = marked.where("is_keep").select("group_id", *(F.col(c).alias(f"keep_{c}") for c in stored))
    keeper = keeper.join(own.select(F.col("path").alias("keep_path"), F.col("error").alias("keep_error")), "keep_path")
    keeper = keeper.join(seen.withColumnRenamed("path", "keep_path"), "keep_path", "left")
    drifted = only_metadata_drifted(F.col("keep_error"), F.col("keep_size") == F.col("now_size"))
    bad = F.when(F.col("keep_error").isNull() | drifted, keeper_error()).otherwise(F.concat(F.lit("retained member is stale: "), F.col("keep_error")))
    keeper = keeper.select("group_id", "keep_sha256", F.col("now_sha256").alias("keep_now"), bad.alias("keep_error"))
    whole = marked.withColumn("whole", F.every("hit").over(of_group())).where("hit").join(keeper, "group_id", "left").join(seen.select("path", "now_sha256"), "path", "left")
    exact = (F.col("kind") == S.EXACT) & ~F.coalesce((F.col("now_sha256") == F.col("sha256")) & (F.col("keep_now") == F.col("sha256")), F.lit(False))
    group_error = F.when(F.col("whole"), "every member of the group is selected").when(F.col("keep_error").isNotNull(), F.col("keep_error")).when(exact, "content is no longer equal to the retained member")
    second = whole.select("path", group_error.alias("error")).where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("group_error"))
    return first.join(second, "path", "left").select("path", F.coalesce("error", "group_error").alias("error")).where("error IS NOT NULL")


def action_plan(members: DataFrame, selected: DataFrame, errors: DataFrame, action: str, folder: str = "/quarantine", dry_run: bool = True) -> DataFrame:
    """path, group_id, size, action, ok, destination, error of every selected path; destinations do not collide."""
    if action not in ("trash", "quarantine", "delete"):
        raise ValueError(f"unknown action: {action}")
    home = members.groupBy("path").agg(F.min(F.struct("group_ord", "group_id")).alias("g"), F.first("size").alias("size"))
    rows = selected.select("path").join(home, "path", "left").join(errors, "path", "left").select("path", F.col("g.group_id").alias("group_id"), "size", F.lit(action).alias("action"), F.col("error").isNull().alias("ok"), "error")
    named = unique_names(rows.where("ok").select("path", F.lit(folder).alias("folder"), name(F.col("path")).alias("name")))
    to = F.concat_ws("/", "folder", "dest_name") if action == "quarantine" else F.lit(None).cast("string")
    return rows.join(named.select("path", to.alias("destination")), "path", "left").withColumn("dry_run", F.lit(dry_run))


def undo_plan(items: DataFrame, now: DataFrame, dry_run: bool = True) -> DataFrame:
    """step, source, destination, error: quarantined items back to where they were, the last first.

    items: item_ord, path, destination, ok, action; now: path. When it is to be executed, one fault holds back all steps.
    """
    moved = items.where("ok AND action = 'quarantine' AND destination IS NOT NULL")
    there = now.select("path").distinct()
    known = moved.join(there.select(F.col("path").alias("destination"), F.lit(True).alias("source_there")), "destination", "left").join(there.withColumn("target_there", F.lit(True)), "path", "left")
    own = F.when(F.col("source_there").isNull(), "quarantined file is missing").when(F.col("target_there"), "original location is occupied")
    out = known.select((-F.col("item_ord")).alias("step"), F.col("destination").alias("source"), F.col("path").alias("destination"), own.alias("error"))
    if dry_run:
        return out
    faults = out.agg(F.count("error").alias("faults"))
    return out.crossJoin(F.broadcast(faults)).withColumn("error", F.coalesce("error", F.when(F.col("faults") > 0, "held back: another item cannot be restored"))).drop("faults")


def isolate_plan(members: DataFrame, kinds: tuple[str, ...] = S.KINDS, mark_keep: bool = True, folder: str = "/review") -> DataFrame:
    """group_id, path, destination of every member of the groups worth a folder: two members, or a review group with one."""
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    sized = members.where(F.col("kind").isin(*kinds)).withColumn("n", F.count("*").over(of_group())).where(alone | (F.col("n") >= 2))
    first = F.min_by("path", F.struct(~F.col("is_keep"), "ord")).alias("keep")
    groups = sized.groupBy("group_id", "kind", "group_ord").agg(F.count("*").alias("member_count"), first).join(dominant_media_type(sized), "group_id")
    own = F.when(F.col("is_keep"), F.concat(F.lit("KEEP__"), name(F.col("path")))).otherwise(name(F.col("path"))) if mark_keep else name(F.col("path"))
    placed = sized.join(folder_numbers(groups).select("group_id", "folder"), "group_id").select("group_id", "path", F.concat(F.lit(folder + "/"), F.col("folder")).alias("folder"), own.alias("name"))
    return unique_names(placed).select("group_id", "path", F.concat_ws("/", "folder", "dest_name").alias("destination"))


def after_removal(members: DataFrame, removed: DataFrame) -> DataFrame:
    """members without removed paths: duplicate groups of one dissolve, a group that lost its keeper keeps its first member."""
    left = members.join(removed.select("path").distinct(), "path", "left_anti")
    alone = S.policy(F.col("kind")) == S.INDEPENDENT
    sized = left.withColumn("__n", F.count("*").over(of_group())).where(alone | (F.col("__n") >= 2))
    has = F.max(F.col("is_keep").cast("int")).over(of_group()) == 1
    first = F.min("ord").over(of_group()) == F.col("ord")
    keep = F.when(alone, F.lit(False)).when(has, F.col("is_keep")).otherwise(first)
    return sized.withColumn("is_keep", keep).withColumn("is_selected", F.col("is_selected") & (alone | ~F.col("is_keep"))).drop("__n")


def receipt(plan: DataFrame, session_id: str, started_at: str, dry_run: bool) -> DataFrame:
    """One row in the form of a receipt, with the plan's rows as items."""
    item = F.struct("path", "ok", "action", "destination", "error", "group_id", "size")
    done = plan.agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.when(F.col("ok"), 1)).cast("int").alias("success_count"), F.count(F.when(~F.col("ok"), 1)).cast("int").alias("fail_count"))
    return done.withColumns({"session_id": F.lit(session_id), "started_at": F.lit(started_at), "dry_run": F.lit(dry_run)})


def execute_moves(rows: list[tuple[str, str]]) -> list[tuple[str, str, str | None]]:
    """Moves files one after the other; (source, destination, error or None) of each. Nothing is overwritten, no device crossed."""
    out = []
    for source, destination in rows:
        try:
            os.makedirs(os.path.dirname(destination), exist_ok=True)
            if os.path.exists(destination):
                raise FileExistsError(destination)
            os.rename(source, destination)
            out.append((source, destination, None))
        except OSError as e:
            out.append((source, destination, str(e)))
    return out


def allowed(paths: DataFrame, records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """path, allowed: whether a path may be shown or revealed, as a scanned file or one of extra (folders of reviews and logs)."""
    known = records.select("path").distinct().withColumn("known", F.lit(True))
    more = F.col("path").isin(*extra) if extra else F.lit(False)
    return paths.select("path").distinct().join(known, "path", "left").select("path", (F.col("known").isNotNull() | more).alias("allowed"))


def delete_one(members: DataFrame, path: str) -> DataFrame:
    """The one-row plan to trash a candidate of a no_humans group; no row if no such group has the path."""
    mine = members.where((F.col("kind") == S.NO_HUMANS) & (F.col("path") == path)).limit(1)
    return mine.select("path", "group_id", "size", F.lit("trash").alias("action"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def undo_one(deleted: DataFrame, now: DataFrame, path: str) -> DataFrame:
    """source, destination, error of bringing a deleted candidate back. deleted: path, trashed (where it is now); now: path."""
    there = now.select("path").distinct()
    mine = deleted.where(F.col("path") == path).select("path", "trashed")
    known = mine.join(there.withColumn("occupied", F.lit(True)), "path", "left").join(there.select(F.col("path").alias("trashed"), F.lit(True).alias("kept")), "trashed", "left")
    error = F.when(F.col("trashed").isNull() | F.col("kept").isNull(), "trashed file is missing").when(F.col("occupied"), "original location is occupied")
    return known.select(F.col("trashed").alias("source"), F.col("path").alias("destination"), error.alias("error"))


MODES = ("copy", "hardlink", "symlink", "move")


def place(source: str, destination: str, mode: str = "copy") -> str | None:
    """Puts one file of an isolate plan into its folder; None or what went wrong. A link across devices becomes a copy, a move does not."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    try:
        if os.path.islink(source):
            return "refusing to act on a symbolic link"
        os.makedirs(os.path.dirname(destination), exist_ok=True)
        if os.path.lexists(destination):
            return "destination exists"
        if mode == "move":
            os.rename(source, destination)
        elif mode == "symlink":
            os.symlink(os.path.realpath(source), destination)
        else:
            try:
                os.link(source, destination) if mode == "hardlink" else shutil.copy2(source, destination)
            except OSError:
                if mode != "hardlink":
                    raise
                shutil.copy2(source, destination)
    except OSError as e:
        return str(e)
    return None


def group_notes(plan: DataFrame, members: DataFrame) -> DataFrame:
    """folder, note: the JSON that describes each folder of an isolate plan, its files in the order of their group."""
    own = members.select("group_id", "path", "kind", "ord", "is_keep", "size")
    one = F.struct("ord", F.col("path").alias("source"), "destination", "is_keep", "size")
    rows = plan.join(own, ["group_id", "path"]).withColumn("folder", F.regexp_replace("destination", "/[^/]*$", ""))
    listed = rows.groupBy("folder", "group_id", "kind").agg(F.sort_array(F.collect_list(one)).alias("members"))
    return listed.select("folder", F.to_json(F.struct(F.col("group_id").alias("id"), "kind", "members")).alias("note"))
