"""Rankings over stored things: budgets, receipts to prune, collision-free names, folder numbers."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.paths import name, safe_name, stem, suffix


def over_budget(files: DataFrame, budget: int, shards: int = 64) -> DataFrame:
    """files (path, size, mtime) to remove, oldest first, until the rest fits the budget.

    A running sum over everything would be one task's work. Files are ranged by age into shards; the sums of the shards are
    few, and each shard then sums its own files from where it starts.
    """
    order = [F.col("mtime"), F.col("size"), F.col("path")]
    spread = files.repartitionByRange(shards, *order).withColumn("__shard", F.spark_partition_id())
    sums = spread.groupBy("__shard").agg(F.sum("size").alias("s"))
    upto = sums.withColumn("__before", F.coalesce(F.sum("s").over(W.orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    total = sums.agg(F.sum("s").alias("__total"))
    own = F.coalesce(F.sum("size").over(W.partitionBy("__shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = spread.join(F.broadcast(upto), "__shard").crossJoin(F.broadcast(total))
    return out.withColumn("__gone", F.col("__before") + own).where(F.col("__total") - F.col("__gone") > budget).select(*files.columns)


def receipts_to_prune(receipts: DataFrame, now: Column, older_than_days: float | None = None, keep: int | None = None, drop_previews: bool = False) -> DataFrame:
    """id, reason of the receipts (id, started_at timestamp, dry_run) to drop: a preview, beyond the newest, or too old, in this order."""
    reason, ranked = F.lit(None).cast("string"), receipts
    if older_than_days is not None:
        reason = F.when(F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(older_than_days) * 86400)), f"older than {older_than_days:g} days")
    if keep is not None:
        newest = [F.coalesce(F.col("started_at").cast("string"), F.col("id")).desc(), F.col("id").desc()]
        top = receipts.orderBy(*newest).limit(max(0, keep)).select("id", F.lit(True).alias("__new"))
        ranked = receipts.join(top, "id", "left")
        reason = F.when(F.col("__new").isNull(), f"outside the {keep} newest receipts").otherwise(reason)
    if drop_previews:
        reason = F.when(F.col("dry_run"), "dry-run preview").otherwise(reason)
    return ranked.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")


def pruned(receipts: DataFrame, dropped: DataFrame) -> DataFrame:
    """kept_count, freed_bytes (receipt_bytes of what goes) of a pruning."""
    marked = receipts.join(dropped.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left")
    return marked.agg(F.sum(F.when(F.col("__gone").isNull(), 1).otherwise(0)).alias("kept_count"), F.coalesce(F.sum(F.when(F.col("__gone"), F.col("receipt_bytes"))), F.lit(0)).alias("freed_bytes"))


def receipt_totals(receipts: DataFrame) -> DataFrame:
    """id, items, ok, failed, bytes of what went through, undoable: executed quarantines with an item that has a destination."""
    good = F.filter("items", lambda x: x["ok"])
    size = F.aggregate(good, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["size"], F.lit(0)))
    undo = ~F.col("dry_run") & (F.col("action") == "quarantine") & F.exists("items", lambda x: x["ok"] & x["destination"].isNotNull())
    n, ok = F.size("items").cast("bigint"), F.size(good).cast("bigint")
    return receipts.select("id", n.alias("items"), ok.alias("ok"), (n - ok).alias("failed"), size.alias("bytes"), F.coalesce(undo, F.lit(False)).alias("undoable"))


def resolve_receipt(receipts: DataFrame, wanted: str) -> DataFrame:
    """The receipts that a reference means: by path, else id, else file name, else part of the id; several are ambiguous."""
    tier = F.when(F.col("log_path") == wanted, 1).when(F.col("id") == wanted, 2).when(name(F.col("log_path")) == wanted, 3).when(F.col("id").contains(wanted), 4)
    found = receipts.withColumn("tier", tier).where("tier IS NOT NULL")
    return found.join(found.agg(F.min("tier").alias("best")), F.col("tier") == F.col("best")).drop("best")


def unique_names(files: DataFrame, folder: str = "folder", file_name: str = "name", order: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """files with dest_name, free of collisions within a folder: in order, each gets its own name or else the first free of _1, _2, ...

    taken: names that a folder has already (folder, name). A name that shares its stem, but for numbers, with no other name is
    numbered by a sort. Only where such names meet (a.jpg twice, and a_1.jpg) the family is walked, in one task: its size is
    that of a person's numbering.
    """
    own = F.col(file_name)
    root = F.struct(F.regexp_replace(stem(own), r"(_\d+)+$", ""), suffix_as_is(own))
    rows = files.withColumn("__family", F.sha2(F.to_json(F.struct(folder, root)), 256))
    names = rows.select("__family", file_name, F.lit(0).alias("__t"))
    if taken is not None:
        there = taken.select(F.col("folder").alias(folder), F.col("name").alias(file_name)).distinct()
        there = there.withColumn("__family", F.sha2(F.to_json(F.struct(folder, root)), 256))
        names = names.union(there.select("__family", file_name, F.lit(1)))
    mixed = names.groupBy("__family").agg((F.min(file_name) != F.max(file_name)).alias("m"), F.max("__t").alias("t")).where("m OR t = 1").select("__family")
    k = F.row_number().over(W.partitionBy(folder, file_name).orderBy(order)) - 1
    plain = rows.join(mixed, "__family", "left_anti").withColumn("__k", k)
    plain = plain.withColumn("dest_name", F.when(F.col("__k") == 0, own).otherwise(F.concat(stem(own), F.lit("_"), F.col("__k"), suffix_as_is(own)))).drop("__k")
    met = rows.join(mixed, "__family", "left_semi").select("__family", F.col(file_name).alias("n"), F.col(order).alias("o"), stem(own).alias("s"), suffix_as_is(own).alias("x"), F.lit(0).alias("t"))
    if taken is not None:
        met = met.union(there.join(mixed, "__family", "left_semi").select("__family", F.col(file_name), F.lit(None), F.lit(""), F.lit(""), F.lit(1)))

    def walk(family: pd.DataFrame) -> pd.DataFrame:
        used, out = set(family["n"][family["t"] == 1]), []
        for r in family[family["t"] == 0].sort_values("o", kind="stable").itertuples():
            free = r.n if r.n not in used else next(f"{r.s}_{k}{r.x}" for k in itertools.count(1) if f"{r.s}_{k}{r.x}" not in used)
            used.add(free)
            out.append((r.o, r.n, free))
        return pd.DataFrame(out, columns=["__o", "__n", "dest_name"])

    kind = dict(files.dtypes)[order]
    named = met.groupBy("__family").applyInPandas(walk, f"__o {kind}, __n string, dest_name string")
    walked = rows.join(mixed, "__family", "left_semi").join(named, (F.col(order) == F.col("__o")) & (own == F.col("__n"))).drop("__o", "__n")
    return plain.unionByName(walked).drop("__family")


def suffix_as_is(text: Column) -> Column:
    return F.substring(text, F.length(text) - F.length(suffix(text)) + 1, F.length(suffix(text)))


def folder_numbers(groups: DataFrame) -> DataFrame:
    """groups (group_id, kind, group_ord, media_type, member_count, keep: a path) with folder: the kind's, and in it the kind's
    counter in three digits, kind, medium, number of members, stem of keep made safe, and identifier."""
    # one row a group: a kind's groups are ranked in one task
    k = F.row_number().over(W.partitionBy("kind").orderBy("group_ord"))
    return groups.withColumn("folder", F.concat(F.col("kind"), F.lit("/"), F.format_string("%03d_%s_%s_n%d_%s_%s", k, "kind", "media_type", "member_count", safe_name(stem(F.col("keep")), 40), "group_id")))
