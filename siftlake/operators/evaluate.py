"""Confusion counts and rates of predictions; a null prediction is an error and counts nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.report import ratio


def _count(hit: Column) -> Column:
    return F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("bigint")


def confusion(rows: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """evaluated, errors, tp, tn, fp, fn, precision, recall, negative_precision, accuracy (null on nothing), for each of keys."""
    t, p = F.col(truth), F.col(predicted)
    counts = rows.groupBy(*keys).agg(
        _count(p.isNotNull()).alias("evaluated"), _count(p.isNull()).alias("errors"), _count(t & p).alias("tp"), _count(~t & ~p).alias("tn"), _count(~t & p).alias("fp"), _count(t & ~p).alias("fn")
    )
    c = F.col
    return counts.withColumns(
        {"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "negative_precision": ratio(c("tn"), c("tn") + c("fn")), "accuracy": ratio(c("tp") + c("tn"), c("evaluated"))}
    )


def mistakes(rows: DataFrame, truth: str, predicted: str, item: str) -> DataFrame:
    """item, mistake: false_negative or false_positive."""
    wrong = F.col(truth) != F.col(predicted)
    return rows.where(wrong).select(item, F.when(F.col(truth), "false_negative").otherwise("false_positive").alias("mistake"))


def face_summary(records: DataFrame) -> DataFrame:
    n = F.col("face_count")
    return records.agg(_count(n.isNotNull()).alias("analyzed"), _count(n >= 1).alias("with_faces"), _count(n > 1).alias("with_several"))


def diagnostics(records: DataFrame, stages: dict[str, tuple[Column, Column]]) -> DataFrame:
    """stage, attempted, succeeded, failed, skipped: of all records, by each stage's (asked for, succeeded), in one pass."""
    counts = []
    for stage, (asked, done) in stages.items():
        tried = F.coalesce(asked, F.lit(False))
        good = tried & F.coalesce(done, F.lit(False))
        counts += [_count(tried).alias(f"{stage}_a"), _count(good).alias(f"{stage}_s"), _count(tried & ~good).alias(f"{stage}_f"), _count(~tried).alias(f"{stage}_k")]
    row = records.agg(*counts)
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"{s}_a").alias("attempted"), F.col(f"{s}_s").alias("succeeded"), F.col(f"{s}_f").alias("failed"), F.col(f"{s}_k").alias("skipped")) for s in stages))
    return row.select(F.inline(each))


def first_errors(records: DataFrame, most: int = 20) -> DataFrame:
    """error, first: distinct errors in the order in which they first occur (column ord), at most so many."""
    return records.where("error IS NOT NULL").groupBy("error").agg(F.min("ord").alias("first")).orderBy("first").limit(most)


# How the errors of a stage begin.
STAGE_ERRORS = {"exact": ("partial hash failed", "sha256 failed"), "similar_image": ("image hash failed",), "similar_video": ("video fingerprint failed",)}


def error_stage(error: Column) -> Column:
    """The stage that an error comes from, by its beginning; null for others."""
    out = None
    for stage, heads in STAGE_ERRORS.items():
        for head in heads:
            out = F.when(error.startswith(head), stage) if out is None else out.when(error.startswith(head), stage)
    return out


def errors_by_stage(records: DataFrame) -> DataFrame:
    """stage, errors, sample (the least text)."""
    staged = records.withColumn("stage", error_stage(F.col("error"))).where("stage IS NOT NULL")
    return staged.groupBy("stage").agg(F.count("*").alias("errors"), F.min("error").alias("sample"))


def throughput(rows: DataFrame, elapsed: Column, *keys: str) -> DataFrame:
    """items, elapsed_seconds, items_per_second (null where no time has passed), for each of keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(elapsed).alias("elapsed_seconds")).withColumn("items_per_second", ratio(F.col("items"), F.col("elapsed_seconds")))


def scanned_totals(records: DataFrame) -> DataFrame:
    """media_type, files_found, bytes_scanned."""
    return records.groupBy("media_type").agg(F.count("*").alias("files_found"), F.sum("size").alias("bytes_scanned"))
