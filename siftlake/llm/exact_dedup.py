"""Exact de-duplication against a persistent digest index.

The index is a bucketed table of SHA-256 digests, each bucket sorted by digest. A new batch is reduced to one row for each
digest; what the index does not hold is found by a sort-merge anti-join (the index side is neither shuffled nor sorted again) and
appended. The largest doc_id of a batch's equal texts stays; a text that the index already holds keeps its indexed row. Of a
digest seen before only the number of new rows is appended, so that group sizes stay exact over any number of batches; they
are summed bucket by bucket when the index is read, and compact() folds them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.shared import free_name, new_path, one_of_each, sized, text_or_empty, written
from siftlake.storage import FILE_ROWS

#: Buckets of an index made for one batch: these at least, and one for so many rows (about 40 bytes each).
BUCKETS, BUCKET_ROWS = 32, 4_000_000
#: group_size: rows added; keep_id: the row that stays, null in rows that only add to a digest known before.
COLUMNS = "digest binary, keep_id bigint, first boolean, group_size bigint"


class DigestIndex:
    """Digests of all texts seen, at a path that outlives the session.

    path: a folder shared by all executors. buckets: fixed when the index is made; choose it so that a bucket of the full
    index sorts in one task's memory (40 bytes a row). The session's catalog knows the files by a name of its own; close()
    takes that name away and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, int(buckets)
        self.open()

    def open(self) -> None:
        self.table = f"digest_index_{uuid.uuid4().hex[:10]}"
        self.spark.sql(
            f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet OPTIONS (path '{self.path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def entries(self) -> DataFrame:
        """All rows as they were appended."""
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """digest, keep_id, group_size of every text; aggregated within buckets, without a shuffle."""
        return self.entries().groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("group_size").alias("group_size"))

    def compact(self, path: str) -> "DigestIndex":
        """The same index with one row for each digest, at another path."""
        out = DigestIndex(self.spark, path, self.buckets)
        out.append(self.rows().select("digest", "keep_id", F.lit(True).alias("first"), "group_size"), self.entries().count())
        return out

    def ingest(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Appends the new digests of docs and returns its decisions: doc_id, keep_id, group_size, kept, text_sha256.

        Null text counts as empty. Rows that repeat a doc_id with the same text are one group; exactly one of them stays.
        A null doc_id is the smallest. An empty table gives no rows. Other columns of docs are not looked at.
        group_size counts the rows of this batch and of all before.
        """
        rows = written(
            docs.select(
                F.col(doc_id).cast("bigint").alias("doc_id"),
                F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row_tag"),
            ),
            "digests",
        )
        size = rows.count()
        best = F.max(F.struct("doc_id", "row_tag"))
        heads = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
        heads = written(heads, "heads", size)
        known = self.rows().hint("merge")
        before = known.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_n"), F.lit(True).alias("seen"))
        verdicts = written(
            heads.join(before, "digest", "left").select(
                "digest",
                F.when(F.col("seen"), F.col("old_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                (F.coalesce("old_n", F.lit(0)) + F.col("n")).alias("group_size"),
                F.when(F.col("seen").isNull(), F.col("best.row_tag")).alias("keep_tag"),
            ),
            "verdicts",
            size,
        )
        fresh = heads.join(self.entries().hint("merge"), "digest", "left_anti").select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(True).alias("first"), F.col("n").alias("group_size"))
        more = verdicts.where("keep_tag IS NULL").join(heads.select("digest", "n"), "digest").select("digest", F.lit(None).cast("bigint").alias("keep_id"), F.lit(False).alias("first"), F.col("n").alias("group_size"))
        self.append(fresh.union(more), size)
        return rows.join(verdicts, "digest", "left").select(
            "doc_id", "keep_id", "group_size", (F.col("row_tag").eqNullSafe(F.col("keep_tag"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_tag"
        )

    def append(self, fresh: DataFrame, size: int) -> None:
        """Adds at most size new rows; few are written by one task, which spares each bucket a file for every task."""
        tidy = (fresh.coalesce(1) if size <= 8 * FILE_ROWS else fresh.repartition(self.buckets, "digest")).sortWithinPartitions("digest")
        tidy.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", self.path).saveAsTable(self.table)


def against(docs: DataFrame, index: DigestIndex | None) -> DataFrame:
    """The decisions of index.ingest; without an index, against a new empty one, which leaves nothing in the catalog."""
    if index is not None:
        return index.ingest(docs)
    spark = docs.sparkSession
    index = DigestIndex(spark, new_path(spark, "digest-index"), max(BUCKETS, spark.sparkContext.defaultParallelism, docs.count() // BUCKET_ROWS))
    try:
        return index.ingest(docs)
    finally:
        index.close()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The decisions of DigestIndex.ingest; without an index, against a new empty one."""
    return against(docs, index).drop("row_tag")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows that exact_dedup rejects, with the columns it came with.

    doc_id and digest pick the survivors, one row of each: of rows that repeat both the one with the least hash of its columns,
    which differs only where other columns do.
    """
    own = free_name(docs, "__key")
    kept = against(docs, index).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(own))
    here = docs.withColumn(own, row_key(F.col("doc_id").cast("bigint"), F.sha2(text_or_empty("text"), 256)))
    return sized(one_of_each(here.join(kept, own, "left_semi"), own, docs.columns), docs.count())


def row_key(doc_id: F.Column, digest: F.Column) -> F.Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest)
