"""Places in a global order without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.storage import settled

SHARDS = 64


def ranged(rows: DataFrame, order: list[Column], place: str = "ord", shards: int = SHARDS) -> DataFrame:
    """rows with __shard and their place in order, from 1.

    Rows are ranged into shards by the order's values and written; each shard numbers its own rows from where the ones before
    it end, which is one row a shard to know. order must not leave many rows equal.
    """
    spread = settled(rows.repartitionByRange(shards, *order).withColumn("__shard", F.spark_partition_id()), "ranged")
    line = W.orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)
    before = spread.groupBy("__shard").agg(F.count("*").alias("n")).select("__shard", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__shard").orderBy(*order))
    return spread.join(F.broadcast(before), "__shard").withColumn(place, (F.col("__before") + own).cast("bigint")).drop("__before")


def numbered(rows: DataFrame, order: list[Column], place: str = "ord", shards: int = SHARDS) -> DataFrame:
    """rows with their place in order, from 1."""
    return ranged(rows, order, place, shards).drop("__shard")
