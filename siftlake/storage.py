"""Tables that cut a lineage: written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        holder = tempfile.TemporaryDirectory(prefix="siftlake-core-")
        atexit.register(holder.cleanup)
        _own.append(holder.name)
    return _own[0]


#: Rows of a file of a table whose size is known beforehand.
FILE_ROWS = 50_000
#: Bytes of a row group: a task that writes, or reads, holds one, and these tables hold long texts.
GROUP_BYTES = 16 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written once as Parquet and read again. The table stays until clean_up: results may still read it.

    rows: at most so many are expected; then there is no more than a file for each FILE_ROWS of them. Small rounds on many
    partitions would else write a file, and open and rename it, for each.
    """
    path = new_path(df.sparkSession, name)
    out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    out.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Removes the tables of this session; results that were not stored elsewhere can no longer be read."""
    jvm, folder = spark.sparkContext._jvm, f"{shared_dir(spark)}/siftlake/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
