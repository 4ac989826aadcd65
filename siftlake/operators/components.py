"""Connected components of an edge table, by rounds that turn every component into a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.storage import settled


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).head()
    return row["n"], row["h"] or 0


#: A join is dealt out further from the point where one key has a share of one in so many rows.
PARTS = 64


def parts_for(counts: DataFrame, n: str = "n") -> int:
    """Into how many parts the keys of a join are to be dealt, by the counts of their rows: 1, or more if a key has many of all."""
    row = counts.agg(F.max(n).alias("top"), F.sum(n).alias("all")).head()
    return max(1, min(PARTS, round(PARTS * row["top"] / row["all"]))) if row["all"] else 1


def join_hot(rows: DataFrame, keyed: DataFrame, key: str | list[str], by: str, parts: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key. With parts, a key's rows are dealt by their column `by` to so many
    tasks, and each of these gets a copy of the key's one row."""
    if parts == 1:
        return rows.join(keyed, key)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    spread = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(spread, [*([key] if isinstance(key, str) else key), "__part"]).drop("__part")


def components(edges: DataFrame, about: int | None = None, most_rounds: int = 100) -> DataFrame:
    """node, root for every node of the undirected edges (a, b); root is the least node of its component.

    Large-star and small-star rounds: each replaces a node's edges by edges to its least neighbour, so the number of rounds
    grows with the logarithm of a component's size and the edges never grow beyond the input's. Minima are combined before
    they are shuffled and written, and the joins back deal the rows of hot nodes to several tasks. Every round is written to
    the shared folder. Loops are ignored and no edges give no rows.
    about: how many edges are expected, for the number of files of the first table.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = settled(edges.where(F.col("a") != F.col("b")).select(hi.alias("a"), lo.alias("b")).distinct(), "edges", about)
    seen = _digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least", 2 * seen[0])
        large = join_hot(both, least.select("a", F.least("a", "m").alias("m")), "a", "b", parts_for(least)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = settled(large, "large-star", seen[0])
        least = settled(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least", seen[0])
        small = join_hot(large, least.select("a", "m"), "a", "b", parts_for(least)).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b")))
        now = settled(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star", seen[0])
        if (was := seen) == (seen := _digest(now)):
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
