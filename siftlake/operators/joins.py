"""Similarity joins: Hamming distance, ratio ranges, and set containment.

Joins pair classes of equal codes, not rows: a class with many rows costs one.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.codes import hamming, tiles_agree
from siftlake.storage import settled

#: Beyond this threshold codes that differ at random begin to match.
WIDEST_BANDED = 15
#: Up to this threshold pairs of blocks select better than looking at every pair of codes.
WIDEST_BLOCKS = 8
#: Blocks that must agree at once. Codes within the threshold differ in so many of threshold + AGREEING blocks at most.
AGREEING = 2
#: Codes of a chunk, and chunks at most, where every pair is looked at.
CHUNK, MOST_CHUNKS = 16_384, 64


#: Sequences of a chunk (more in a bucket that would have over BUCKET_CHUNKS) and of a block within it, and tasks at most.
SEQUENCES, BUCKET_CHUNKS, SEQUENCE_ROWS, MOST_TASKS = 2048, 16, 128, 400


def blocks(threshold: int) -> list[tuple[int, int]]:
    """First bit and end of threshold + AGREEING blocks of a code."""
    n = threshold + AGREEING
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def bands(code: Column, threshold: int) -> Column:
    """Band and bits of all pairs of blocks: codes within the threshold share one at least. A band is named by the blocks' places as bits."""
    cut = blocks(threshold)
    part = lambda k: F.shiftrightunsigned(code, cut[k][0]).bitwiseAND(F.lit((1 << (cut[k][1] - cut[k][0])) - 1))
    join = lambda i, j: F.shiftleft(part(i), cut[j][1] - cut[j][0]).bitwiseOR(part(j))
    return F.array(*(F.struct(F.lit(1 << i | 1 << j).alias("band"), join(i, j).alias("bits")) for i, j in combinations(range(len(cut)), AGREEING)))


def first_band(a: Column, b: Column, threshold: int) -> Column:
    """The first band that two codes share: the least two blocks that agree. Lambdas keep a join's condition small enough to be compiled."""
    mask = lambda lo, hi: F.lit((1 << hi) - (1 << lo) - (1 << 64 if hi == 64 else 0)).cast("bigint")
    known = F.array(*(F.struct(mask(lo, hi).alias("mask"), F.lit(1 << k).alias("place")) for k, (lo, hi) in enumerate(blocks(threshold))))
    agree = F.filter(known, lambda s: a.bitwiseXOR(b).bitwiseAND(s["mask"]) == 0)
    return F.aggregate(F.slice(agree, 1, AGREEING), F.lit(0), lambda found, s: found.bitwiseOR(s["place"]))


def hamming_join(codes: DataFrame, threshold: int, code: str = "code") -> DataFrame:
    """code_a < code_b and distance of all pairs of different codes within the threshold.

    Codes are made distinct and written first. Near thresholds: codes that agree in a pair of blocks are an equi-join; a pair
    that shares several comes from the first only, so nothing needs to be made distinct afterwards. Wide thresholds: blocks get
    too narrow to select, so chunks of codes are compared with each other, every pair of chunks a task's work. Null codes pair
    with nothing. The threshold may be 0 to 15.
    """
    if not 0 <= threshold <= WIDEST_BANDED:
        raise ValueError(f"a banded join takes thresholds from 0 to {WIDEST_BANDED}")
    one = settled(codes.where(F.col(code).isNotNull()).select(F.col(code).cast("bigint").alias("c")).distinct(), "codes")
    if threshold > WIDEST_BLOCKS:
        return compared(one, threshold)
    cut = one.select("c", F.explode(bands(F.col("c"), threshold)).alias("x")).select("c", "x.band", "x.bits")
    a, b = cut.alias("a"), cut.alias("b")
    close = (F.col("a.c") < F.col("b.c")) & (hamming(F.col("a.c"), F.col("b.c")) <= threshold)
    first = first_band(F.col("a.c"), F.col("b.c"), threshold) == F.col("a.band")
    # never broadcast: the optimiser takes a side for as large as the codes, but it has a row for each band of each code
    pairs = a.hint("merge").join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & close).where(first)
    return pairs.select(F.col("a.c").alias("code_a"), F.col("b.c").alias("code_b"), hamming(F.col("a.c"), F.col("b.c")).cast("bigint").alias("distance"))


def compared(one: DataFrame, threshold: int) -> DataFrame:
    """hamming_join of distinct codes (c) by looking at every pair: all pairs of chunks, dealt out."""
    n = max(1, min(MOST_CHUNKS, -(-one.count() // CHUNK)))
    mine = F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    dealt = one.withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tiles = dealt.select((F.least("chunk", "other") * n + F.greatest("chunk", "other")).alias("tile"), "chunk", "c")

    def compare(table: pa.Table) -> pa.Table:
        c, chunk = table["c"].to_numpy().view(np.uint64), table["chunk"].to_numpy()  # of a signed number the bits of its amount would count
        lo, hi = divmod(table["tile"][0].as_py(), n)
        a, b = c[chunk == lo], c[chunk == hi]
        left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for k, x in enumerate(a):  # a row at a time: its distances stay in the processor's cache
            near = np.flatnonzero(np.bitwise_count((b[k + 1 :] if lo == hi else b) ^ x) <= threshold)
            if len(near):
                left.append(np.full(len(near), x))
                right.append(b[near + (k + 1 if lo == hi else 0)])
        p, q = np.concatenate(left), np.concatenate(right)
        far = np.bitwise_count(p ^ q).astype(np.int64)
        p, q = p.view(np.int64), q.view(np.int64)
        return pa.table({"code_a": np.minimum(p, q), "code_b": np.maximum(p, q), "distance": far})

    # as many partitions as tiles: few bytes hold much work, and the size of partitions would put all of it into one task
    return tiles.repartition(n * (n + 1) // 2, "tile").groupBy("tile").applyInArrow(compare, "code_a bigint, code_b bigint, distance bigint")


def aspect(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width / height)


def image_residual(a: str, b: str, dhash_most: int = 10, tile_most: int = 8, tile_mean: float = 5.0, aspect_most: float = 0.15) -> Column:
    """What a pair of image codes must pass besides: gradient codes and aspects where both are known, regional codes always."""
    side = lambda s, c: F.col(f"{s}.{c}")
    gradient = F.coalesce(hamming(side(a, "dhash"), side(b, "dhash")) <= dhash_most, F.lit(True))
    shape = F.coalesce(F.abs(side(a, "aspect") - side(b, "aspect")) <= aspect_most, F.lit(True))
    return gradient & shape & tiles_agree(side(a, "tiles"), side(b, "tiles"), tile_most, tile_mean)


def image_classes(records: DataFrame) -> DataFrame:
    """Classes of records with equal codes and aspect: class_id, phash, dhash, tiles, aspect, members."""
    shaped = records.where("phash IS NOT NULL").withColumn("aspect", aspect(F.col("width"), F.col("height")))
    key = F.sha2(F.to_json(F.struct("phash", "dhash", "tiles", "aspect")), 256)
    return shaped.withColumn("class_id", key)


def image_edges(records: DataFrame, threshold: int = 6, **residual: float) -> DataFrame:
    """class_a, class_b of the pairs of classes of image_classes that match, and each class that matches itself (class_a = class_b)."""
    one = image_classes(records).select("class_id", "phash", "dhash", "tiles", "aspect").dropDuplicates(["class_id"])
    near = hamming_join(one, threshold, "phash")
    both = near.select("code_a", "code_b").union(one.select(F.col("phash").alias("code_a"), F.col("phash").alias("code_b")).distinct())
    a, b = one.alias("a"), one.alias("b")
    pairs = both.join(a, F.col("code_a") == F.col("a.phash")).join(b, F.col("code_b") == F.col("b.phash"))
    kept = pairs.where((F.col("code_a") != F.col("code_b")) | (F.col("a.class_id") <= F.col("b.class_id"))).where(image_residual("a", "b", **residual))
    return kept.select(F.least("a.class_id", "b.class_id").alias("class_a"), F.greatest("a.class_id", "b.class_id").alias("class_b"))


def range_ratio_join(items: DataFrame, ratio: float = 0.9, key: str = "id", value: str = "duration") -> DataFrame:
    """id_a < id_b of items whose smaller value is at least ratio of the larger.

    Values fall into logarithmic buckets one ratio wide, so a partner's bucket is the same or a neighbour; the condition
    is then checked exactly. Items without a positive value pair with all others: their number must be small, and they are
    joined by an inequality only against the rest.
    """
    known = items.where(F.col(value) > 0).select(F.col(key).alias("id"), F.col(value).cast("double").alias("v"))
    bucketed = known.withColumn("bucket", F.floor(F.log("v") / -math.log(ratio)).cast("bigint"))
    spread = bucketed.select("id", "v", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    a, b = spread.alias("a"), bucketed.alias("b")
    exact = F.least("a.v", "b.v") >= ratio * F.greatest("a.v", "b.v")
    return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id")) & exact).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def unknown_pairs(items: DataFrame, key: str = "id", value: str = "duration") -> DataFrame:
    """id_a < id_b of the pairs in which one item at least has no positive value."""
    plain = items.select(F.col(key).alias("id"), F.coalesce(F.col(value) > 0, F.lit(False)).alias("known"))
    a, b = plain.where("NOT known").alias("a"), plain.alias("b")
    pairs = a.join(b, (F.col("a.id") < F.col("b.id")) | (F.col("b.known") & (F.col("a.id") > F.col("b.id"))))
    return pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def sequence_edges(items: DataFrame, threshold: int = 8, ratio: float = 0.9, key: str = "id") -> DataFrame:
    """id_a < id_b of items (key, duration, frames) whose durations are near or unknown and whose code sequences agree.

    Durations fall into buckets as in range_ratio_join, and buckets into chunks; chunks of the same or neighbouring buckets are
    compared in arrays, each pair of chunks in one group, and those without a duration with all. Only pairs that match are rows.
    Items with equal duration and frames should be one row: they agree by definition.
    """
    spark = items.sparkSession
    some = items.where(F.size("frames") > 0).select(F.col(key).alias("id"), F.when(F.col("duration") > 0, F.col("duration").cast("double")).alias("v"), F.col("frames").cast("array<bigint>").alias("frames"))
    some = settled(some.withColumn("bucket", F.floor(F.log("v") / -math.log(ratio)).cast("bigint")), "sequences")
    counts = {r["bucket"]: r["n"] for r in some.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket, by the logarithm of the range
    chunks = {b: min(BUCKET_CHUNKS, -(-n // SEQUENCES)) for b, n in counts.items()}
    places = [(b, k) for b in chunks for k in range(chunks[b])]
    with_it = lambda b: chunks if b is None else [x for x in (b, b + 1) if x in chunks]
    sides, n = [], 0
    for x in places:
        for b in with_it(x[0]):
            for k in range(chunks[b]):
                if b != x[0] or k >= x[1]:
                    sides += [(n, *x, 0)] + [(n, b, k, 1)] * ((b, k) != x)
                    n += 1
    tiles = spark.createDataFrame(sides, "tile bigint, bucket bigint, chunk int, side int")
    many = spark.createDataFrame(list(chunks.items()), "bucket bigint, chunks int")
    same = lambda a, b: F.col(f"{a}.bucket").eqNullSafe(F.col(f"{b}.bucket"))
    chunked = some.alias("s").join(F.broadcast(many).alias("m"), same("s", "m")).select("s.*", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = chunked.alias("s").join(tiles.alias("t"), same("s", "t") & (F.col("s.chunk") == F.col("t.chunk"))).select("tile", "side", "id", "v", "frames")

    def compare(table: pa.Table) -> pa.Table:
        return near_sequences(table.combine_chunks(), threshold, ratio)

    kind = some.schema["id"].dataType.simpleString()
    # as many partitions as there is work for: few bytes hold much of it, and the size of partitions would put it into few tasks
    return dealt.repartition(max(1, min(n, MOST_TASKS)), "tile").groupBy("tile").applyInArrow(compare, f"id_a {kind}, id_b {kind}")


def near_sequences(table: pa.Table, threshold: int, ratio: float) -> pa.Table:
    """id_a < id_b of the rows (side, id, v, frames) that match: those of side 0 with those of side 1, if there are any, else with each other."""
    side, ids = table["side"].to_numpy(), table["id"].combine_chunks()
    v = table["v"].to_numpy(zero_copy_only=False).astype(float)  # unknown: NaN
    frames = table["frames"].combine_chunks()
    size = pc.list_value_length(frames).to_numpy().astype(np.int64)
    flat = frames.flatten()
    known, codes = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy().view(np.uint64)
    first, alone = np.cumsum(size) - size, not (side == 1).any()
    cap = max(4, 2 * threshold)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    of = lambda s: {n: np.flatnonzero((side == s) & (size == n)) for n in np.unique(size[side == s])}
    left, right = of(0), of(0 if alone else 1)
    for p, all_a in left.items():
        for q, b in right.items():
            n = min(p, q)
            pick = lambda m: np.rint(np.arange(n) * (m - 1) / max(n - 1, 1)).astype(np.int64)
            at = lambda rows, m: first[rows][:, None] + np.r_[pick(m), 0, m - 1]
            b = b[known[at(b, q)].all(axis=1)]
            right_codes = np.ascontiguousarray(codes[at(b, q)].T)
            for k in range(0, len(all_a), SEQUENCE_ROWS):
                a = all_a[k : k + SEQUENCE_ROWS]
                a = a[known[at(a, p)].all(axis=1)]
                far, near = v[a][:, None], v[b][None]
                good = ~(np.minimum(far, near) < ratio * np.maximum(far, near))  # NaN is near to all
                if alone:
                    good &= a[:, None] < b[None]
                total, left_codes = np.zeros(good.shape, np.int64), codes[at(a, p)]
                for f in range(n + 2):  # the last two are the ends
                    d = np.bitwise_count(left_codes[:, f, None] ^ right_codes[f])
                    good &= d <= cap
                    if f < n:
                        total += d
                x, y = np.nonzero(good & (total <= threshold * n))
                found_a.append(a[x])
                found_b.append(b[y])
    x, y = ids.take(pa.array(np.concatenate(found_a))), ids.take(pa.array(np.concatenate(found_b)))
    less = pc.less(x, y)
    return pa.table({"id_a": pc.if_else(less, x, y), "id_b": pc.if_else(less, y, x)})


def drop_reviewed(edges: DataFrame, pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """edges without the unordered pairs that were reviewed as distinct."""
    known = pairs.select(F.least("path_a", "path_b").alias("__a"), F.greatest("path_a", "path_b").alias("__b")).distinct()
    return edges.join(known, (F.least(a, b) == F.col("__a")) & (F.greatest(a, b) == F.col("__b")), "left_anti")


def contained_groups(members: DataFrame, holders: DataFrame) -> DataFrame:
    """group_id of the groups whose paths all lie in one group of holders (group_id, path; holders are disjoint), by counts."""
    held = holders.select(F.col("path"), F.col("group_id").alias("holder"))
    found = members.join(held, "path", "left").groupBy("group_id").agg(F.count("*").alias("n"), F.count("holder").alias("held"), F.count_distinct("holder").alias("holders"))
    return found.where("n = held AND holders = 1").select("group_id")
