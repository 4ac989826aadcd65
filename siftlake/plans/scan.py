"""The scan: records to groups, all stages as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.operators import groups as G
from siftlake.operators.cluster import cluster, walk_rank
from siftlake.operators.evaluate import diagnostics
from siftlake.operators.joins import contained_groups, image_classes, image_edges, sequence_edges
from siftlake.operators.places import numbered
from siftlake.operators.selection import effective_selection
from siftlake.storage import settled


@dataclass
class Options:
    """What a scan looks for. Bounds are in pixels by medium; per_root keeps groups within a record's root."""

    exact: bool = True
    similar_images: bool = True
    similar_videos: bool = False
    no_humans: bool = False
    low_resolution: dict[str, int] = field(default_factory=dict)
    random_review: int = 0
    seed: int = 0
    image_threshold: int = 6
    residual: dict[str, float] = field(default_factory=dict)
    video_threshold: int = 8
    per_root: bool = False


def similar_image_members(records: DataFrame, threshold: int = 6, per_root: bool = False, **residual: float) -> DataFrame:
    """group_key and record columns of clusters of near-identical images, one path in one cluster at most.

    Records with equal codes and aspect are one node, ranked by its best record; a class whose own records match each other
    is a cluster even alone.
    """
    pool = records.where(F.col("media_type").isin(S.IMAGE, S.GIF)).dropDuplicates(["path"])
    classes = settled(image_classes(pool), "classes")
    scope = F.col("root") if per_root else F.lit("")
    node = F.concat_ws("|", "class_id", scope)
    nodes = classes.groupBy(node.alias("node")).agg(F.max(walk_rank()).alias("rank"), F.count("*").alias("n"), F.first("class_id").alias("class_id"), F.first(scope).alias("scope"))
    nodes = settled(nodes, "nodes")
    matches = settled(image_edges(classes, threshold, **residual), "matches")
    side = lambda s: nodes.select(F.col("class_id").alias(f"class_{s}"), F.col("node").alias(s), F.col("scope").alias(f"scope_{s}"))
    edges = matches.where("class_a != class_b").join(side("a"), "class_a").join(side("b"), "class_b").where("scope_a = scope_b").select("a", "b")
    found = settled(cluster(nodes.select("node", "rank"), edges), "clusters")
    selfish = matches.where("class_a = class_b").select(F.col("class_a").alias("class_id"))
    alone = nodes.where("n > 1").join(selfish, "class_id", "left_semi").join(found, "node", "left_anti").select("node", F.col("node").alias("keeper"))
    placed = found.union(alone)
    return classes.withColumn("node", node).join(placed, "node").withColumnRenamed("keeper", "group_key").drop("node", "class_id", "aspect")


def similar_video_members(records: DataFrame, threshold: int = 8) -> DataFrame:
    """group_key and record columns of clusters of videos with near durations and agreeing frames."""
    pool = settled(records.where((F.col("media_type") == S.VIDEO) & F.col("frames").isNotNull()).dropDuplicates(["path"]), "videos")
    edges = sequence_edges(pool.select(F.col("path").alias("id"), "duration", "frames"), threshold)
    found = cluster(pool.select(F.col("path").alias("node"), walk_rank().alias("rank")), edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    return pool.join(found, pool["path"] == found["node"]).withColumnRenamed("keeper", "group_key").drop("node")


def ordered_groups(members: DataFrame) -> DataFrame:
    """members with group_ord: groups by reclaimable bytes, largest first; equals by kind and identifier."""
    ranks = numbered(G.reclaimable(members), [F.col("reclaimable_bytes").desc(), F.col("kind"), F.col("group_id")], "group_ord")
    return members.join(ranks.select("group_id", "kind", "group_ord"), ["group_id", "kind"])


def scan(records: DataFrame, options: Options | None = None, decisions: DataFrame | None = None, publish: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """The members table of all groups that the options ask for, with group_ord.

    publish is called with each kind and its members as soon as they are found, the exact ones first: similar groups that lie
    within exact ones are known only then.
    """
    o, parts, tell = options or Options(), [], publish or (lambda kind, found: None)
    exact = G.build_groups(G.exact_members(records, "root" if o.per_root else None), S.EXACT) if o.exact else None
    if exact is not None:
        exact = settled(exact, "exact")
        parts.append(exact)
        tell(S.EXACT, exact)
    for wanted, found in ((o.similar_images, lambda: similar_image_members(records, o.image_threshold, o.per_root, **o.residual)), (o.similar_videos, lambda: similar_video_members(records, o.video_threshold))):
        if wanted:
            built = settled(G.build_groups(found(), S.SIMILAR, F.col("path").desc()), "similar")
            parts.append(built.join(contained_groups(built, exact), "group_id", "left_anti") if exact is not None else built)
            tell(S.SIMILAR, parts[-1])
    count = S.pixels(F.col("width"), F.col("height"))
    if o.no_humans:
        stamp = S.mtime_stamp(F.col("mtime_ns"), F.col("mtime"))
        parts.append(G.independent_group(records, S.NO_HUMANS, G.trusted_no_person(), [stamp.desc(), F.col("path")]))
        tell(S.NO_HUMANS, parts[-1])
    if o.low_resolution:
        pool = G.without_kept(records, decisions) if decisions is not None else records
        parts.append(G.independent_group(pool, S.LOW_RESOLUTION, G.low_resolution(o.low_resolution), [count, F.col("path")]))
        tell(S.LOW_RESOLUTION, parts[-1])
    if o.random_review:
        parts.append(G.independent_group(G.random_review(records, o.random_review, o.seed), S.RANDOM_REVIEW, F.lit(True), [F.col("path")]))
        tell(S.RANDOM_REVIEW, parts[-1])
    if not parts:
        raise ValueError("the options ask for nothing")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ordered_groups(out)


def scan_summary(members: DataFrame) -> DataFrame:
    return G.summary(members, effective_selection(members))


def scan_diagnostics(records: DataFrame) -> DataFrame:
    """Attempts and failures by stage, by what the records carry."""
    images, videos = F.col("media_type").isin(S.IMAGE, S.GIF), F.col("media_type") == S.VIDEO
    stages: dict[str, tuple[Column, Column]] = {
        "exact": (F.col("size") > 0, F.col("sha256").isNotNull()),
        "image_hash": (images, F.col("phash").isNotNull()),
        "dimensions": (images | videos, (F.col("width") > 0) & (F.col("height") > 0)),
        "person": (images | videos, F.col("human_detection_status").isin(S.PERSON, S.NO_PERSON, S.CONFIRMED)),
        "faces": (images, F.col("face_count").isNotNull()),
    }
    return diagnostics(records, stages)
