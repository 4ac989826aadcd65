"""The engine's queries over the plain tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import adapters as A
from siftlake import schema as S
from siftlake.functions import paths as P
from siftlake.functions import report as R
from siftlake.functions.codes import hamming, sample_times, tagged, to_hex, untagged
from siftlake.operators import cache as C
from siftlake.operators import evaluate as E
from siftlake.operators import groups as G
from siftlake.operators import joins as J
from siftlake.operators import listing as L
from siftlake.operators import ranking as K
from siftlake.operators import selection as X
from siftlake.operators.cluster import cluster_reviewed, walk_rank
from siftlake.plans import actions as T
from siftlake.plans import scan as SC
from siftlake.sources.inventory import ALWAYS_EXCLUDED, collapse_links
from siftlake.sources.stores import list_receipts
from siftlake.storage import settled
from siftlake.streaming.incremental import events_once

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}


def query(f: Q) -> Q:
    QUERIES[f.__name__] = f
    return f


def exact(spark: SparkSession, sf: str) -> DataFrame:
    return SC.ordered_groups(G.build_groups(G.exact_members(A.base_records(spark, sf)), S.EXACT))


def reviewed_state(spark: SparkSession, sf: str) -> DataFrame:
    """Exact groups and two review groups, some of whose members are reviewed and selected."""
    base = A.base_records(spark, sf)
    count = S.pixels(F.col("width"), F.col("height"))
    low = G.independent_group(base, S.LOW_RESOLUTION, G.low_resolution({"image": 2000, "gif": 2000, "video": 2000}), [count, F.col("path")])
    people = G.independent_group(base, S.NO_HUMANS, G.trusted_no_person(), [F.col("path")])
    flags = {"is_selected": F.col("doc_id") % 2 == 0, "is_reviewed": F.col("doc_id") % 3 != 0}
    built = G.build_groups(G.exact_members(base), S.EXACT)
    return SC.ordered_groups(built.unionByName(low.withColumns(flags)).unionByName(people.withColumns(flags)))


@query
def near_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Keeper-centred clusters of near-identical images: banded Hamming join, residuals, clustering."""
    rows = SC.similar_image_members(A.records(spark, sf, langs=A.PICTURES))
    built = G.build_groups(rows, S.SIMILAR, F.col("path").desc())
    return built.select("group_id", "path", "is_keep", F.col("size").cast("bigint").alias("size"))


@query
def near_dup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return J.hamming_join(A.document_codes(spark, sf, (0,)).withColumnRenamed("phash", "code"), 6)


@query
def near_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of the codes that near_dup_edges pairs."""
    return A.document_codes(spark, sf, (0,)).where("phash IS NOT NULL").select("doc_id", F.col("phash").alias("code"), to_hex(F.col("phash")).alias("hex"))


@query
def near_dup_edges_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Matching classes of equal codes, each named by its least path; a class paired with itself matches itself."""
    rows = settled(J.image_classes(A.records(spark, sf)), "classes")
    least = rows.groupBy("class_id").agg(F.min("path").alias("path"))
    pairs = J.image_edges(rows)
    side = lambda s: least.select(F.col("class_id").alias(f"class_{s}"), F.col("path").alias(s))
    return pairs.join(side("a"), "class_a").join(side("b"), "class_b").select(F.least("a", "b").alias("path_a"), F.greatest("a", "b").alias("path_b"))


#: Wider bounds, at which the documents of the plain tables have clusters that are not exact groups.
WIDE = {"dhash_most": 30, "tile_most": 40, "tile_mean": 32.0, "aspect_most": 1e6}


@query
def near_dup_not_exact_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Similar clusters that no exact group holds wholly."""
    found = SC.scan(A.records(spark, sf, langs=A.PICTURES), SC.Options(image_threshold=12, residual=WIDE))
    return found.where("kind = 'similar'").groupBy("group_id").agg(F.count("*").alias("member_count"))


@query
def per_root_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = SC.similar_image_members(A.records(spark, sf, langs=A.PICTURES), 12, per_root=True, **WIDE)
    return G.build_groups(rows, S.SIMILAR, F.col("path").desc()).select("root", "group_id", "path", "is_keep")


@query
def scan_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and members by kind of a scan for exact, low-resolution, person-free and random files, as they are published."""
    told: list[DataFrame] = []
    bounds = {"image": 2000, "gif": 2000, "video": 2000}
    SC.scan(A.base_records(spark, sf), SC.Options(similar_images=False, no_humans=True, low_resolution=bounds, random_review=25, seed=3), publish=lambda kind, found: told.append(found.groupBy(F.lit(kind).alias("kind")).agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("members"))))
    out = told[0]
    for t in told[1:]:
        out = out.union(t)
    return out


@query
def similar_video_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of conversations as videos: near sizes, near codes of their turns."""
    c = A.conversation_sequences(spark, sf)
    none = F.lit(None)
    rows = c.select(F.concat(F.lit("/c/"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"), F.lit(S.VIDEO).alias("media_type"), "duration", "frames", F.col("duration").cast("bigint").alias("size"), none.cast("int").alias("width"), none.cast("int").alias("height"), F.lit(1.0).alias("mtime"), none.cast("bigint").alias("mtime_ns"))
    return G.build_groups(SC.similar_video_members(rows, 26), S.SIMILAR, F.col("path").desc()).select("group_id", "path", "is_keep")


@query
def near_dup_reviewed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of near_dup_edges, whether they were reviewed as distinct, and the keepers of both codes (its own where a code is in
    no cluster). Clusters are of codes alone; a code's best document stands for it, and pairs of one language and different sources
    were reviewed as distinct. near_dup_classes has the documents of a code."""
    codes = A.document_codes(spark, sf, (0,)).where("phash IS NOT NULL").withColumnRenamed("doc_id", "id")
    known = A.base_records(spark, sf).select("doc_id", "path", "root", "width", "height", "size", "mtime", "mtime_ns", "extension")
    heads = codes.join(known, F.col("id").eqNullSafe(F.col("doc_id"))).groupBy("phash").agg(F.max(F.struct(walk_rank().alias("rank"), "root", "extension")).alias("head"))
    # documents of equal rank are told apart by their codes
    nodes = settled(heads.select(to_hex(F.col("phash")).alias("node"), F.struct("head.rank", "phash").alias("rank"), "phash", "head.root", "head.extension"), "heads")
    near = J.hamming_join(nodes.withColumnRenamed("phash", "code"), 6)
    side = lambda s: nodes.select(F.col("phash").alias(f"code_{s}"), F.col("node").alias(f"node_{s}"), F.col("root").alias(f"root_{s}"), F.col("extension").alias(f"extension_{s}"))
    distinct = F.col("extension_a").eqNullSafe(F.col("extension_b")) & ~F.col("root_a").eqNullSafe(F.col("root_b"))
    pairs = settled(near.join(side("a"), "code_a").join(side("b"), "code_b").select("node_a", "node_b", "distance", distinct.alias("reviewed")), "pairs")
    edges = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    found = settled(cluster_reviewed(nodes.select("node", "rank"), edges, pairs.where("reviewed")), "clusters")
    keeper = lambda s: found.select(F.col("node").alias(f"node_{s}"), F.col("keeper").alias(f"keeper_{s}"))
    both = pairs.join(keeper("a"), "node_a", "left").join(keeper("b"), "node_b", "left")
    return both.select("node_a", "node_b", "distance", "reviewed", F.coalesce("keeper_a", "node_a").alias("keeper_a"), F.coalesce("keeper_b", "node_b").alias("keeper_b"))


@query
def reviewed_pairs_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of near_dup_edges without those whose distance is odd, which a reviewer called distinct."""
    edges = settled(near_dup_edges(spark, sf), "edges")
    known = edges.where("distance % 2 = 1").select(F.col("code_b").alias("path_a"), F.col("code_a").alias("path_b"))
    return J.drop_reviewed(edges, known, "code_a", "code_b").select("code_a", "code_b")


@query
def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    m = exact(spark, sf)
    return m.groupBy("group_id").agg(F.count("*").alias("member_count"), F.max(F.when(F.col("is_keep"), F.col("path"))).alias("keep_path"), (F.sum("size") - F.max(F.when(F.col("is_keep"), F.col("size")))).alias("reclaimable_bytes"))


@query
def exact_group_members(spark: SparkSession, sf: str) -> DataFrame:
    return exact(spark, sf).select("group_id", "ord", "path", "is_keep", "is_selected")


@query
def exact_candidates_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return G.buckets(A.base_records(spark, sf).where("size > 0"), "size").groupBy("size").agg(F.count("*").alias("n"))


@query
def partial_hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return G.buckets(A.base_records(spark, sf).where("size > 0"), "size", "partial_hash").groupBy("size", "partial_hash").agg(F.count("*").alias("n"))


@query
def exact_rows_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines that agree in part, quantity, tax and discount."""
    keys = ["l_partkey", "l_quantity", "l_tax", "l_discount"]
    return A.table(spark, sf, "lineitem").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


@query
def order_line_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts with several lines."""
    return A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1")


@query
def hardlink_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_links(A.base_records(spark, sf), "doc_id").select("path", "inode")


@query
def media_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = A.base_records(spark, sf)
    return r.select("path", "media_type", F.col("extension").isin(*S.extensions(videos=False)).alias("still"), S.pixels(F.col("width"), F.col("height")).alias("pixels"), S.mtime_stamp(F.col("mtime_ns"), F.col("mtime")).alias("stamp"))


@query
def duration_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations of near sizes, paired through their different sizes."""
    sizes = A.conversation_sequences(spark, sf).groupBy("duration").agg(F.count("*").alias("n")).select(F.col("duration").cast("bigint").alias("id"), "duration")
    return J.range_ratio_join(sizes)


@query
def sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose sizes and turn codes are near; equal ones are one, named by the least id."""
    rows = A.conversation_sequences(spark, sf).where("frames IS NOT NULL").groupBy("duration", "frames").agg(F.min("id").alias("id"))
    return J.sequence_edges(settled(rows, "sequences"), threshold=26)


@query
def sample_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    times = sample_times(F.col("duration") / 100)
    return A.conversation_sequences(spark, sf).select("id", F.size(times).cast("bigint").alias("n"), F.round(F.array_max(times), 6).alias("last"))


@query
def tagged_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Regional codes as tagged text and back."""
    c = A.document_codes(spark, sf, tuple(range(2, 7))).where("tiles IS NOT NULL").withColumn("text", tagged(F.col("tiles"), S.TILE_TAG))
    back = untagged(F.col("text"), S.TILE_TAG)
    return c.select("doc_id", "text", (back == F.col("tiles")).alias("same"), untagged(F.col("text"), S.FRAME_TAG).isNull().alias("other_tag_is_null"))


@query
def embedding_sign_edges(spark: SparkSession, sf: str) -> DataFrame:
    return J.hamming_join(A.sign_codes(spark, sf), 15)


@query
def similarity_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of a nearer threshold as a prediction of equal labels, over the pairs of embeddings within 15 bits."""
    codes = A.sign_codes(spark, sf)
    side = lambda s: codes.select(F.col("code").alias(f"code_{s}"), F.col("label").alias(f"label_{s}"))
    pairs = embedding_sign_edges(spark, sf).join(side("a"), "code_a").join(side("b"), "code_b")
    rows = pairs.select((F.col("label_a") == F.col("label_b")).alias("truth"), F.when(F.col("distance") != 13, F.col("distance") <= 14).alias("predicted"))
    return E.confusion(rows, "truth", "predicted")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = A.table(spark, sf, "documents"), A.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    predicted = F.when(F.col("doc_id") % 10 != 0, F.lower("text").contains("idiot") | F.lower("text").contains("stupid"))
    return docs.join(labels, "doc_id").select("doc_id", "lang", (F.col("toxic") == 1).alias("truth"), predicted.alias("predicted"))


@query
def detector_eval(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(detections(spark, sf), "truth", "predicted", "lang")


@query
def detector_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    return E.mistakes(detections(spark, sf), "truth", "predicted", "doc_id")


@query
def face_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.face_summary(A.base_records(spark, sf))


@query
def no_human_group(spark: SparkSession, sf: str) -> DataFrame:
    stamp = S.mtime_stamp(F.col("mtime_ns"), F.col("mtime"))
    return G.independent_group(A.base_records(spark, sf), S.NO_HUMANS, G.trusted_no_person(), [stamp.desc(), F.col("path")]).select("group_id", "ord", "path")


@query
def manual_override(spark: SparkSession, sf: str) -> DataFrame:
    """The no-person group when a reviewer has seen people in large documents."""
    seen = F.when(F.col("size") > 2000, S.CONFIRMED).otherwise(F.col("human_detection_status"))
    rows = A.base_records(spark, sf).withColumn("human_detection_status", seen)
    reuse = C.person_reusable(f"{S.HUMAN_VERSION}|opencv|0.4")
    return rows.select("path", G.trusted_no_person().alias("no_person"), reuse.alias("reusable"))


@query
def low_res_group(spark: SparkSession, sf: str) -> DataFrame:
    count = S.pixels(F.col("width"), F.col("height"))
    rows = A.base_records(spark, sf)
    return G.independent_group(rows, S.LOW_RESOLUTION, G.low_resolution(dict.fromkeys((S.IMAGE, S.GIF, S.VIDEO), 1500)), [count, F.col("path")]).select("ord", "path", count.alias("pixels"))


@query
def low_res_per_type_bounds(spark: SparkSession, sf: str) -> DataFrame:
    hit = G.low_resolution({S.IMAGE: 1000, S.VIDEO: 3000})
    return A.base_records(spark, sf).where(hit).select("path", "media_type")


@query
def keep_decisions_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Low-resolution records that no valid decision keeps; some decisions were made for another size."""
    rows = A.base_records(spark, sf)
    stamp = S.mtime_stamp(F.col("mtime_ns"), F.col("mtime"))
    decisions = rows.select("path", F.when(F.col("face_count") == 1, F.col("size")).when(F.col("face_count") == 2, F.col("size") + 1).cast("string").alias("size"), stamp.alias("mtime_ns"))
    return G.without_kept(rows, decisions).where(G.low_resolution({S.IMAGE: 2500})).select("path")


@query
def random_review_50(spark: SparkSession, sf: str) -> DataFrame:
    return G.random_review(A.base_records(spark, sf), 50, 7).select("path")


def _rule(rule: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return G.smart_select(exact(spark, sf), rule).select("group_id", "path", "is_keep", "is_selected")

    run.__name__ = f"smart_select_{rule}"
    run.__doc__ = f"Keepers and selections of exact groups by the rule {rule}."
    query(run)


for _name in S.SMART_RULES:
    _rule(_name)


@query
def smart_select_review_groups(spark: SparkSession, sf: str) -> DataFrame:
    return G.smart_select(reviewed_state(spark, sf), "select_candidates").where(F.col("kind") != S.EXACT).select("kind", "path", "is_selected")


@query
def effective_selection(spark: SparkSession, sf: str) -> DataFrame:
    return X.effective_selection(settled(reviewed_state(spark, sf), "state"))


@query
def keep_veto(spark: SparkSession, sf: str) -> DataFrame:
    return X.vetoed(reviewed_state(spark, sf))


@query
def kind_precedence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.kind_counts(settled(reviewed_state(spark, sf), "state"))


@query
def removal_routes(spark: SparkSession, sf: str) -> DataFrame:
    state = settled(reviewed_state(spark, sf), "state")
    return X.routed(X.effective_selection(state), state).groupBy("route").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _bulk(operation: str, criteria: dict | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return X.bulk_select(reviewed_state(spark, sf), operation, criteria).select("kind", "path", "is_selected", "is_reviewed")

    run.__name__ = f"bulk_{operation}"
    run.__doc__ = f"Selections after the bulk operation {operation}."
    query(run)


_bulk("select_all")
_bulk("select_none")
_bulk("invert")
_bulk("criteria", {"min_size": 300, "max_size": 4000, "path_contains": "SRC1", "min_faces": 1})


@query
def bulk_smaller_than_keeper(spark: SparkSession, sf: str) -> DataFrame:
    """Members that a criterion on the keeper's size picks, in a state whose keeper is the oldest of similar clusters."""
    groups = near_dup_state(spark, sf)
    return X.bulk_select(groups, "criteria", {"smaller_than_keeper": True}, S.SIMILAR).select("group_id", "path", "is_selected")


def near_dup_state(spark: SparkSession, sf: str) -> DataFrame:
    return SC.ordered_groups(G.build_groups(SC.similar_image_members(A.records(spark, sf, langs=A.PICTURES)), S.SIMILAR, F.col("path").desc()))


@query
def reviewer_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Exact groups after decisions: the newest of a path holds, and no group is emptied."""
    rows = A.base_records(spark, sf)
    first = rows.select("path", F.lit("delete").alias("decision"), F.lit(1).alias("decided_at"))
    second = rows.select("path", F.when(F.col("face_count") == 1, "keep").when(F.col("face_count") == 2, "clear").otherwise("delete").alias("decision"), F.lit(2).alias("decided_at"))
    return X.apply_decisions(exact(spark, sf), first.union(second)).select("group_id", "path", "is_selected")


@query
def next_unreviewed(spark: SparkSession, sf: str) -> DataFrame:
    return X.next_unreviewed(reviewed_state(spark, sf).where(F.col("kind") == S.LOW_RESOLUTION)).select("ord", "next_ord")


@query
def reclaimable_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return G.reclaimable(reviewed_state(spark, sf)).select("kind", "member_count", "reclaimable_bytes")


@query
def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scan_summary(settled(reviewed_state(spark, sf), "state"))


@query
def stage_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scan_diagnostics(A.records(spark, sf, (0,)))


@query
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_errors(A.base_records(spark, sf).withColumnRenamed("doc_id", "ord"))


@query
def group_media_types(spark: SparkSession, sf: str) -> DataFrame:
    m = exact(spark, sf)
    return G.dominant_media_type(m).withColumnRenamed("media_type", "dominant").join(G.single_media_type(m).withColumnRenamed("media_type", "single"), "group_id")


def cached(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache holds: some rows under older paths, of older times, or of an older version."""
    r, d = A.base_records(spark, sf), F.col("doc_id")
    return r.select(
        F.when(d % 9 == 0, F.concat(F.lit("/old"), F.col("path"))).otherwise(F.col("path")).alias("path"), "size", F.when(d % 6 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"),
        F.when(d % 6 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "media_type", "device", (d * 10).alias("inode"), F.sha1("sha256").alias("sha256"),
        F.when(d % 8 == 0, "v1").otherwise("v2").alias("algorithm_version"), F.when(d % 4 != 0, F.lit(9)).cast("int").alias("face_count"),
    )


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return A.base_records(spark, sf).withColumn("inode", F.col("doc_id") * 10)


@query
def cache_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    return C.hydrate(scanned(spark, sf), cached(spark, sf), "v2").select("path", "sha256", "face_count", "from_cache")


@query
def cache_rename_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = C.lookup(scanned(spark, sf), cached(spark, sf), "v2")
    return found.where(F.col("path") != F.col("hit.path")).select("path", F.col("hit.path").alias("cached_path"))


@query
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    unknown = {"phash": F.lit(None).cast("bigint"), "dhash": F.lit(None).cast("bigint"), "face_detection_signature": F.lit(None).cast("string")}
    new = scanned(spark, sf).withColumns(unknown).where(C.cacheable()).select("path", "size", "sha256", F.lit("v2").alias("algorithm_version"))
    return C.upsert(cached(spark, sf).select("path", "size", "sha256", "algorithm_version"), new)


@query
def cacheable_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = A.records(spark, sf, (0, 1)).withColumns({"sha256": F.lit(None).cast("string"), "partial_hash": F.lit(None).cast("string"), "face_detection_signature": F.lit(None).cast("string")})
    return r.select("path", F.coalesce(C.cacheable(), F.lit(False)).alias("cacheable"), C.needs_codes().alias("needs_codes"))


@query
def distinct_pair_revalidate(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within exact groups that a reviewer called distinct, of which some files have changed since."""
    rows = A.base_records(spark, sf)
    sets = G.exact_members(rows).select(F.col("group_key").alias("set_id"), "path", C.identity().alias("identity"))
    now = rows.withColumn("size", F.when(F.col("face_count") == 3, F.col("size") + 1).otherwise(F.col("size")))
    return C.valid_pairs(C.all_pairs(sets), now)


@query
def group_listing_filtered(spark: SparkSession, sf: str) -> DataFrame:
    state = settled(reviewed_state(spark, sf), "state")
    states = L.group_states(state)
    view = L.listed(states, state, L.member_filter(min_mib=0.0005, path="src1*doc"), search="/doc", hide_completed=False, scope="duplicates")
    return view.select("group_id", "selected", "complete", "needs_attention", "media_type")


@query
def group_listing_page(spark: SparkSession, sf: str) -> DataFrame:
    return L.page(L.group_states(settled(exact(spark, sf), "exact")), "reclaimable", 5, 10).select("group_id", "reclaimable_bytes")


@query
def group_listing_by_members(spark: SparkSession, sf: str) -> DataFrame:
    return L.page(L.group_states(settled(exact(spark, sf), "exact")), "members", 0, 20).select("group_id", "member_count")


@query
def group_tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.tab_counts(L.group_states(settled(reviewed_state(spark, sf), "state")))


@query
def group_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return L.neighbours(L.group_states(settled(exact(spark, sf), "exact"))).select("group_id", "previous", "next")


@query
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return A.table(spark, sf, "pages").select("page_id", P.name(u).alias("name"), P.parent(u).alias("parent"), P.depth(u).alias("depth"), P.safe_name(u, 40).alias("safe"), R.thumbnail_key(F.col("page_id"), u).alias("thumbnail"))


@query
def record_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return A.base_records(spark, sf).select("path", P.stem(p).alias("stem"), P.suffix(p).alias("suffix"), P.depth(p).alias("depth"), P.in_roots(p, ("/src1", "/src2/de")).alias("in_roots"), P.in_package(p).alias("in_package"))


@query
def exclusion_globs(spark: SparkSession, sf: str) -> DataFrame:
    relative = F.regexp_replace("path", "^/", "")
    return A.base_records(spark, sf).select("path", P.excluded(relative, (*ALWAYS_EXCLUDED, "src1*/EN/*", "doc0000001?.*", "*[13579].gif")).alias("excluded"), P.hidden(relative).alias("hidden"))


@query
def path_matcher(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return A.base_records(spark, sf).select("path", P.path_matches(p, "SRC1/").alias("plain"), P.path_matches(p, "src?/d*7.gif").alias("pattern"), P.path_matches(p, "").alias("empty"))


@query
def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("size") * F.pow(F.lit(1000.0), F.col("doc_id") % 5)
    return A.base_records(spark, sf).select("doc_id", R.format_bytes(n.cast("bigint")).alias("text"))


@query
def prune_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons why records of a stored session are gone, by a changed inventory."""
    errors = T.validated(scanned(spark, sf), present(spark, sf), ("/src1", "/src2", "/src3", "/src4"))
    return errors.where("error IS NOT NULL").groupBy(R.prune_reason(F.col("error")).alias("reason")).agg(F.count("*").alias("n"), F.min("path").alias("sample"))


@query
def receipts_list(spark: SparkSession, sf: str) -> DataFrame:
    return list_receipts(A.receipts(spark, sf), previews=False, limit=25).select("id", "action")


@query
def receipts_prune(spark: SparkSession, sf: str) -> DataFrame:
    return K.receipts_to_prune(A.receipts(spark, sf), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 20, 500, True)


@query
def receipts_totals(spark: SparkSession, sf: str) -> DataFrame:
    return K.receipt_totals(A.receipts(spark, sf))


@query
def receipt_reference(spark: SparkSession, sf: str) -> DataFrame:
    return K.resolve_receipt(A.receipts(spark, sf), "0000000012").select("id", F.col("tier").cast("bigint").alias("tier"))


@query
def lru_budget_prune(spark: SparkSession, sf: str) -> DataFrame:
    files = A.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.floor(F.col("value") * 100).cast("bigint").alias("size"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"))
    return K.over_budget(files, 20_000_000).select("path")


def present(spark: SparkSession, sf: str, codes: DataFrame | None = None) -> DataFrame:
    """What an inventory sees after some files were removed, linked, grown, moved to another inode or touched."""
    base = A.base_records(spark, sf)
    known = base.join(codes, "doc_id", "left") if codes is not None else base.withColumn("phash", F.lit(None).cast("bigint"))
    r, d = known.withColumn("inode", F.col("doc_id") * 10), F.col("doc_id")
    return r.where(~F.col("error").eqNullSafe(F.lit("image hash: fault 1"))).select(
        "path", (F.col("size") + F.when(d % 19 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(d % 23 == 0, 9).otherwise(0)).alias("mtime"), (F.col("mtime_ns") + F.when(d % 23 == 0, 9).otherwise(0)).alias("mtime_ns"),
        "device", (F.col("inode") + F.when(d % 29 == 0, 1).otherwise(0)).alias("inode"), (d % 31 == 0).alias("is_symlink"), (d % 37 != 0).alias("is_regular"),
        F.when(d % 19 == 0, F.sha1("sha256")).otherwise(F.col("sha256")).alias("sha256"), "phash", F.lit(None).cast("array<bigint>").alias("frames"),
    )


@query
def validate_identity(spark: SparkSession, sf: str) -> DataFrame:
    return T.validated(scanned(spark, sf), present(spark, sf), ("/src1", "/src2", "/src3", "/src4"))


def planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    codes = settled(A.document_codes(spark, sf, (0,)).select("doc_id", "phash"), "codes")
    rows = A.base_records(spark, sf).join(codes, "doc_id", "left").withColumns({"inode": F.col("doc_id") * 10, "frames": F.lit(None).cast("array<bigint>")})
    members = settled(SC.ordered_groups(G.build_groups(G.exact_members(rows), S.EXACT)), "members")
    selected = settled(X.effective_selection(members), "selected")
    return members, selected, settled(T.preflight(members, selected, settled(present(spark, sf, codes), "present")), "errors")


@query
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf)[2]


@query
def action_plan(spark: SparkSession, sf: str) -> DataFrame:
    members, selected, errors = planned(spark, sf)
    return T.action_plan(members, selected, errors, "quarantine").select("path", "group_id", "ok", "destination", "error")


@query
def undo_plan(spark: SparkSession, sf: str) -> DataFrame:
    members, selected, errors = planned(spark, sf)
    plan = settled(T.action_plan(members, selected, errors, "quarantine"), "plan")
    items = plan.withColumn("item_ord", F.regexp_extract("path", r"doc(\d+)", 1).cast("bigint"))
    there = items.where("item_ord % 7 != 0").select(F.col("destination").alias("path")).union(items.where("item_ord % 11 = 0").select("path"))
    return T.undo_plan(items, there).select("source", "destination", "error")


@query
def isolate_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.isolate_plan(reviewed_state(spark, sf).where(F.col("kind") == S.EXACT)).select("path", "destination")


@query
def session_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Exact groups after the records that are no longer valid are gone."""
    errors = T.validated(scanned(spark, sf), present(spark, sf))
    return T.after_removal(exact(spark, sf), errors.where("error IS NOT NULL")).select("group_id", "path", "is_keep", "is_selected")


@query
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    done, total = F.col("event_id") % 100, F.lit(100)
    rate, eta = R.rate_and_eta(done, total, F.col("value"))
    return A.table(spark, sf, "events").select("event_id", F.round(rate, 6).alias("rate"), F.round(eta, 6).alias("eta"))


@query
def preview_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    verdict = R.preview_verdict(e % 13 != 0, e % 600, F.lit(300), e % 3 != 0)
    return A.table(spark, sf, "events").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query
def code_distances(spark: SparkSession, sf: str) -> DataFrame:
    c = A.document_codes(spark, sf, (0, 1))
    return c.select("doc_id", hamming(F.col("phash"), F.col("dhash")).cast("bigint").alias("distance"))


@query
def events_once_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: the users, types and days of events, each once."""
    e = A.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return events_once(e.select("user_id", "event_type", "day"), ["user_id", "event_type", "day"])


@query
def errors_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(*map(F.lit, ("sha256 failed: a", "partial hash failed: b", "image hash failed: c", "video fingerprint failed: d", "image hash: e")))
    return E.errors_by_stage(A.base_records(spark, sf).withColumn("error", F.when(F.col("doc_id") % 3 == 0, F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int")))))


@query
def event_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return E.throughput(A.table(spark, sf, "events"), F.floor("value").cast("bigint"), "event_type")


@query
def scanned_totals(spark: SparkSession, sf: str) -> DataFrame:
    return E.scanned_totals(A.base_records(spark, sf))


@query
def receipts_freed(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.receipts(spark, sf)
    return K.pruned(rows, K.receipts_to_prune(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), keep=500))


@query
def one_group(spark: SparkSession, sf: str) -> DataFrame:
    """The members of the review group, of which some were deleted."""
    state = reviewed_state(spark, sf).where(F.col("kind") == S.LOW_RESOLUTION).withColumn("group_id", F.lit("low"))
    return L.one_group(state, "low", A.base_records(spark, sf).where("doc_id % 3 = 0")).select("ord", "path", "deleted")


@query
def bulk_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """Selections after emptying the duplicate groups that a search shows."""
    state = settled(reviewed_state(spark, sf), "state")
    view = L.listed(L.group_states(state), state, search="/src1/", scope="duplicates")
    return X.bulk_in_view(state, view, "select_none").select("kind", "path", "is_selected")


@query
def allowed_paths(spark: SparkSession, sf: str) -> DataFrame:
    r = A.base_records(spark, sf)
    asked = r.where("doc_id % 2 = 0").select("path").union(r.where("doc_id % 5 = 0").select(F.concat(F.lit("/other"), F.col("path"))))
    return T.allowed(asked, r.where("doc_id % 4 = 0"), ("/src1",))


@query
def deleted_candidates_undo(spark: SparkSession, sf: str) -> DataFrame:
    """Bringing one deleted candidate back: the person-free file of the least path."""
    people = settled(reviewed_state(spark, sf).where(F.col("kind") == S.NO_HUMANS), "people")
    path = people.agg(F.min("path")).head()[0] or ""
    deleted = T.delete_one(people, path).select("path", F.concat(F.lit("/trash"), F.col("path")).alias("trashed"))
    return T.undo_one(deleted, deleted.select(F.col("trashed").alias("path")), path)


@query
def code_explanations(spark: SparkSession, sf: str) -> DataFrame:
    c = A.document_codes(spark, sf, (0, 1))
    return c.select("doc_id", R.explanation(F.col("phash"), F.col("dhash"), F.col("dhash"), F.col("dhash")).alias("text"))


@query
def display_formats(spark: SparkSession, sf: str) -> DataFrame:
    return A.base_records(spark, sf).select("path", R.duration_text(F.col("size") * 1.0).alias("duration"), R.mime_type(F.col("extension")).alias("mime"))
