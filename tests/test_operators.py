"""Operators on small literal relations, and against plain restatements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import adapters
from siftlake import schema as S
from siftlake.functions import codes, fingerprints, paths, report
from siftlake.operators import groups as G
from siftlake.operators.cache import lookup, upsert
from siftlake.operators.cluster import cluster, cluster_reviewed
from siftlake.operators.components import components, join_hot, parts_for
from siftlake.operators.joins import bands, hamming_join, range_ratio_join, sequence_edges, unknown_pairs
from siftlake.operators.ranking import over_budget, unique_names
from siftlake.operators.selection import apply_decisions, effective_selection, next_unreviewed
from siftlake.plans.scan import ordered_groups
from siftlake.queries import QUERIES
from siftlake.storage import settled

RECORD = "path string, size bigint, mtime double, mtime_ns bigint, width int, height int, media_type string, sha256 string, partial_hash string, human_detection_status string, human_detection_signature string, error string"


def records(spark, rows):
    """rows: path, size, mtime, width, height, sha."""
    return spark.createDataFrame([(p, s, float(m), None, w, h, S.IMAGE, x, x, None, None, None) for p, s, m, w, h, x in rows], RECORD)


def walk(order, edges, apart=()):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, out = set(order), {}
    for k in order:
        if k not in left:
            continue
        group = [k]
        for n in [n for n in order if n in near.get(k, ()) and n in left and n != k]:
            if not any((n, m) in apart or (m, n) in apart for m in group):
                group.append(n)
        left -= set(group)
        if len(group) > 1:
            out.update(dict.fromkeys(group, k))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_the_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(40)]
    rank = {n: rng.randrange(10) for n in names}
    order = sorted(names, key=lambda n: (rank[n], n), reverse=True)
    edges = [(a, b) for a in names for b in names if a < b and rng.random() < 0.06]
    apart = [e for e in edges if rng.random() < 0.2]
    nodes = spark.createDataFrame([(n, rank[n]) for n in names], "node string, r int").select("node", F.struct("r", "node").alias("rank"))
    e = spark.createDataFrame(edges, "a string, b string")
    assert {r["node"]: r["keeper"] for r in cluster(nodes, e).collect()} == walk(order, edges)
    pairs = spark.createDataFrame(apart, "node_a string, node_b string")
    assert {r["node"]: r["keeper"] for r in cluster_reviewed(nodes, e, pairs).collect()} == walk(order, edges, set(apart))


def test_cluster_without_edges_is_empty(spark):
    nodes = spark.createDataFrame([("a", 1)], "node string, rank int")
    assert cluster(nodes, spark.createDataFrame([], "a string, b string")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (7, 7), (102, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("threshold", [0, 3, 6, 12, 15])
def test_hamming_join_is_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 10))) for b in base for _ in range(6)]
    signed = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
    df = spark.createDataFrame([(v,) for v in signed + signed[:3]] + [(None,)], "code bigint")
    got = [tuple(r) for r in hamming_join(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bands_select_few_pairs(spark):
    rng, n = random.Random(9), 4000
    codes = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(n)], "c bigint")
    held = codes.select(F.explode(bands(F.col("c"), 6)).alias("x")).groupBy("x").count()
    assert held.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0] < n * n / 1000


def test_bands_are_not_broadcast(spark):
    codes = settled(spark.range(1000).select(F.xxhash64("id").alias("code")), "few-codes")
    found = hamming_join(codes, 6)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_wide_thresholds_join_no_buckets_of_codes(spark):
    rng = random.Random(10)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    values += [v ^ (1 << k | 1 << 5 + k) for k, v in enumerate(values[:40])]
    found = hamming_join(spark.createDataFrame([(v,) for v in values], "code bigint"), 12)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    x = np.array(values, np.int64).view(np.uint64)
    assert found.count() == sum(int((np.bitwise_count(x[k + 1 :] ^ x[k]) <= 12).sum()) for k in range(len(x)))


def test_range_join_is_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(0.01, 300)) for k in range(120)] + [(500, None), (501, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, duration double")
    known = [r for r in rows if r[1]]
    want = {(a, b) for a, x in known for b, y in known if a < b and min(x, y) >= 0.9 * max(x, y)}
    got = [tuple(r) for r in range_ratio_join(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert unknown_pairs(df).count() == 120 * 2 + 1


def test_duration_gate_of_sequences(spark):
    same, other = [1, 2, 3], [~1, ~2, ~3]
    df = spark.createDataFrame([(1, 100.0, same), (2, 109.0, same), (3, 125.0, same), (4, 100.0, other)], "id bigint, duration double, frames array<bigint>")
    assert [tuple(r) for r in sequence_edges(df).collect()] == [(1, 2)]


def test_sequences_agree_as_the_columns_say(spark):
    rng = random.Random(12)
    base = [[rng.getrandbits(63) for _ in range(9)] for _ in range(4)]
    rows = [(f"i{k:03d}", rng.choice([None, 0.0, 10.0, 90.0, 95.0, 101.0, 130.0]), [c ^ rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) for c in rng.choice(base)[: rng.randrange(0, 10)]]) for k in range(140)]
    rows += [("n1", 95.0, None), ("n2", 95.0, [None, 1]), ("n3", None, base[0][:3] + [None] + base[0][4:])]
    items = spark.createDataFrame(rows, "id string, duration double, frames array<bigint>")
    side = lambda s: items.where("size(frames) > 0").select(*(F.col(c).alias(f"{c}_{s}") for c in items.columns))
    pairs = range_ratio_join(items).union(unknown_pairs(items)).join(side("a"), "id_a").join(side("b"), "id_b")
    want = pairs.where(codes.sequences_agree(F.col("frames_a"), F.col("frames_b"), 16)).select("id_a", "id_b").collect()
    found = sequence_edges(items, 16)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in want} and len(got) > 100


def test_keeper_prefers_pixels_then_size_then_time(spark):
    rows = records(spark, [("/a/small.jpg", 5000, 10, 100, 100, "x"), ("/b/big.jpg", 5000, 5, 4000, 3000, "x"), ("/c/none.jpg", 5000, 99, None, 3, "x")])
    found = G.build_groups(G.exact_members(rows), S.EXACT)
    assert [r["path"] for r in found.where("is_keep").collect()] == ["/b/big.jpg"]
    assert sorted(r["path"] for r in found.where("is_selected").collect()) == ["/a/small.jpg", "/c/none.jpg"]


def test_empty_files_are_in_no_group(spark):
    rows = records(spark, [("/a", 0, 1, 1, 1, "e"), ("/b", 0, 1, 1, 1, "e"), ("/c", 3, 1, 1, 1, "x")])
    assert G.exact_members(rows).count() == 0


def state(spark, groups):
    """groups: id, kind, ord of group, [(path, is_keep, selected, reviewed)]."""
    rows = []
    for gid, kind, order, members in groups:
        rows += [(gid, kind, order, k, p, 10, keep, sel, k, rev, S.NO_PERSON, S.HUMAN_VERSION + "|x", 0.0) for k, (p, keep, sel, rev) in enumerate(members, 1)]
    return spark.createDataFrame(rows, "group_id string, kind string, group_ord bigint, ord bigint, path string, size bigint, is_keep boolean, is_selected boolean, sel_ord bigint, is_reviewed boolean, human_detection_status string, human_detection_signature string, mtime double")


def test_a_full_group_keeps_its_keeper_and_vetoes_hold(spark):
    full = state(spark, [("g", S.EXACT, 1, [("a", True, True, False), ("b", False, True, False)])])
    assert [r["path"] for r in effective_selection(full).collect()] == ["b"]
    veto = state(spark, [("g", S.EXACT, 1, [("a", True, False, False), ("b", False, True, False)]), ("r", S.RANDOM_REVIEW, 2, [("b", False, False, True)])])
    assert effective_selection(veto).count() == 0


def test_overlapping_groups_release_in_order(spark):
    def groups(first, second):
        return state(spark, [("e", S.EXACT, first, [("a", True, True, False), ("b", False, True, False)]), ("s", S.SIMILAR, second, [("b", False, True, False), ("c", True, True, False)])])

    assert sorted(r["path"] for r in effective_selection(groups(1, 2)).collect()) == ["b"]
    swapped = state(spark, [("e", S.EXACT, 1, [("a", False, True, False), ("b", True, True, False)]), ("s", S.SIMILAR, 2, [("b", False, True, False), ("c", True, True, False)])])
    assert sorted(r["path"] for r in effective_selection(swapped).collect()) == ["a", "c"]


def test_decisions_never_empty_a_group(spark):
    m = state(spark, [("g", S.EXACT, 1, [("a", True, False, False), ("b", False, True, False)])])
    d = spark.createDataFrame([("a", "delete", 1), ("b", "keep", 1), ("b", "delete", 2)], "path string, decision string, decided_at int")
    assert [r["path"] for r in apply_decisions(m, d).where("is_selected").collect()] == ["b"]


def test_cache_falls_back_only_for_unknown_paths(spark):
    columns = "path string, size bigint, mtime double, mtime_ns bigint, device bigint, inode bigint, media_type string"
    now = spark.createDataFrame([("/a", 1, 1.0, 5, 1, 1, "image"), ("/b", 2, 1.0, 5, 1, 2, "image"), ("/c", 3, 1.0, 6, 1, 3, "image")], columns)
    old = spark.createDataFrame([("/a", 1, 1.0, 5, 1, 1, "image"), ("/old", 2, 1.0, 5, 1, 2, "image"), ("/c", 3, 1.0, 5, 1, 3, "image"), ("/z", 3, 1.0, 6, 1, 3, "image")], columns).withColumn("algorithm_version", F.lit("v2"))
    assert {r["path"]: r["hit"]["path"] for r in lookup(now, old, "v2").collect()} == {"/a": "/a", "/b": "/old"}
    assert lookup(now, old, "v3").count() == 0
    assert upsert(old, old.where("path = '/a'").withColumn("size", F.lit(9).cast("bigint"))).where("size = 9").count() == 1


def test_budget_and_names(spark):
    rows = [(f"/f{k}", 10, k // 3) for k in range(30)]
    files = spark.createDataFrame(rows, "path string, size bigint, mtime bigint")
    want = [p for i, (p, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[1], r[0]))) if 300 - 10 * i > 120]
    assert sorted(r["path"] for r in over_budget(files, 120, shards=5).collect()) == sorted(want)
    named = unique_names(spark.createDataFrame([("/x/a.jpg", "d", "a.jpg"), ("/y/a.jpg", "d", "a.jpg"), ("/z/a_1.jpg", "d", "a_1.jpg"), ("/z/a.jpg", "e", "a.jpg")], "path string, folder string, name string"))
    got = [(r["folder"], r["dest_name"]) for r in named.collect()]
    assert len(set(got)) == 4 and ("d", "a.jpg") in got and ("e", "a.jpg") in got


def test_path_functions(spark):
    rows = [("/a/.b/C.JPG",), ("/x.tar.GZ",), ("/a/.hidden",), ("/p/My.PhotosLibrary/x",)]
    p = F.col("path")
    got = [tuple(r) for r in spark.createDataFrame(rows, "path string").select(paths.suffix(p), paths.stem(p), paths.depth(p), paths.parent(p), paths.in_package(p), paths.hidden(F.expr("substr(path, 2)"))).collect()]
    assert got == [(".jpg", "C", 4, "/a/.b", False, True), (".gz", "x.tar", 2, "/", False, False), ("", ".hidden", 3, "/a", False, True), ("", "x", 4, "/p/My.PhotosLibrary", True, False)]


def test_code_text_and_alignment(spark):
    df = spark.createDataFrame([([-1, 0, 1 << 62],)], "c array<bigint>")
    text = df.select(codes.tagged(F.col("c"), "t2").alias("t"))
    assert text.head()[0] == "t2:ffffffffffffffff,0000000000000000,4000000000000000"
    assert text.select(codes.untagged(F.col("t"), "t2")).head()[0] == [-1, 0, 1 << 62]
    rng = random.Random(3)
    for n, m in ((1, 4), (3, 8), (8, 5), (2, 2)):
        a, b = ([rng.getrandbits(62) for _ in range(k)] for k in (n, m))
        c = min(n, m)
        at = lambda s, k: s[0] if c == 1 else s[round(k * (len(s) - 1) / (c - 1))]
        want = [(at(a, k) ^ at(b, k)).bit_count() for k in range(c)]
        assert spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(codes.aligned(F.col("a"), F.col("b"))).head()[0] == want


def test_sizes_and_reasons(spark):
    sizes = [0, 1023, 1024, 1536, 1280, 5 << 40, 3000 << 40]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "n bigint").select(report.format_bytes(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.2 KB", "5.0 TB", "3000.0 TB"]
    assert report.signature("v", 0.4, 2.0) == "v|0.4|2"
    assert report.pixel_bound(0.25) == 250_000
    with pytest.raises(ValueError):
        report.pixel_bound(float("nan"))


def test_perceptual_codes_survive_scaling_and_brightness():
    rng = np.random.default_rng(1)
    picture = np.kron(rng.random((8, 8)), np.ones((16, 16)))
    same = fingerprints.resized(picture, 96, 96) * 0.8 + 0.1
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert distance(fingerprints.phash(picture), fingerprints.phash(same)) <= 4
    assert distance(fingerprints.dhash(picture), fingerprints.dhash(same)) <= 6
    assert distance(fingerprints.phash(picture), fingerprints.phash(rng.random((128, 128)))) > 12
    assert len(fingerprints.tile_codes(picture)) == 5 and fingerprints.combined([3, 3, 5]) == 5


def test_low_resolution_bounds_are_strict(spark):
    rows = records(spark, [("/a", 1, 1, 100, 100, "a"), ("/b", 1, 1, 1000, 1000, "b"), ("/c", 1, 1, 0, 0, "c")])
    assert [r["path"] for r in rows.where(G.low_resolution({S.IMAGE: 1_000_000})).collect()] == ["/a"]
    assert G.random_review(rows, 0, 7).count() == 0 and G.random_review(rows, 2, 7).count() == 2


def test_settled_tables_hold_what_they_got(spark):
    assert settled(spark.range(5), "five").count() == 5
    m = state(spark, [("g", S.EXACT, 1, [("a", True, False, False), ("b", False, True, False)])]).drop("group_ord")
    assert ordered_groups(m).select("group_ord").distinct().count() == 1


def test_hot_keys_are_dealt_out(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(900)] + [(f"k{k}", k) for k in range(100)], "a string, b long")
    keyed = rows.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("m"))
    parts = parts_for(keyed)
    assert parts > 32 and parts_for(keyed.limit(0)) == 1
    got = join_hot(rows, keyed, "a", "b", parts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed, "a").collect()))
    edges = spark.createDataFrame([(f"m{k:04d}", "hub") for k in range(500)] + [("x", "y"), ("y", "z"), ("z", "z")], "a string, b string")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {"hub": "hub", "x": "x", "y": "x", "z": "x"} | {f"m{k:04d}": "hub" for k in range(500)}


def test_next_unreviewed_goes_round_in_groups_of_any_size(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.random() < p) for g, n, p in (("a", 300, 0.9), ("b", 3, 1.0), ("c", 40, 0.0), ("d", 1, 0.0)) for k in range(1, n + 1)]
    want = set()
    for g, k, _ in rows:
        todo = [o for h, o, seen in rows if h == g and not seen]
        want.add((g, k, next((o for o in todo if o > k), todo[0] if todo else None)))
    got = [tuple(r) for r in next_unreviewed(spark.createDataFrame(rows, "group_id string, ord bigint, is_reviewed boolean")).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_next_unreviewed_looks_at_each_row_of_a_large_group_once(spark):
    n = 120_000
    rows = spark.range(1, n + 1).select(F.lit("g").alias("group_id"), F.col("id").alias("ord"), (F.col("id") % 3 != 0).alias("is_reviewed"))
    found = next_unreviewed(rows)
    assert "RowFrame, 1, unboundedfollowing" not in found._jdf.queryExecution().toString()
    assert found.where("next_ord = CASE WHEN ord = 120000 THEN 3 ELSE ord + 3 - ord % 3 END").count() == n


def test_codes_of_rows_are_those_of_their_tokens(spark, tmp_path):
    rng = random.Random(4)
    odd = [None, "", " .,", "one", "Ünï İX ß ﬁ x٣ 漢字 áb 😀 q", "a a a b", "\n\ttab\x00zero", " ".join(f"w{k}" for k in range(70_000))]
    texts = odd + [" ".join(rng.choice("the cat Sat; on. a-mat 12 x".split(" ")) for _ in range(rng.randrange(60))) for _ in range(80)]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = adapters.row_codes(docs, adapters.KINDS)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    known = lambda df: {r["doc_id"]: tuple(r)[1:] for r in df.collect() if any(v is not None for v in tuple(r)[1:])}
    assert known(rows) == known(adapters.merged_codes(docs, adapters.KINDS))


def test_codes_of_repeated_doc_ids_are_one(spark, tmp_path):
    rows = [(1, "a b c", "en"), (1, "c d", "en"), (2, "a b c d", "en"), (None, "x", "en"), (None, "y", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = {r["doc_id"]: r["phash"] for r in adapters.document_codes(spark, f"{tmp_path}/b", (0,)).collect()}
    assert len(got) == 3 and got[1] == got[2]


def test_reviewed_pairs_are_all_pairs_and_clusters_leave_out_only_reviewed_ones(spark, tmp_path):
    rng, words = random.Random(21), [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        text = list(words)
        for at in rng.sample(range(60), rng.randrange(4)):
            text[at] = f"x{rng.randrange(1000)}"
        d = 1 + k + k // 16  # none divisible by 17
        rows.append((d, " ".join(text), rng.choice(["en", "de"]), rng.choice(["src1", "src2"]), 6 * (100 + k) // (1 + d % 3)))  # the later, the more pixels
    rows.append((None, " ".join([*words[:-1], "unnamed"]), "en", "src1", 5))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    code = {r["doc_id"]: r["phash"] & (1 << 64) - 1 for r in adapters.document_codes(spark, str(tmp_path), (0,)).collect()}
    head = {}
    for row in [rows[-1], *rows[:-1]]:
        head[f"{code[row[0]]:016x}"] = row
    order = sorted(head, key=lambda c: (head[c][0] is not None, head[c][0] or 0), reverse=True)
    far = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in order for b in order if a < b}
    pairs = {p: d for p, d in far.items() if d <= 6}
    apart = {(a, b) for a, b in pairs if head[a][2] == head[b][2] and head[a][3] != head[b][3]}
    keeper = walk(order, pairs, apart)
    want = {(a, b): (d, (a, b) in apart, keeper.get(a, a), keeper.get(b, b)) for (a, b), d in pairs.items()}
    got = [r.asDict() for r in QUERIES["near_dup_reviewed_pairs"](spark, str(tmp_path)).collect()]
    name = lambda r: (r["node_a"], r["node_b"], r["keeper_a"], r["keeper_b"]) if r["node_a"] < r["node_b"] else (r["node_b"], r["node_a"], r["keeper_b"], r["keeper_a"])
    assert len(got) == len(want) and {name(r)[:2]: (r["distance"], r["reviewed"], *name(r)[2:]) for r in got} == want
    assert any(r["distance"] >= 5 and r["keeper_a"] == r["keeper_b"] for r in got) and any(r["reviewed"] for r in got)
    assert any(f"{code[None]:016x}" in p for p in pairs)
