"""N-gram Jaccard self-join of documents by MinHash banding.

1. Each document's set of word 5-grams gives MinHash values, folded into bands whose number and rows are chosen for a target
   recall at the threshold. Documents with equal sets are one node, so copies cost one row from here on.
2. Band hashes are shuffled. A bucket proposes the star from its least node, never its pairs; the connected components of
   all stars hold every pair of nodes that share a bucket.
3. Each component is verified on full n-gram sets, recomputed from the texts: a component is one task's matrix product, or,
   when large, one for each pair of its chunks. A pair counts if it shares a band and its Jaccard index reaches the threshold.
   Tasks return a row for each node (its links and its parent in a spanning forest), not the pairs.
4. The forests' components are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.components import components, join_hot, parts_for
from siftlake.llm.shared import U64, bytes_of, enter, free_name, mix, one_of_each, sized, slices, small_batches, span_hashes, text_or_empty, trim, words_of, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 192
#: A chunk of a component holds about so many nodes or n-grams, whichever is fewer.
CHUNK_NODES, CHUNK_GRAMS = 2048, 1_000_000
_FOLD = U64(0xD6E8FEB86659FD93)


def choose_bands(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance candidates) at which a pair at the threshold shares a band with
    probability recall or more, using at most so many hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding of so few hashes has that recall")
    return best


def shingles(raw: np.ndarray, at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Each text's set of n-grams of words [^\\x20\\x09-\\x0D]+ as ascending 64-bit hashes; a text of 1 to n-1 words is one gram."""
    starts, stops, first = words_of(raw, at)
    h = span_hashes(raw, starts, stops)
    grams = np.zeros(max(0, len(h) - n + 1), U64)
    for t in range(n):
        grams = mix(grams * _FOLD + h[t : t + len(grams)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            x = np.full(1, U64(b - a))
            for t in range(a, b):
                x = mix(x * _FOLD + h[t : t + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


class Banding:
    """MinHash band values of n-gram sets, the same in every task."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.flip = (seeds[: bands * rows] >> U64(32)).astype(np.uint32)[:, None]
        self.odd = ((seeds[bands * rows :] >> U64(32)) | U64(1)).astype(np.uint32)[:, None]

    def of(self, grams: np.ndarray) -> np.ndarray:
        x, least = (grams >> U64(32)).astype(np.uint32), np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for p in range(0, len(x), 4096):
            np.minimum(least, ((x[None, p : p + 4096] ^ self.flip) * self.odd).min(axis=1), out=least)
        out = np.arange(self.bands, dtype=U64)
        for column in least.reshape(self.bands, self.rows).T:
            out = mix(out * _FOLD + column.astype(U64))
        return out


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes(), usedforsecurity=False).digest()


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signed(docs: DataFrame, banding: Banding, n: int) -> DataFrame:
    """doc_id, text_key, node (null without words), grams, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join")
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                sets = shingles(*bytes_of(some.column("text")), n)
                nodes = [node_of(s) if len(s) else None for s in sets]
                bands = [banding.of(s).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_key"), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=SIGNED)
        trim()

    return written(docs.mapInArrow(run, "doc_id bigint, text_key bigint, node binary, grams bigint, bands array<bigint>"), "signed")


def _sets_overlap(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all sets (all with all if left covers them)."""
    sizes = [len(s) for s in sets]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(ids)
    column = np.full(len(counts), -1, np.int64)
    common = np.flatnonzero(counts > 1)
    column[common] = np.arange(len(common))
    where = column[ids]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, where = row[where >= 0], where[where >= 0]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    out = np.zeros((left, len(sets)), np.float32)
    width = max(64, min(4096, (1 << 24) // max(1, len(sets))))
    for a in range(0, len(common), width):
        i, j = np.searchsorted(where, [a, a + width])
        block = np.zeros((len(sets), min(width, len(common) - a)), np.float32)
        block[row[i:j], where[i:j] - a] = 1
        out += block[:left] @ block.T
    return out


def links(sets: list[np.ndarray], bands: np.ndarray, weight: np.ndarray, left: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, the rows of the nodes that it links to, and its parent in the links' spanning forest.

    left: pairs go from the first `left` nodes to the others; None: among all nodes.
    """
    m = len(sets)
    top = m if left is None else left
    sizes = np.array([len(s) for s in sets], np.float32)
    common = _sets_overlap(sets, top)
    # common / union >= threshold, in whole numbers scaled by 1000 to stay clear of rounding
    union = sizes[:top, None] + sizes[None, :] - common
    near = common * 1000 >= round(threshold * 1000) * union
    near[np.arange(top), np.arange(top)] = False
    if left is not None:
        near[:, :left] = False
    a, b = np.nonzero(near)
    share = np.zeros(len(a), bool)
    for p in range(0, len(a), 65536):
        share[p : p + 65536] = (bands[a[p : p + 65536]] == bands[b[p : p + 65536]]).any(axis=1)
    a, b = a[share], b[share]
    count = np.zeros(m, np.int64)
    np.add.at(count, a, weight[b])
    if left is not None:
        np.add.at(count, b, weight[a])
    parent = np.arange(m)
    while True:  # least label over the links, then jump to the label's label
        new = parent.copy()
        np.minimum.at(new, a, parent[b])
        np.minimum.at(new, b, parent[a])
        new = new[new]
        if (new == parent).all():
            return count, parent
        parent = new


def ngram_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, class_id, class_key, n_links, class_size, n_copies.

    Two rows are linked if the Jaccard index of their sets of word n-grams is threshold or more; n_links counts a row's
    partners, rows with the same set included. class_id is the least doc_id of the rows that links connect, class_size their
    number, n_copies the rows with the same set. Null text is empty; a text without words has no n-grams and no links and
    is its own class. A text of fewer than n words is one n-gram. Rows that repeat are partners of each other. A null doc_id
    sorts before all others. An empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    banding = Banding(*choose_bands(threshold, recall))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = signed(base, banding, n)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("n_copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    size = rows.count()
    nodes = written(nodes, "nodes", size)

    keyed = nodes.select("node", F.explode("bands").alias("band"))
    leaders = keyed.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = written(leaders, "leaders", size)
    stars = join_hot(keyed, leaders.select("band", "leader"), "band", "node", parts_for(leaders)).where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    found = components(stars, size)

    members = written(found.join(nodes, "node").select("root", "node", "rep", "n_copies", "grams", "bands"), "members", size)
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    chunks = sizes.select("root", F.ceil(F.greatest(F.col("m") / CHUNK_NODES, F.col("g") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    placed = members.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_key").cast("string"))
    placed = placed.withColumn("key", F.concat_ws(":", F.coalesce(F.col("rep.doc_id").cast("string"), F.lit("-")), F.col("rep.text_key").cast("string"))).drop("rep")
    texts = base.select(key.alias("key"), "text")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    work = texts.join(placed, "key").select("root", "node", "n_copies", "bands", "text", "chunks", "chunk", other)
    work = work.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other")

    def verify(table: pa.Table) -> pa.Table:
        enter("ngram_join")
        table = table.combine_chunks()
        ids = table.column("node").to_pylist()
        chunk = table.column("chunk").to_numpy()
        cross = len(ids) > 0 and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        first: dict[bytes, int] = {}
        for k in np.lexsort((chunk,)) if cross else range(len(ids)):
            first.setdefault(ids[k], int(k))
        picks = sorted(first.values(), key=lambda k: (chunk[k] if cross else 0, ids[k]))
        left = int(sum(chunk[k] == chunk[picks[0]] for k in picks)) if cross else None
        if cross and left == len(picks):
            left = None  # a chunk that happens to be empty: what is here was compared in its own task
            picks = []
        texts_here = table.column("text").take(pa.array(picks, pa.int64())).combine_chunks()
        if isinstance(texts_here, pa.ChunkedArray):
            texts_here = pa.concat_arrays(texts_here.chunks) if texts_here.num_chunks else pa.array([], pa.string())
        count, parent = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if picks:
            sets = shingles(*bytes_of(texts_here), n)
            bands = np.array([banding.of(s) for s in sets])
            count, parent = links(sets, bands, table.column("n_copies").to_numpy()[picks], left, threshold)
            del sets, bands
            if len(picks) > CHUNK_NODES // 4:  # each block's arrays are as wide as the group
                trim()
        many = len(picks) and table.column("chunks")[0].as_py() > 1
        return pa.table({"node": pa.array([ids[k] for k in picks], pa.binary()), "links": pa.array(count, pa.int64()), "parent": pa.array([ids[picks[p]] for p in parent], pa.binary()), "many": pa.array([bool(many)] * len(picks), pa.bool_())})

    checked = written(work.groupBy("root", "i", "j").applyInArrow(verify, "node binary, links bigint, parent binary, many boolean"), "checked", 10 * size)
    forest = components(checked.where("many").select(F.col("node").alias("a"), F.col("parent").alias("b")), size)
    summed = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("parent").alias("parent"), F.first("many").alias("many"))
    labels = summed.join(forest, "node", "left").select("node", "links", F.when(F.col("many"), F.coalesce("root", "node")).otherwise(F.col("parent")).alias("label"))
    named = nodes.join(labels, "node", "left").select("node", "rep", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    named = written(named, "named", size)
    classes = named.groupBy("label").agg(F.min("rep").alias("head"), F.sum("n_copies").alias("class_size"))
    about = written(named.join(classes, "label").select("node", "head", "class_size", "n_copies", (F.col("links") + F.col("n_copies") - 1).alias("n_links")), "classes", size)
    own = F.struct("doc_id", "text_key")
    return rows.select("doc_id", "text_key", "node").join(about, "node", "left").select(
        "doc_id",
        "text_key",
        F.coalesce("head", own)["doc_id"].alias("class_id"),
        F.coalesce("head", own)["text_key"].alias("class_key"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def drop_near_copies(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of ngram_join: the one with its least doc_id. Texts without words stay.

    Of rows that repeat doc_id and text one stays, the one with the least hash of its columns.
    """
    own = free_name(docs, "__key")
    key = lambda i, t: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), t.cast("string"))
    found = ngram_join(docs, n, threshold)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key")))
    heads = heads.select(key(F.col("doc_id"), F.col("text_key")).alias(own))
    here = docs.withColumn(own, key(F.col("doc_id").cast("bigint"), F.xxhash64(text_or_empty("text"))))
    return sized(one_of_each(here.join(heads, own, "left_semi"), own, docs.columns), docs.count())
