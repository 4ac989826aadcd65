"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else.

Suffixes are sorted blockwise with a difference cover (suffix_sort). What makes that affordable over a cluster is that only
suffixes that can tie to the full length are sorted, and that a block is a set of suffix buckets that no two equal strings of
that length can be split between:

1. Anchors. Of the GRAM-byte strings within each window of LENGTH bytes the one with the least hash (the leftmost of equals)
   is its anchor. Equal windows have equal anchors at the same place, so the windows that share an anchor's hash are a suffix
   bucket, and a bucket with one occurrence holds no repeat. One row for each run of windows with one anchor is shuffled:
   about 2 / (LENGTH - GRAM) of the positions, with hashes of the anchor and of all bytes of the run.
2. Runs whose bytes all occur twice are repeated whole. They need no sorting, however many copies there are.
3. In buckets with several different runs, one copy of each run's bytes goes to the bucket's block. Blocks, of a bounded
   number of bytes, are sorted: the cover-sample's ranks, then one bucket of suffixes at a time, long ties by those ranks.
   Neighbours in that order are compared over the full length, which is exact.
4. A bucket too large for a block is cut into buckets of single windows by their full content; partial aggregation counts
   them before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import BASE_A, BASE_B, TILE, U64, bytes_of, enter, free_name, mix, powers, prefix_sums, sized, slices, small_batches, span_hashes, text_or_empty, trim, written
from siftlake.llm.suffix_sort import repeated
from siftlake.operators.components import join_hot, parts_for

LENGTH = 200
GRAM = 32
#: Bytes of a block, and runs in a bucket beyond which it is cut into single windows.
BLOCK_BYTES, MOST_RUNS = 1 << 20, 50_000
#: Bytes of the runs that are cut out of texts at a time, about.
PIECE_BYTES = 1 << 19


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position, tile by tile."""
    n = max(0, len(raw) - gram + 1)
    out = np.empty(n, U64)
    _, down = powers(BASE_A)
    for p in range(0, n, TILE):
        m = min(TILE, n - p)
        sums = prefix_sums(raw[p : p + m + gram - 1], BASE_A)
        out[p : p + m] = mix((sums[gram : gram + m] - sums[:m]) * down[:m])
    return out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each width successive ones."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    full = -(-len(keys) // width) * width
    grid = np.concatenate([keys, np.full(full - len(keys), np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def anchor_runs(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows of one text with one anchor: text's number, first window, windows, anchor's hash, hash of the run's bytes."""
    g = gram_hashes(raw, gram)
    place = np.arange(len(g), dtype=U64)
    least = sliding_least((g & U64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    delta = np.zeros(len(raw) + 2, np.int8)
    inside = np.flatnonzero(np.diff(at) >= length)
    if not len(inside):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    delta[at[inside]] += 1
    delta[at[inside + 1] - length + 1] -= 1
    valid = np.flatnonzero(np.cumsum(delta[: len(least)], dtype=np.int32) > 0)
    where = (least[valid] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    begin, count = valid[first], np.diff(np.append(first, len(valid)))
    text = np.searchsorted(at, begin, side="right") - 1
    spans = span_hashes(raw, begin, begin + count + length - 1, BASE_B)
    return text, begin - at[text], count, g[where[first]], spans


RUNS = pa.schema([("doc_key", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("span", pa.int64())])


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            for some in slices(batch, "text", 1 << 19):
                text, first, windows, anchor, span = anchor_runs(*bytes_of(some.column("text")), length, gram)
                keys = some.column("doc_key").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))], schema=RUNS)
        trim()

    return written(texts.mapInArrow(run, "doc_key bigint, first int, windows int, anchor bigint, span bigint"), "anchors")


def contexts(work: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each run of work, from the texts: block, anchor, single, doc_key, first, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                raw, at = bytes_of(some.column("text"))
                runs = some.column("runs")
                block, anchor, single, first, windows = runs.flatten().flatten()
                owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
                sizes = windows.to_numpy().astype(np.int64) + length - 1
                starts, keys = at[owner] + first.to_numpy(), some.column("doc_key").to_numpy()[owner]
                upto = np.cumsum(sizes)
                i = 0
                while i < len(sizes):  # in pieces: runs overlap, and a text may be long
                    j = max(i + 1, int(np.searchsorted(upto, upto[i] + PIECE_BYTES)))
                    ends = np.concatenate([[0], upto[i:j] - upto[i] + sizes[i]])
                    data = raw[np.arange(ends[-1]) + np.repeat(starts[i:j] - ends[:-1], sizes[i:j])]
                    found = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                    part = [x.slice(i, j - i) for x in (block, anchor, single)]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(keys[i:j]), first.slice(i, j - i), found], names=["block", "anchor", "single", "doc_key", "first", "bytes"])
                    i = j
        trim()

    grouped = work.groupBy("doc_key").agg(F.collect_list(F.struct("block", "anchor", "single", "first", "windows")).alias("runs"))
    return texts.join(grouped, "doc_key").select("doc_key", "text", "runs").mapInArrow(run, "block bigint, anchor bigint, single boolean, doc_key bigint, first int, bytes binary")


MARKS = "doc_key bigint, first int, windows int"


def sorted_block(length: int):
    """Of a block's runs, the windows of single runs that stand elsewhere in the block, as marks."""

    def run(table: pa.Table) -> pa.Table:
        enter("substring_dedup")
        table = table.combine_chunks()
        column = table.column("bytes").combine_chunks()
        raw, at = bytes_of(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)
        counts = np.maximum(np.diff(at) - length + 1, 0)
        starts = np.arange(int(counts.sum()), dtype=np.int32)
        starts -= np.repeat((np.cumsum(counts) - counts - at[:-1]).astype(np.int32), counts)
        starts = starts[repeated(raw, starts, length)]
        owner = np.searchsorted(at, starts, side="right") - 1
        hit = table.column("single").to_numpy()[owner]
        owner, starts = owner[hit], starts[hit]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        who = owner[first]
        begin = starts[first] - at[who] + table.column("first").to_numpy()[who]
        out = pa.table({"doc_key": pa.array(table.column("doc_key").to_numpy()[who]), "first": pa.array(begin.astype(np.int32)), "windows": pa.array(np.diff(np.append(first, len(starts))).astype(np.int32))})
        if len(raw) > 2 * BLOCK_BYTES:  # of a bucket that is larger than a block
            del table, column, raw, owner, starts, hit, counts
            trim()
        return out

    return run


def single_windows(rows: DataFrame, length: int) -> DataFrame:
    """doc_key, first, single and two hashes of every window of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            for some in slices(batch, "bytes", 1 << 18):
                raw, at = bytes_of(some.column("bytes"))
                a, b = (gram_hashes(raw, length), gram_hashes(raw[::-1], length)[::-1])
                counts = np.maximum(np.diff(at) - length + 1, 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                here = start + at[:-1][owner]
                yield pa.RecordBatch.from_arrays([pa.array(some.column("doc_key").to_numpy()[owner]), pa.array((start + some.column("first").to_numpy()[owner]).astype(np.int32)), pa.array(some.column("single").to_numpy(zero_copy_only=False)[owner]), pa.array(a[here].view(np.int64)), pa.array(b[here].view(np.int64))], names=["doc_key", "first", "single", "h1", "h2"])
        trim()

    return rows.mapInArrow(run, "doc_key bigint, first int, single boolean, h1 bigint, h2 bigint")


def marks(texts: DataFrame, length: int, gram: int, block_bytes: int, most_runs: int) -> DataFrame:
    """doc_key, first, windows: runs of window starts whose strings also start elsewhere."""
    rows = anchored(texts, length, gram)
    size = rows.count()
    # written, so that the join below reads two plain shuffles, of which adaptive execution can split a hot anchor's
    again = written(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again", size)
    # dealt by document, so that no file, and no task that reads one, holds all runs of a hot anchor
    runs = written(rows.join(again, "anchor").repartition("doc_key"), "repeated-anchors", size)
    size = runs.count()
    place = F.struct("doc_key", "first", "windows")
    spans = written(runs.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(place).alias("place")), "spans", size)
    twice = spans.where("n > 1").select("anchor", "span")
    whole = join_hot(runs, twice, ["anchor", "span"], "doc_key", parts_for(spans)).select("doc_key", "first", "windows")
    kinds = spans.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest"))
    mixed = spans.join(kinds.where("kinds > 1 AND rarest = 1"), "anchor")
    mixed = written(mixed.select("anchor", "place.*", "kinds", (F.col("n") == 1).alias("single")), "mixed", size)
    totals = mixed.agg(F.sum(F.col("windows") + length).alias("b"), F.count("*").alias("n")).head()
    load = totals["b"] or 0
    blocks = max(1, -(-load // block_bytes))
    large = F.col("kinds") > most_runs
    work = mixed.withColumn("block", F.when(large, F.lit(-1)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(blocks))).cast("bigint"))
    found = written(contexts(work, texts, length), "contexts", totals["n"])
    in_blocks = found.where("block >= 0").groupBy("block").applyInArrow(sorted_block(length), MARKS)
    out = whole.union(in_blocks)
    if not mixed.where(large).isEmpty():
        each = written(single_windows(found.where("block < 0"), length), "windows")
        # a run with copies counts twice: its windows are repeated in any case
        twice = each.groupBy("h1", "h2").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n")).where("n > 1").select("h1", "h2")
        out = out.union(each.where("single").join(twice, ["h1", "h2"]).select("doc_key", "first", F.lit(1).alias("windows")))
    return out


def kept_bytes(raw: bytes, first: list[int], windows: list[int], length: int) -> tuple[bytes, int]:
    """raw without the bytes that the marked windows cover, and the number of maximal runs removed."""
    delta = np.zeros(len(raw) + 1, np.int32)
    begin = np.asarray(first, np.int64)
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + np.asarray(windows, np.int64) + length - 1, -1)
    gone = np.cumsum(delta[:-1]) > 0
    edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), edges


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs without text, with kept (binary), n_bytes, n_removed, n_spans: what is left of each text's UTF-8 bytes.

    Every byte covered by a string of length bytes that also starts anywhere else (the same text included, overlaps count)
    goes; strings are judged on the input and never cross texts. Null text is empty and loses nothing, as does a text shorter
    than length. Rows that repeat are texts of their own, so all their bytes go if they are long enough. An empty table gives
    no rows. Columns of docs that have the names of the results are replaced; all others are returned. Texts are known by a
    64-bit hash of doc_id and text; equal strings within a block are compared byte by byte, whole runs by 128 bits of hashes.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), F.col("doc_id").isNull(), text_or_empty("text"))
    texts = docs.select(key.alias("doc_key"), text_or_empty("text").alias("text"))
    found = marks(texts, length, gram, block_bytes, most_runs)
    own, windows = free_name(docs, "__key"), free_name(docs, "__marks")
    spans = found.groupBy(F.col("doc_key").alias(own)).agg(F.collect_list(F.struct("first", "windows")).alias(windows))
    names = [c for c in docs.columns if c.lower() not in ("text", "kept", "n_bytes", "n_removed", "n_spans")]
    base = docs.select(*names, text_or_empty("text").cast("binary").alias("kept"), key.alias(own))
    joined = sized(base.join(spans, own, "left").select(*names, "kept", windows), docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            for some in slices(batch, "kept", 1 << 21):
                before, n_spans, after = some.column("kept").to_pylist(), [], []
                spans_of = some.column(windows).to_pylist()
                for raw, found_here in zip(before, spans_of):
                    if found_here:
                        raw, n = kept_bytes(raw, [m["first"] for m in found_here], [m["windows"] for m in found_here], length)
                    after.append(raw)
                    n_spans.append(n if found_here else 0)
                sizes = [len(x) for x in before]
                cols = [some.column(c) for c in names] + [pa.array(after, pa.binary()), pa.array(sizes, pa.int64()), pa.array([a - len(b) for a, b in zip(sizes, after)], pa.int64()), pa.array(n_spans, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return joined.mapInArrow(run, f"{schema}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def whole_characters(column: str) -> F.Column:
    """UTF-8 bytes as text without the characters of which only part is left.

    A character stands if its bytes follow each other whole; bytes are looked at as Latin-1 characters to find those.
    """
    lead2, lead3, lead4, rest = "[\u00c2-\u00df]", "[\u00e0-\u00ef]", "[\u00f0-\u00f4]", "[\u0080-\u00bf]"
    good = f"([\u0000-\u007f]+|{lead2}{rest}|{lead3}{rest}{{2}}|{lead4}{rest}{{3}})|[\u0080-\u00ff]"
    whole = F.regexp_replace(F.decode(column, "ISO-8859-1"), good, "$1")
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def digests(cut: DataFrame) -> DataFrame:
    """The report of substring_dedup without texts: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
