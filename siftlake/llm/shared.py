"""What the operators of this subpackage share: written tables, Arrow helpers and text hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.storage import new_path
from siftlake.storage import settled as written

__all__ = ["new_path", "written"]
U64 = np.uint64


#: Bytes of an Arrow batch on its way to Python, about.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and BATCH_BYTES, unless the session has chosen: texts are long, and a batch is held on both sides."""
    chosen = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
        "spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", f"{BATCH_BYTES}b"),
    }
    for key, (default, less) in chosen.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, less)


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the machine: workers live on, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if free:
        free(0)


#: What drops the tables that an operator keeps in a worker from task to task, by operator.
_kept: dict[str, Callable[[], None]] = {}
#: Bytes from which malloc takes memory by itself and gives it back at once (M_MMAP_THRESHOLD, by default up to 32 MiB).
LARGE, M_MMAP_THRESHOLD = 4 << 20, -3


def enter(operator: str, drop: Callable[[], None] | None = None) -> None:
    """A task of the operator begins in this worker: what others keep here goes, since workers live on over stages."""
    others = [k for k in _kept if k != operator]
    for k in others:
        _kept.pop(k)()
    if drop:
        _kept[operator] = drop
    limit = getattr(ctypes.CDLL(None), "mallopt", None)
    if limit:
        limit(M_MMAP_THRESHOLD, LARGE)
    if others:
        trim()


#: Rows of texts that a task of a result holds at least.
TEXT_ROWS = 10_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than rows of texts are worth: a file for each TEXT_ROWS of them, and 4 at least."""
    return df.coalesce(max(4, -(-rows // TEXT_ROWS)))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of one row for each value of key: the one with the least hash of them (maps are not hashed)."""
    quoted = [f"`{c}`" for c in columns]
    hashed = [f"`{f.name}`" for f in df.schema if f.name in columns and "map<" not in f.dataType.simpleString()]
    best = df.groupBy(key).agg(F.min_by(F.struct(*quoted), F.xxhash64(*hashed)).alias("row"))
    return best.select(*(F.col("row").getField(c).alias(c) for c in columns))


def tables_dir(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows of batch with about most bytes in the string or binary column; a longer value stands alone."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    ends = bounds(values)[1:]
    start, base = 0, bounds(values)[0]
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, ends[stop - 1]


def bounds(values: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array's values in its data buffer, one more than it has values."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    raw = values.buffers()[1]
    if raw is None:
        return np.zeros(len(values) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(raw, kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values on end, and their bounds from 0. Nulls must have been replaced."""
    at = bounds(values)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
TILE = 1 << 19


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** j and base ** -j modulo 2 ** 64 for j up to a tile."""
    if base not in _powers:
        inverse = pow(base, -1, 1 << 64)
        _powers[base] = tuple(np.concatenate([[U64(1)], np.cumprod(np.full(TILE + 512, x, U64))]) for x in (base, inverse))
    return _powers[base]


BASE_A, BASE_B = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def prefix_sums(raw: np.ndarray, base: int) -> np.ndarray:
    """Sums of (byte + 1) * base ** j before each position of a tile of at most TILE + 512 bytes."""
    up, _ = powers(base)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """A 64-bit hash of raw[start:stop] for each span, equal for equal bytes. Spans are ascending by start.

    Works tile by tile; a span longer than a tile is hashed in pieces by its own content.
    """
    out = np.zeros(len(starts), U64)
    _, down = powers(base)
    k = 0
    while k < len(starts):
        origin = int(starts[k])
        stop = k + max(1, int(np.searchsorted(starts[k:], origin + TILE // 2)))
        long = np.flatnonzero(stops[k:stop] > origin + TILE)
        if len(long):
            stop = k + int(long[0])
        if stop == k:
            whole = raw[origin : int(stops[k])]
            h = U64(0)
            for p in range(0, len(whole), TILE):
                part = whole[p : p + TILE]
                h = mix(h ^ prefix_sums(part, base)[-1:])[0]
            out[k] = h ^ U64(len(whole))
            k += 1
            continue
        tile = raw[origin : int(stops[k:stop].max(initial=origin))]
        sums = prefix_sums(tile, base)
        a, b = starts[k:stop] - origin, stops[k:stop] - origin
        out[k:stop] = mix((sums[b] - sums[a]) * down[a]) ^ (b - a).astype(U64)
        k = stop
    return out


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the runs without white space [\\x20\\x09-\\x0D] in each text, and the number of words before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~SPACES[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, at)
