"""64-bit codes in signed longs, as columns: distances, text forms and fingerprints of token sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from _md5 import md5  # for short tokens several times as fast as by way of OpenSSL
except ImportError:
    from hashlib import md5


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def from_hex(text: Column) -> Column:
    """The signed long with the bits of up to 16 hexadecimal digits."""
    return F.conv(text, 16, -10).cast("bigint")


def to_hex(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def tagged(codes: Column, tag: str) -> Column:
    """Codes as text: the tag, a colon, and hexadecimal codes joined by commas."""
    return F.concat(F.lit(tag + ":"), F.array_join(F.transform(codes, to_hex), ","))


def untagged(text: Column, tag: str) -> Column:
    """Codes of a text with this tag; null for any other."""
    codes = F.transform(F.split(F.substring(text, len(tag) + 2, 1 << 30), ","), from_hex)
    return F.when(text.startswith(tag + ":"), codes)


def distances(a: Column, b: Column) -> Column:
    """Distances of two arrays place by place; null where either is missing or their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, hamming))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(values)


def tiles_agree(a: Column, b: Column, most: int = 8, mean_most: float = 5.0) -> Column:
    """Whether regional codes agree; missing codes do not."""
    d = distances(a, b)
    return F.coalesce((F.array_max(d) <= most) & (mean(d) <= mean_most), F.lit(False))


def aligned(a: Column, b: Column) -> Column:
    """Distances of two ordered code sequences, the longer one sampled evenly (halves to even); null where either is empty."""
    n = F.least(F.size(a), F.size(b))

    def pick(codes: Column, k: Column) -> Column:
        place = F.when(n == 1, F.lit(0)).otherwise(F.bround(k * (F.size(codes) - 1) / F.greatest(n - 1, F.lit(1)))).cast("int")
        return F.element_at(codes, place + 1)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: hamming(pick(a, k), pick(b, k))))


def sequences_agree(a: Column, b: Column, threshold: int = 8) -> Column:
    """Whether ordered codes agree: mean at most the threshold, each at most max(4, twice it), first and last looked at first."""
    d, cap = aligned(a, b), max(4, 2 * threshold)
    ends = (hamming(F.element_at(a, 1), F.element_at(b, 1)) <= cap) & (hamming(F.element_at(a, -1), F.element_at(b, -1)) <= cap)
    return F.coalesce(ends & (F.array_max(d) <= cap) & (mean(d) <= threshold), F.lit(False))


def sample_times(duration: Column, most: int = 8) -> Column:
    """Evenly spread times: at least 3, one for each whole second and one more, at most `most`."""
    n = F.least(F.lit(most), F.greatest(F.lit(3), F.least(F.lit(most), duration.cast("int") + 1)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * duration / n)


def simhash(rows: DataFrame, keys: list[str], tokens: str = "tokens", out: str = "code") -> DataFrame:
    """One code for each row with tokens (an array), known by keys: bit b is set if more than half of its distinct tokens' md5 codes have it.

    A row's tokens are made distinct in place and summed before the shuffle, which then moves one row for each. Counts of two
    bits share a long, so 32 sums of a hash aggregation are all the state there is. Rows without tokens have no code.
    """
    lanes = F.lit(0x0000000100000001)
    each = rows.select(*keys, F.explode(F.array_distinct(tokens)).alias("__t"))
    marked = each.select(*keys, from_hex(F.substring(F.md5("__t"), 1, 16)).alias("__h"))
    sums = [F.sum(F.shiftrightunsigned("__h", b).bitwiseAND(lanes)).alias(f"__{b}") for b in range(32)]
    counted = marked.groupBy(*keys).agg(F.count("*").alias("__n"), *sums)
    low = lambda b: F.col(f"__{b}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda b: F.shiftrightunsigned(f"__{b}", 32)
    code = F.lit(0).cast("bigint")
    for b in range(64):
        count = low(b) if b < 32 else high(b - 32)
        code = code.bitwiseOR(F.when(2 * count > F.col("__n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return counted.select(*keys, code.alias(out))


#: Bytes of text whose tokens are held at once, unless one row has more; tokens that are summed at once.
SLICE_BYTES, SUM_TOKENS = 2 << 20, 1 << 15


def md5_codes(tokens: pa.Array) -> np.ndarray:
    """The first 8 bytes of each token's md5, as numbers."""
    return np.frombuffer(b"".join([md5(t).digest() for t in tokens.cast(pa.large_binary()).to_pylist()]), ">u8")[::2].astype(np.uint64)


def majority(owner: np.ndarray, token: np.ndarray, hashes: np.ndarray, owners: int) -> np.ma.MaskedArray:
    """For each owner the code of its distinct tokens (places in hashes), as simhash has it; masked where it has none."""
    pairs = np.unique(owner.astype(np.int64) * max(1, len(hashes)) + token)
    owner, token = np.divmod(pairs, max(1, len(hashes)))
    lanes = (hashes[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(0x0001000100010001)
    counts = np.zeros((owners, 64), np.int64)
    for at in range(0, len(owner), SUM_TOKENS):  # no count of so many tokens leaves its 16 bits
        own = owner[at : at + SUM_TOKENS]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums = np.add.reduceat(lanes[token[at : at + SUM_TOKENS]], starts, axis=0)
        for k in range(4):
            counts[own[starts], 16 * k : 16 * k + 16] += ((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
    n = np.bincount(owner, minlength=owners)
    code = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<i8").ravel()
    return np.ma.array(code.astype(np.int64), mask=n == 0)


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts that single spaces separate: each one's text and place among the distinct words, and these."""
    words = pc.split_pattern(texts, " ")
    flat = words.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    return owner[there], coded.indices.to_numpy()[there], coded.dictionary


def word_codes(texts: pa.Array) -> np.ma.MaskedArray:
    """simhash of the words of texts, separated by spaces."""
    owner, word, words = word_places(texts)
    return majority(owner, word, md5_codes(words), len(texts))


def pair_codes(texts: pa.Array) -> np.ma.MaskedArray:
    """simhash of the pairs of neighbouring words, a space between."""
    owner, word, words = word_places(texts)
    inside = owner[1:] == owner[:-1]
    both, place = np.unique(word[:-1][inside].astype(np.int64) * max(1, len(words)) + word[1:][inside], return_inverse=True)
    a, b = np.divmod(both, max(1, len(words)))
    joined = pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), pa.scalar(" ", words.type))
    return majority(owner[1:][inside], place, md5_codes(joined), len(texts))


def text_codes(rows: DataFrame, keys: list[str], words: list[str], pairs: list[str]) -> DataFrame:
    """keys, and the columns of words and pairs (words separated by spaces) as codes of their words and of their pairs of neighbours.

    As simhash, but each row is by itself: nothing is shuffled, and distinct words are hashed once for a slice of rows.
    """
    kind = {c: word_codes for c in words} | {c: pair_codes for c in pairs}
    kept = rows.select(*keys).schema

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in kind)
            part = np.cumsum(sizes) // SLICE_BYTES
            for at, end in zip(starts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]), [*starts[1:], len(part)]):
                piece = batch.slice(at, end - at)
                out = [kind[c](pc.fill_null(piece.column(c), "").cast(pa.large_string())) for c in kind]
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keys), *(pa.array(x.data, mask=np.ma.getmaskarray(x)) for x in out)], names=[*keys, *kind])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` bigint" for c in kind)])
    return rows.select(*keys, *kind).mapInArrow(codes, fields)
