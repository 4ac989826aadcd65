"""Blockwise suffix sorting with a difference cover: one suffix bucket at a time, long ties by ranks of the cover's sample."""

from __future__ import annotations

import functools

import numpy as np

from siftlake.llm.shared import U64

PERIOD = 32
BUCKET = 1 << 17


@functools.cache
def cover(period: int) -> tuple[int, ...]:
    """A set of residues whose differences are all residues modulo period, found greedily."""
    chosen, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        gain = lambda x: len(missing & {d % period for c in chosen for d in (x - c, c - x)})
        best = max((x for x in range(period) if x not in chosen), key=gain)
        missing -= {d % period for c in chosen for d in (best - c, c - best)}
        chosen.append(best)
    return tuple(sorted(chosen))


@functools.cache
def shifts(period: int) -> np.ndarray:
    """For each pair of residues the least shift below period that puts both into the cover."""
    inside = set(cover(period))
    return np.array([[next(d for d in range(period) if (x + d) % period in inside and (y + d) % period in inside) for y in range(period)] for x in range(period)], np.int64)


def words8(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number, which orders as the bytes do."""
    out = np.zeros(len(at), U64)
    for k in range(8):
        out <<= U64(8)
        out |= text[at + k]
    return out


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the values of key, in 32 bits; equal values share a rank."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    step = np.zeros(len(key), bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=step[1:])
    del sorted_key
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two 32-bit ranks as one 64-bit key."""
    out = high.astype(U64)
    out <<= U64(32)
    out |= low
    return out


def prefix_ranks(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the places by their first `size` bytes, eight bytes at a time."""
    rank = dense(words8(text, at))
    for k in range(8, size, 8):
        rank = dense(paired(rank, dense(words8(text, at + k))))
    return rank


@functools.cache
def slots(period: int) -> np.ndarray:
    """For each residue the number of smaller ones in the cover."""
    inside = np.zeros(period, bool)
    inside[list(cover(period))] = True
    return np.cumsum(inside) - inside


def slot(at: np.ndarray, period: int) -> np.ndarray:
    """The number of sampled places before each of the (sampled) places."""
    return at // period * len(cover(period)) + slots(period)[at % period]


def sample_ranks(text: np.ndarray, size: int, period: int) -> np.ndarray:
    """The rank of each sampled place's suffix among those of all sampled places, in the order of the places; -1 for those in a period beyond size.

    text: size bytes and padding. Ranks double their depth by pairing a place with the sampled place one depth further on,
    until no two are equal: only then do comparisons at different shifts agree with one order.
    """
    inside = np.zeros(period, bool)
    inside[list(cover(period))] = True
    at = np.flatnonzero(np.resize(inside, size)).astype(np.int32 if size < 1 << 30 else np.int64)
    n = len(at)
    rank = np.full(n + 2 * len(cover(period)), -1, np.int32)
    rank[:n] = prefix_ranks(text, at, period)
    del at
    step = len(cover(period))  # sampled places in a period, so that a depth of whole periods is a number of places
    while n and rank[:n].max() + 1 < n:
        later = np.zeros(n, np.uint32)
        later[: max(0, n - step)] = rank[step:n] + 1
        rank[:n] = dense(paired(rank[:n], later))
        step *= 2
    return rank


def merge_ties(tied: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray, period: int) -> np.ndarray:
    """Sorts the suffixes of each group of ties by cover-sample ranks: all groups' merge sorts advance together.

    tied: starts, group after group; first, last: the bounds of each one's group. Two suffixes are compared at the shift at
    which both are sampled; the bytes before it are equal, for a group shares its first `period` bytes.
    """
    shift, here = shifts(period), np.arange(len(tied))
    place, width = here - first, 1
    longest = int((last - first).max(initial=0))
    while width < longest:
        run = place // width
        lo = first + (run ^ 1) * width
        hi = np.minimum(lo + width, last)
        start, left = lo.copy(), run % 2 == 0
        live = np.flatnonzero(lo < hi)
        lo, hi = lo.copy(), hi.copy()
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            x, y = tied[mid], tied[live]
            d = shift[x % period, y % period]
            a, b = rank[slot(x + d, period)], rank[slot(y + d, period)]
            right = (a < b) | ((a == b) & ~left[live])
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[lo[live] < hi[live]]
        moved = np.where(start < last, lo - start, 0)
        out = np.empty_like(tied)
        out[first + run // 2 * 2 * width + place - run * width + moved] = tied
        tied, width = out, width * 2
    return tied


def repeated(text: np.ndarray, starts: np.ndarray, depth: int, period: int = PERIOD, bucket: int = BUCKET) -> np.ndarray:
    """Whether the depth bytes from each start also stand at another of the starts.

    Sorts the suffixes from the starts, one bucket at a time: the suffixes whose first two bytes lie in one range, about
    `bucket` of them (more only where so many share both bytes). Memory: the ranks of the sample, and one bucket.
    """
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    size = len(text)
    padded = np.concatenate([text, np.zeros(2 * period + depth, np.uint8)])
    rank = sample_ranks(padded, size, period)
    lead = padded[starts].astype(np.uint16) << 8 | padded[starts + 1]
    upto = np.cumsum(np.bincount(lead, minlength=1 << 16))
    a = 0
    while a < 1 << 16:
        before = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + bucket, side="right")))
        if upto[b - 1] > before:
            mine = np.flatnonzero((lead >= a) & (lead < b))
            out[mine] = bucket_repeats(padded, starts[mine].astype(np.int64), depth, rank, period)
        a = b
    return out


def bucket_repeats(text: np.ndarray, at: np.ndarray, depth: int, rank: np.ndarray, period: int) -> np.ndarray:
    """repeated, of the suffixes of one bucket."""
    prefix = prefix_ranks(text, at, period)
    mine = np.argsort(prefix, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = prefix[mine[1:]] != prefix[mine[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))
    group = np.cumsum(new) - 1
    tie = (last - first)[group] > 1
    mine, group = mine[tie], group[tie]
    out = np.zeros(len(at), bool)
    if not len(mine):
        return out
    first, last = np.searchsorted(group, group, side="left"), np.searchsorted(group, group, side="right")
    tied = at[mine]
    done = merge_ties(tied.copy(), first, last, rank, period)
    same = np.flatnonzero(group[1:] == group[:-1])
    hit = np.zeros(len(done), bool)
    for p in range(0, len(same), 1 << 14):
        pair = same[p : p + (1 << 14)]
        for k in range(period, depth, 8):
            if not len(pair):
                break
            k = min(k, depth - 8)
            pair = pair[words8(text, done[pair] + k) == words8(text, done[pair + 1] + k)]
        hit[pair] = True
        hit[pair + 1] = True
    back = np.argsort(tied, kind="stable")
    out[mine[back[np.searchsorted(tied[back], done[hit])]]] = True
    return out
