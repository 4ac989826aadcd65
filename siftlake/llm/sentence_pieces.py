"""SentencePiece encoding and decoding in batched numpy.

Texts are cut into words where no piece of the vocabulary spans: before white-space marks, and between letters and others. Words of equal length
advance together: for each end place, the hashes of the substrings that end there (from prefix sums) probe the sorted keys of
the pieces, the best score over all starts is one vectorised maximum, and its argument is the backpointer (Viterbi).

The scores of a vocabulary learnt by pair merging are merge ranks. The best-scoring path over them is not the path that
merging takes, which is what that tokenizer returns, so for such a vocabulary ids follow the merges: in each round the pair of
neighbours with the best score over a word is joined, again for all words of a length at once and by the same probes.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import BASE_A, U64, mix, slices, small_batches, text_or_empty

SPACE = "▁"
#: Words that a task remembers; cells of the matrices that one batch of words of a length may fill.
MOST_WORDS, MOST_CELLS = 700_000, 1 << 18
#: Words beyond this length are coded one by one.
LONG = 4000
UNKNOWN_PENALTY = 10.0
#: Sorted keys are entered at the first one with the same leading bits.
LEAD_BITS = 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_models: dict[str, "Pieces"] = {}


def codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def cutter(pieces: list[str]) -> re.Pattern:
    """Cuts a text where no piece spans: before white-space marks, and between letters and other characters.

    Letters that a piece joins with another character (but a mark before them) do not count as letters.
    """
    letter = re.compile(r"[^\W\d_]")
    mixed = {c for p in pieces if len(p) > 1 for c, d in [*zip(p, p[1:]), *zip(p[1:], p)] if letter.match(c) and not letter.match(d) and d != SPACE}
    odd = "".join(map(re.escape, sorted(mixed)))
    joined = {c for p in pieces for c, d in [*zip(p, p[1:]), *zip(p[1:], p)] if c not in mixed and letter.match(c) and d in mixed}
    if joined:  # then such letters would have to count as others too, and so on: cut at marks alone
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*[^\\W\\d_{odd}]+|{SPACE}*(?:[^\\w{SPACE}]+|[\\d_{odd}]+)+|{SPACE}+")


class Pieces:
    """A vocabulary file: sorted hashes of its pieces, their scores and bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only vocabularies that keep texts as they are can be used")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.by_merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        named = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        if any(SPACE in piece.lstrip(SPACE) for _, piece, _ in named):
            raise ValueError("a piece spans words")
        self.longest = max(len(piece) for _, piece, _ in named)
        self.cut = cutter([piece for _, piece, _ in named])
        self.grow(4096)
        self.piece = {piece: (score, i) for i, piece, score in named}
        keys, ids, values = [], [], []
        for size, group in itertools.groupby(sorted(named, key=lambda x: len(x[1])), key=lambda x: len(x[1])):
            group = list(group)
            sums = self.sums(codes([piece for _, piece, _ in group]))
            keys.append(self.key(sums, 0, size))
            ids += [i for i, _, _ in group]
            values += [s for _, _, s in group]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids, np.int32)[order], np.array(values, np.float64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        lead = (self.keys >> U64(64 - LEAD_BITS)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange(1 << LEAD_BITS)).astype(np.int32)
        self.steps = int(np.bincount(lead).max())
        self.keys, self.scores, self.ids = np.append(self.keys, ~U64(0)), np.append(self.scores, -np.inf), np.append(self.ids, -1)
        real = [s for i, _, s in named if s > -1e8]
        self.unknown_score = min(real) - UNKNOWN_PENALTY
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNKNOWN) else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.known: dict[str, dict[str, bytes]] = {"viterbi": {}, "merges": {}}

    @classmethod
    def at(cls, path: str) -> "Pieces":
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def grow(self, size: int) -> None:
        """Tables of powers for words of this length."""
        self.up = np.concatenate([[U64(1)], np.cumprod(np.full(size, BASE_A, U64))])
        self.down = np.concatenate([[U64(1)], np.cumprod(np.full(size, pow(BASE_A, -1, 1 << 64), U64))])

    def sums(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros((grid.shape[0], grid.shape[1] + 1), U64)
        np.cumsum((grid.astype(U64) + U64(1)) * self.up[: grid.shape[1]], axis=1, out=out[:, 1:])
        return out

    def key(self, sums: np.ndarray, a, b) -> np.ndarray:
        """Hashes of the substrings [a, b) of each row; a and b are places or a row of places for each row."""
        if np.ndim(a) == 0:
            return mix((sums[:, b] - sums[:, a]) * self.down[a]) ^ U64(b - a)
        got = np.take_along_axis(sums, b, 1) - np.take_along_axis(sums, a, 1)
        return mix(got * self.down[a]) ^ (b - a).astype(U64)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (minus infinity: no piece) and places among the sorted keys."""
        at = self.first[(keys >> U64(64 - LEAD_BITS)).astype(np.int64)]
        for _ in range(self.steps):  # from the first key with these leading bits
            at = at + (self.keys[at] < keys)
        return np.where(self.keys[at] == keys, self.scores[at], -np.inf), at

    def viterbi(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length: which places start a piece of the best path, and the id at those (-1: unknown)."""
        n, size = grid.shape
        sums = self.sums(grid)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        rows = np.arange(n)
        for b in range(1, size + 1):
            starts = range(max(0, b - self.longest), b)  # the longest first, which wins ties
            scores, at = self.probe(np.stack([self.key(sums, a, b) for a in starts], axis=1))
            ids = np.where(np.isfinite(scores), self.ids[at], -1)
            scores[:, -1] = np.where(np.isfinite(scores[:, -1]), scores[:, -1], self.unknown_score)
            total = best[:, starts.start : b] + scores
            pick = total.argmax(axis=1)
            best[:, b], back[:, b], piece[:, b] = total[rows, pick], pick + starts.start, ids[rows, pick]
        begins, ids = np.zeros((n, size), bool), np.full((n, size), -1, np.int64)
        place = np.full(n, size)
        live = rows
        while len(live):
            a = back[live, place[live]]
            begins[live, a], ids[live, a] = True, piece[live, place[live]]
            place[live] = a
            live = live[a > 0]
        return begins, ids

    def merges(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As viterbi, but by joining the best-scoring pair of neighbours (the first of equals) until no pair is a piece."""
        n, size = grid.shape
        sums = self.sums(grid)
        bounds = np.tile(np.arange(size + 1), (n, 1))  # of the symbols; filled up with `size`
        count = np.full(n, size)
        live = np.arange(n) if size > 1 else np.arange(0)
        pair = np.full((n, max(1, size - 1)), -np.inf)
        if size > 1:
            pair = self.probe(self.key(sums, bounds[:, :-2], bounds[:, 2:]))[0]
        while len(live):
            pick = pair[live].argmax(axis=1)
            can = np.isfinite(pair[live, pick])
            live, pick = live[can], pick[can]
            if not len(live):
                break
            columns = np.arange(size + 1)[None, :]
            bounds[live] = np.take_along_axis(np.hstack([bounds[live], np.full((len(live), 1), size)]), columns + (columns > pick[:, None]), 1)
            count[live] -= 1
            here = np.arange(size - 1)[None, :]
            # pairs after the joined one move up by one; the two that touch it are probed again
            kept = np.hstack([pair[live], np.full((len(live), 2), -np.inf)])
            pair[live] = np.take_along_axis(kept, here + (here >= pick[:, None]), 1)
            for k in (pick - 1, pick):
                ok = np.flatnonzero((k >= 0) & (k + 2 <= count[live]))
                r, c = live[ok], k[ok]
                if len(r):
                    ends = np.minimum(c + 2, size)
                    pair[r, c] = self.probe(self.key(sums[r], bounds[r, c][:, None], bounds[r, ends][:, None])[:, 0])[0]
            past = np.flatnonzero(pick < size - 1)
            edge = live[past]
            spare = count[edge] - 1
            inside = spare < size - 1
            pair[edge[inside], np.maximum(spare[inside], 0)] = -np.inf
        begins, ids = np.zeros((n, size), bool), np.full((n, size), -1, np.int64)
        row, k = np.nonzero(np.arange(size)[None, :] < count[:, None])
        a, b = bounds[row, k], bounds[row, k + 1]
        begins[row, a] = True
        for p in range(0, len(row), 1 << 16):
            some = slice(p, p + (1 << 16))
            scores, at = self.probe(self.key(sums[row[some]], a[some][:, None], b[some][:, None])[:, 0])
            ids[row[some], a[some]] = np.where(np.isfinite(scores), self.ids[at], -1)
        return begins, ids

    def merges_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """merges of one word, by a heap of pairs: n log n in its length."""
        size = len(word)
        end, before, heap = list(range(1, size + 1)), list(range(-1, size - 1)), []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < size:
                stop = end[end[a]]
                got = self.piece.get(word[a:stop]) if stop - a <= self.longest else None
                if got:
                    heapq.heappush(heap, (-got[0], a, end[a], stop))

        for a in range(size):
            offer(a)
        while heap:
            _, a, middle, stop = heapq.heappop(heap)
            if end[a] == middle and end[middle] == stop:  # else one of the two has been joined since
                end[a], end[middle] = stop, -1
                if stop < size:
                    before[stop] = a
                offer(before[a])
                offer(a)
        begins, ids, a = np.zeros((1, size), bool), np.full((1, size), -1, np.int64), 0
        while a < size:
            begins[0, a], ids[0, a] = True, self.piece.get(word[a : end[a]], (0, -1))[1]
            a = end[a]
        return begins, ids

    def learn(self, words: list[str], method: str) -> None:
        known = self.known[method]
        words.sort(key=len)
        for size, group in itertools.groupby(words, key=len):
            group = list(group)
            step = max(1, MOST_CELLS // ((size + 1) * min(size, self.longest)))
            if size >= len(self.up):
                self.grow(size)
            if size > LONG:
                step = 1
            for p in range(0, len(group), step):
                some = group[p : p + step]
                grid = codes(some)
                begins, ids = self.merges_long(some[0]) if size > LONG and method == "merges" else getattr(self, method)(grid)
                odd = (begins & (ids < 0)).any(axis=1)
                counts = begins.sum(axis=1)
                raw, at = ids[begins].astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
                known.update((w, raw[a:b]) for w, a, b in zip(some, [0, *at], at))
                for r in np.flatnonzero(odd).tolist():
                    w, out = some[r], []
                    cuts = [*np.flatnonzero(begins[r]).tolist(), size]
                    for a, b in zip(cuts, cuts[1:]):
                        out += [int(ids[r, a])] if ids[r, a] >= 0 else self.byte_ids[list(w[a:b].encode("utf-8", "replace"))].tolist()
                    known[w] = np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str], method: str | None = None) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self.encode_by(texts, (method,))[0]

    def encode_by(self, texts: list[str], methods: tuple[str | None, ...]) -> list[list[bytes]]:
        """encode by each method; texts are cut, and their words looked up, once."""
        own = [m or ("merges" if self.by_merges else "viterbi") for m in methods]
        cut = [self.cut.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        asked = set(itertools.chain.from_iterable(cut))
        for m in dict.fromkeys(own):
            known = self.known[m]
            new = asked - known.keys()
            if len(known) + len(new) > MOST_WORDS:
                known.clear()
                new = asked
            if new:
                self.learn(list(new), m)
        return [[b"".join(map(self.known[m].__getitem__, c)) for c in cut] for m in own]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.raw[np.arange(int(ends[-1])) - np.repeat(ends[:-1], sizes) + np.repeat(self.raw_at[ids], sizes)].tobytes()
        out = [raw[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in out]


def encoded(docs: DataFrame, model: str, methods: tuple[str | None, ...] = (None,), with_ids: bool = True) -> DataFrame:
    """doc_id and, for each method, n_tokens, ids (little-endian 32-bit; null if not with_ids), ids_crc32, round_trip.

    methods: None (the vocabulary's own way), "viterbi" or "merges"; a second and later one's columns start with its name.
    round_trip tells whether the ids decode to the text. Null text is empty and has no ids. A white-space mark
    U+2581 in a text decodes to a space, so such a text does not come back whole. Repeated rows get equal results; an empty
    table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    heads = ["" if k == 0 else f"{m}_" for k, m in enumerate(methods)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(model)
        gc.disable()  # the caches hold no cycles, and looking for some takes a third of the time
        for batch in batches:
            for some in slices(batch, "text", 1 << 22):
                texts, cols, names = some.column("text").to_pylist(), [some.column("doc_id")], ["doc_id"]
                for head, raw in zip(heads, pieces.encode_by(texts, methods)):
                    sizes = [len(x) // 4 for x in raw]
                    back = pieces.decode(np.frombuffer(b"".join(raw), "<i4"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                    cols += [pa.array(sizes, pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([a == b for a, b in zip(texts, back)], pa.bool_())]
                    names += [f"{head}n_tokens", f"{head}ids", f"{head}ids_crc32", f"{head}round_trip"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint" + "".join(f", {h}n_tokens bigint, {h}ids binary, {h}ids_crc32 bigint, {h}round_trip boolean" for h in heads)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, schema)
