"""Perceptual codes of grey pixel arrays in numpy; decoding files is left to a plug-in that makes such arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the cells of a grid, fractions of pixels weighted."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = np.maximum(edges[:-1, None], np.arange(n)[None, :]), np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :])
        w = np.maximum(hi - lo, 0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(pixels.shape[0], height) @ pixels.astype(np.float64) @ weights(pixels.shape[1], width).T


def packed(bits: np.ndarray) -> int:
    """64 bits, the first the highest, as a signed long."""
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">i8")[0])


def phash(pixels: np.ndarray) -> int:
    """Signs against the median of the lowest 8 x 8 cosine coefficients of a 32 x 32 picture."""
    c = _cosines(32)
    low = (c @ resized(pixels, 32, 32) @ c.T)[:8, :8]
    return packed(low > np.median(low))


def dhash(pixels: np.ndarray) -> int:
    """Whether brightness grows from column to column of an 8 x 9 picture."""
    small = resized(pixels, 8, 9)
    return packed(small[:, 1:] > small[:, :-1])


def tile_codes(pixels: np.ndarray, side: int = 256) -> list[int]:
    """Codes of the quarters and the middle of the picture, fitted into a square with black margins."""
    h, w = pixels.shape
    scale = side / max(h, w)
    inner = resized(pixels, max(1, round(h * scale)), max(1, round(w * scale)))
    canvas = np.zeros((side, side))
    top, left = (side - inner.shape[0]) // 2, (side - inner.shape[1]) // 2
    canvas[top : top + inner.shape[0], left : left + inner.shape[1]] = inner
    half, quarter = side // 2, side // 4
    return [phash(canvas[a : a + half, b : b + half]) for a, b in ((0, 0), (0, half), (half, 0), (half, half), (quarter, quarter))]


def combined(codes: list[int]) -> int:
    """Codes of an animation's frames in one: their exclusive or."""
    out = 0
    for c in codes:
        out ^= c
    return out


def frames_sampled(n: int) -> list[int]:
    """Of an animation of n frames the first, the middle and the last."""
    return sorted({0, n // 2, n - 1}) if n else []


Decoder = Callable[[str], "list[np.ndarray]"]


def with_codes(records: DataFrame, decode: Decoder, whole: int = 3) -> DataFrame:
    """path, phash, dhash, tiles, frames, error of the records, by a plug-in that gives a path's grey frames.

    Fewer frames than `whole` make the frame sequence null (a video that was decoded in part must not match); an error leaves
    all null and is told.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    frames = decode(path)
                    codes = [phash(f) for f in frames]
                    rows.append((path, combined(codes), combined([dhash(f) for f in frames]), tile_codes(frames[0]), codes if len(codes) >= whole else None, None))
                except Exception as e:  # a plug-in's fault is a row's, not the job's
                    rows.append((path, None, None, None, None, f"image hash: {e}"))
            yield pd.DataFrame(rows, columns=["path", "phash", "dhash", "tiles", "frames", "error"]).astype({"phash": "Int64", "dhash": "Int64"})

    return records.select("path").mapInPandas(run, "path string, phash bigint, dhash bigint, tiles array<bigint>, frames array<bigint>, error string")
