"""Widths and heights from the headers of pictures, without a decoder."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First bytes of a file that are looked at; what stands behind them (a JPEG's or TIFF's size) is sought.
HEAD = 1 << 12


def dimensions_of(f: BinaryIO) -> tuple[int, int] | None:
    """Width and height of a picture from its headers, wherever in the file they stand; None for other files or broken headers."""
    head = f.read(HEAD)
    try:
        if head[:2] == b"\xff\xd8":
            at = 2
            while True:
                f.seek(at)
                mark = f.read(9)
                if len(mark) < 9:
                    return None
                if mark[0] != 0xFF or mark[1] == 0xFF:
                    at += 1
                elif mark[1] == 0x01 or 0xD0 <= mark[1] <= 0xD8:
                    at += 2
                elif 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", mark[5:9])
                    return w, h
                else:
                    at += 2 + struct.unpack(">H", mark[2:4])[0]
        if head[:4] in (b"II*\0", b"MM\0*"):
            return tiff(f, "<" if head[:1] == b"I" else ">", head)
        if head[4:8] == b"ftyp":
            return boxes(f)
    except struct.error:
        return None
    return fixed_header(head)


def dimensions(raw: bytes) -> tuple[int, int] | None:
    """dimensions_of a file in memory."""
    return dimensions_of(io.BytesIO(raw))


def tiff(f: BinaryIO, order: str, head: bytes) -> tuple[int, int] | None:
    """The size in a TIFF's first directory."""
    f.seek(struct.unpack(order + "I", head[4:8])[0])
    entries = f.read(12 * struct.unpack(order + "H", f.read(2))[0])
    found = {}
    for k in range(0, len(entries) - 11, 12):
        tag, kind = struct.unpack(order + "HH", entries[k : k + 4])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entries[k + 8 : k + (10 if kind == 3 else 12)])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def boxes(f: BinaryIO) -> tuple[int, int] | None:
    """The largest size that the meta box of a HEIF file tells."""
    at = 0
    while True:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        if size == 1:
            size = struct.unpack(">Q", f.read(8))[0]
        if kind == b"meta":
            body = f.read(size)
            found = [struct.unpack(">II", body[m.end() + 4 : m.end() + 12]) for m in re.finditer(b"ispe", body)]
            return max(found, key=lambda x: x[0] * x[1], default=None)
        if size < 8:
            return None
        at += size


def fixed_header(head: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or WebP from its first bytes; None for anything else or a cut header."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            if head[12:16] == b"VP8X":
                return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
            if head[12:16] == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", head[26:30])
            return w & 0x3FFF, h & 0x3FFF
    except struct.error:
        pass
    return None


def with_dimensions(records: DataFrame) -> DataFrame:
    """records (path, width, height, error) with sizes where they were missing; only those files' heads are read, where the tasks run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                found, problem = None, None
                try:
                    with open(path, "rb") as f:
                        found = dimensions_of(f)
                    problem = None if found else "dimensions: unknown format"
                except OSError as e:
                    problem = f"dimensions: {e}"
                rows.append((path, *(found or (None, None)), problem))
            out = pd.DataFrame(rows, columns=["path", "w", "h", "problem"])
            yield out.astype({"w": "Int64", "h": "Int64"})

    missing = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0)) == 0
    found = records.where(missing).select("path").distinct().mapInPandas(run, "path string, w bigint, h bigint, problem string")
    out = records.join(found, "path", "left")
    return out.withColumns({"width": F.coalesce(F.col("w").cast("int"), "width"), "height": F.coalesce(F.col("h").cast("int"), "height"), "error": F.coalesce("problem", "error")}).drop("w", "h", "problem")
