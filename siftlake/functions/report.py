"""Small functions of reports, receipts and settings."""

from __future__ import annotations

import math
import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake import schema as S

MIB, UNITS = 1024 * 1024, ("KB", "MB", "GB", "TB")


def format_bytes(n: Column) -> Column:
    """Bytes whole, larger sizes with one decimal (halves to even) on base 1024, terabytes without bound."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    chain = F.when(n < 1024, out)
    for k, unit in enumerate(UNITS, 1):
        one = F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))
        chain = chain.when(n < 1024 ** (k + 1), one) if unit != "TB" else chain.otherwise(one)
    return chain


def prune_reason(error: Column) -> Column:
    """The bucket of a validation error, by the first of these phrases that it has."""
    e = F.lower(error)
    return (
        F.when(e.contains("symbolic link"), "symlink")
        .when(e.contains("no longer exists") | e.contains("no such file"), "missing")
        .when(e.contains("outside the scanned roots"), "outside_roots")
        .when(e.contains("changed since scan"), "changed")
        .otherwise("unreadable")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(value: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", value * 100), F.lit("n/a"))


def iso_time(text: Column) -> Column:
    """A moment in ISO form; without a zone it is UTC, and what is no time is null."""
    return F.try_to_timestamp(text)


def signature(*parts: object) -> str:
    """A versioned key: parts joined by bars, numbers in their shortest form."""
    return "|".join(f"{p:g}" if isinstance(p, float) else str(p) for p in parts)


def signature_version(text: Column) -> Column:
    return F.element_at(F.split(text, r"\|"), 1)


def pixel_bound(megapixels: float) -> int:
    if not math.isfinite(megapixels) or megapixels <= 0:
        raise ValueError("a bound in megapixels must be a positive number")
    return max(1, round(megapixels * 1e6))


def preview_verdict(found: Column, expires: Column, now: Column, same: Column) -> Column:
    return F.when(~F.coalesce(found, F.lit(False)), "missing").when(now > expires, "expired").when(~F.coalesce(same, F.lit(False)), "changed").otherwise("valid")


def rate_and_eta(processed: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """Items a second, and seconds left (null at the start and when done)."""
    rate = F.when((processed > 0) & (elapsed > 0), processed / elapsed)
    return rate, F.when(processed < total, (total - processed) / rate)


def thumbnail_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)), 256)


def parse_criteria(raw: dict) -> dict:
    """Criteria of a bulk selection from a form: empty ones go, unknown ones are ignored, bad values raise ValueError."""
    out: dict = {}
    for key, least in (("min_size", 0), ("max_size", 0), ("min_faces", 1)):
        if raw.get(key) not in (None, ""):
            out[key] = int(raw[key])
            if out[key] < least:
                raise ValueError(f"{key} must be {least} or more")
    if raw.get("path_contains") not in (None, ""):
        out["path_contains"] = str(raw["path_contains"]).lower()
    return out | ({"smaller_than_keeper": True} if raw.get("smaller_than_keeper") else {})


def explanation(phash_a: Column, phash_b: Column, dhash_a: Column, dhash_b: Column) -> Column:
    """How two pictures match, in words: the distances that are known."""
    part = lambda name, a, b: F.concat(F.lit(f"{name} distance "), F.bit_count(a.bitwiseXOR(b)).cast("string"))
    return F.nullif(F.concat_ws(", ", part("pHash", phash_a, phash_b), part("dHash", dhash_a, dhash_b)), F.lit(""))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; empty for nothing known."""
    whole = F.round(seconds).cast("bigint")
    long = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.when(whole >= 3600, long).when(whole >= 0, F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)).otherwise("")


def mime_type(extension: Column) -> Column:
    """The type by extension, as the standard library knows it; application/octet-stream for others."""
    known = {e: mimetypes.guess_type("x" + e)[0] for e in S.extensions()}
    out = F.lit("application/octet-stream")
    for e, kind in known.items():
        if kind:
            out = F.when(extension == e, kind).otherwise(out)
    return out


def summary_lines(roots: list[str], files: int, counts: dict, errors: int = 0) -> str:
    """A scan in a few lines, from the row of its summary."""
    size = counts["reclaimable_bytes"]
    k = 0
    while size >= 1024 and k < len(UNITS):
        size, k = size / 1024, k + 1
    lines = [f"Roots: {', '.join(roots)}", f"Files scanned: {files}", f"Exact groups: {counts['exact_groups']}", f"Similar groups: {counts['similar_groups']}", f"Low-resolution files: {counts['low_resolution_files']}"]
    lines += [f"Random review files: {counts['random_review_files']}", f"Non-human files: {counts['no_human_files']}", "Reclaimable: " + (f"{size:.1f} {UNITS[k - 1]}" if k else f"{size} B")]
    return "\n".join(lines + ([f"Errors: {errors}"] if errors else []))
