"""Names, kinds and types of the relations that the engine works on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE, GIF, VIDEO, MIXED, OTHER = "image", "gif", "video", "mixed", "other"
EXACT, SIMILAR, NO_HUMANS, LOW_RESOLUTION, RANDOM_REVIEW = "exact", "similar", "no_humans", "low_resolution", "random_review"
KINDS = (EXACT, SIMILAR, NO_HUMANS, LOW_RESOLUTION, RANDOM_REVIEW)
KEEP_ONE, INDEPENDENT = "keep_one", "independent_candidates"
SMART_RULES = ("automatic", "newest", "oldest", "largest", "smallest", "shortest_path", "deselect_all", "select_candidates")
KIND_SCOPES = {"duplicates": (EXACT, SIMILAR), "review_suggestions": (LOW_RESOLUTION, RANDOM_REVIEW), "all": KINDS}

# Extensions by medium, and names that an inventory leaves out.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tif", ".tiff", ".bmp", ".raw", ".cr2", ".nef", ".arw", ".dng")
GIF_EXTENSIONS = (".gif",)
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".mts", ".m2ts", ".wmv", ".flv", ".3gp")

# Versions of stored decisions.
HUMAN_VERSION, FACE_VERSION, TILE_TAG, FRAME_TAG = "human-presence-v3-direct-seek", "face-count-v1", "t2", "v3"
PERSON, NO_PERSON, CONFIRMED, FAILED = "person_detected", "no_person_detected", "person_confirmed", "analysis_failed"

RECORD = (
    "path string, size bigint, mtime double, mtime_ns bigint, media_type string, extension string, device bigint, inode bigint, "
    "width int, height int, sha256 string, partial_hash string, phash bigint, dhash bigint, tiles array<bigint>, frames array<bigint>, "
    "duration double, human_detection_status string, human_detection_signature string, human_max_confidence double, "
    "face_count int, face_detection_signature string, error string, root string"
)
KEEP_DECISION = "path string, size bigint, mtime_ns bigint, decided_at string"
ACTION_ITEM = "struct<path: string, ok: boolean, action: string, destination: string, error: string, group_id: string, size: bigint>"
RECEIPT = f"dry_run boolean, action string, success_count int, fail_count int, log_path string, review_root string, group_dirs array<string>, session_id string, started_at string, completed_at string, log_error string, items array<{ACTION_ITEM}>"


def extensions(images: bool = True, gifs: bool = True, videos: bool = True) -> tuple[str, ...]:
    """Extensions of the media asked for; none asked for gives none."""
    return IMAGE_EXTENSIONS * images + GIF_EXTENSIONS * gifs + VIDEO_EXTENSIONS * videos


def media_type(extension: Column) -> Column:
    """The medium of a lower-case extension: gif before image before video, other for the rest and for null."""
    return F.when(extension.isin(*GIF_EXTENSIONS), GIF).when(extension.isin(*IMAGE_EXTENSIONS), IMAGE).when(extension.isin(*VIDEO_EXTENSIONS), VIDEO).otherwise(OTHER)


def policy(kind: Column) -> Column:
    return F.when(kind.isin(EXACT, SIMILAR), KEEP_ONE).otherwise(INDEPENDENT)


def kind_scope(kind: Column, scope: str | tuple[str, ...]) -> Column:
    """Whether a kind lies in a scope: one of the named ones, one kind, or a tuple of kinds."""
    wanted = KIND_SCOPES.get(scope, (scope,)) if isinstance(scope, str) else scope
    unknown = set(wanted) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return kind.isin(*wanted)


def pixels(width: Column, height: Column) -> Column:
    """Width times height, 0 where either is missing."""
    return F.coalesce(width.cast("bigint") * height.cast("bigint"), F.lit(0))


def mtime_stamp(mtime_ns: Column, mtime: Column) -> Column:
    """Nanoseconds of the last change: the exact ones if known, else the seconds' (cut off)."""
    return F.coalesce(mtime_ns, (mtime * 1e9).cast("bigint"))
