"""Small durable stores as JSON, and receipts as a relation."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.paths import name, stem

MOST_DECISION_BYTES, MOST_SESSION_BYTES = 16 << 20, 64 << 20


@contextmanager
def replaced(path: str) -> Iterator[TextIO]:
    """A file to write that takes the place of another at once, readable by its owner only; after an error nothing has changed."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w") as f:
            yield f
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_json(path: str, value: object) -> None:
    with replaced(path) as f:
        json.dump(value, f, ensure_ascii=False)


def _read(path: str, most: int) -> object:
    if os.path.getsize(path) > most:
        raise ValueError("too large")
    with open(path) as f:
        return json.load(f)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """KEEP_DECISION rows; a file that is missing, too large, of another version or broken has none."""
    try:
        stored = _read(path, MOST_DECISION_BYTES)
        rows = [(p, d.get("size"), d.get("mtime_ns"), d.get("decided_at")) for p, d in stored["decisions"].items()] if stored.get("version") == 1 else []
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        rows = []
    return spark.createDataFrame(rows, S.KEEP_DECISION)


def save_decisions(decisions: DataFrame, path: str) -> None:
    """Stores all decisions of one reviewer, streamed to the file. What load_decisions would not read again is refused."""
    with replaced(path) as f:
        f.write('{"version": 1, "decisions": {')
        for k, r in enumerate(decisions.toLocalIterator()):
            f.write(", " * (k > 0) + json.dumps(r["path"], ensure_ascii=False) + ": " + json.dumps({"size": r["size"], "mtime_ns": r["mtime_ns"], "decided_at": r["decided_at"]}))
            if f.tell() > MOST_DECISION_BYTES:
                raise ValueError(f"more decisions than a file of {MOST_DECISION_BYTES} bytes holds")
        f.write("}}")


def merged_decisions(old: DataFrame, kept: DataFrame, cleared: DataFrame) -> DataFrame:
    """old with kept in place of the same paths' and without the cleared paths."""
    gone = kept.select("path").union(cleared.select("path")).distinct()
    return old.join(gone, "path", "left_anti").unionByName(kept)


def save_session(path: str, result: dict) -> None:
    write_json(path, {"version": 1, "saved_at": datetime.now(timezone.utc).isoformat(), "result": result})


def load_session(path: str) -> tuple[dict | None, str | None]:
    """The stored session, and what is wrong with the file if it cannot be used; a broken file stays as it is."""
    try:
        stored = _read(path, MOST_SESSION_BYTES)
        if not isinstance(stored, dict) or stored.get("version") != 1 or not isinstance(stored.get("result"), dict):
            return None, "unknown form"
        return stored, None
    except FileNotFoundError:
        return None, None
    except (OSError, ValueError) as e:
        return None, str(e)


def discard_session(path: str) -> bool:
    try:
        os.unlink(path)
        return True
    except FileNotFoundError:
        return False


def write_receipt(folder: str, receipt: dict, stamp: str) -> str:
    """Stores a receipt; previews and actions have names of their own."""
    path = os.path.join(folder, f"{'preview' if receipt.get('dry_run') else 'action'}-{stamp}-{str(receipt.get('session_id', ''))[:8]}.json")
    write_json(path, receipt | {"log_path": path})
    return path


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts of a folder with id (the file's stem), receipt_bytes and started (a timestamp, UTC without a zone); broken files are left out."""
    raw = spark.read.schema(S.RECEIPT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    own = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("receipt_bytes"))
    own = own.where("_corrupt_record IS NULL AND action IS NOT NULL").drop("_corrupt_record")
    out = own.withColumns({"id": stem(F.col("__file")), "log_path": F.coalesce("log_path", "__file"), "started": F.try_to_timestamp("started_at"), "file": name(F.col("__file"))})
    return out.drop("__file")


def list_receipts(receipts: DataFrame, previews: bool = True, actions: tuple[str, ...] = (), undoable_only: bool = False, limit: int = 0) -> DataFrame:
    """Receipts newest first; limit 0 gives all."""
    undo = ~F.col("dry_run") & (F.col("action") == "quarantine") & F.exists("items", lambda x: x["ok"] & x["destination"].isNotNull())
    out = receipts if previews else receipts.where("NOT dry_run")
    out = out.where(F.col("action").isin(*actions)) if actions else out
    out = out.where(F.coalesce(undo, F.lit(False))) if undoable_only else out
    out = out.orderBy(F.coalesce(F.col("started_at").cast("string"), "id").desc(), F.col("id").desc())
    return out.limit(limit) if limit else out


def load_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Labelled items ("items": path, has_person) or pairs ("pairs": path_a, path_b, similar); paths are relative to the file."""
    with open(path) as f:
        stored = json.load(f)
    rows = stored if isinstance(stored, list) else stored.get(kind)
    if not isinstance(rows, list):
        raise ValueError(f"the manifest has no list of {kind}")
    base = os.path.dirname(os.path.abspath(path))
    whole = lambda p: os.path.normpath(os.path.join(base, p))
    label, paths = ("has_person", ["path"]) if kind == "items" else ("similar", ["path_a", "path_b"])
    for r in rows:
        if not isinstance(r.get(label), bool) or not all(isinstance(r.get(p), str) and r[p] for p in paths):
            raise ValueError(f"an entry needs {', '.join(paths)} and a true or false {label}: {r}")
    return spark.createDataFrame([(*(whole(r[p]) for p in paths), r[label]) for r in rows], ", ".join(f"{p} string" for p in paths) + f", {label} boolean")


def save_result(path: str, roots: list[str], records: DataFrame, members: DataFrame, errors: list[str] = []) -> None:
    """A scan's result as one JSON file: roots, files, groups with their members, counts and errors; rows are streamed to it."""
    members_of = F.sort_array(F.collect_list(F.struct("ord", "path", "size", "is_keep", "is_selected", "is_reviewed")))
    groups = members.groupBy("group_ord", "group_id", "kind").agg(members_of.alias("members")).orderBy("group_ord")
    files, found = 0, 0
    with replaced(path) as f:
        f.write(f'{{"version": 1, "roots": {json.dumps(roots)}, "errors": {json.dumps(errors)}, "files": [')
        for files, r in enumerate(records.select(F.to_json(F.struct("*"))).toLocalIterator(), 1):
            f.write(",\n" * (files > 1) + r[0])
        f.write('], "groups": [')
        for found, r in enumerate(groups.select(F.to_json(F.struct(F.col("group_id").alias("id"), "kind", "members"))).toLocalIterator(), 1):
            f.write(",\n" * (found > 1) + r[0])
        f.write(f'], "file_count": {files}, "group_count": {found}}}')


def load_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """records and members (group_id, kind, group_ord, ord, path, flags and record columns) of a stored result."""
    member = "struct<ord: bigint, path: string, size: bigint, is_keep: boolean, is_selected: boolean, is_reviewed: boolean>"
    shape = f"files array<struct<{', '.join(c.replace(' ', ': ', 1) for c in S.RECORD.split(', '))}>>, groups array<struct<id: string, kind: string, members: array<{member}>>>"
    whole = spark.read.schema(shape).option("multiLine", True).json(path)
    records = whole.select(F.explode("files").alias("r")).select("r.*")
    groups = whole.select(F.posexplode("groups").alias("k", "g")).select((F.col("k") + 1).cast("bigint").alias("group_ord"), F.col("g.id").alias("group_id"), "g.kind", F.explode("g.members").alias("m"))
    flat = groups.select("group_id", "kind", "group_ord", "m.*").withColumn("sel_ord", F.col("ord"))
    return records, flat.join(records.drop("size"), "path")
