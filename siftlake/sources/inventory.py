"""Inventories of files as record relations."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.paths import excluded, glob_pattern, hidden, in_package, suffix
from siftlake.operators.groups import buckets
from siftlake.storage import settled

#: First bytes that are hashed on their own, and bytes read at once.
HEAD, PIECE = 1 << 16, 1 << 20

# Names that are always left out, the folders of this engine among them.
ALWAYS_EXCLUDED = (".git", ".siftlake", "*.photoslibrary", "node_modules", ".trash", ".ds_store", "__macosx", "for deletion", "_siftlake review", "siftlake review", "_siftlake quarantine", "siftlake quarantine")
LISTED = "path string, root string, relative string, size bigint, mtime double, mtime_ns bigint, device bigint, inode bigint, is_symlink boolean, scan_ord bigint"


def pruner(include_hidden: bool, exclusions: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether a folder, by its path below the root, is left out with all that is in it."""
    globs = [re.compile(glob_pattern(g.strip().lower())) for g in (*ALWAYS_EXCLUDED, *exclusions) if g.strip()]

    def out(relative: str) -> bool:
        low = relative.lower()
        name = low.rsplit("/", 1)[-1]
        return not include_hidden and name.startswith(".") or any(g.match(name) or g.match(low) for g in globs)

    return out


def walk(folder: str, follow_symlinks: bool = False, root: str | None = None, prune: Callable[[str], bool] | None = None, deep: bool = True, first: int = 0) -> Iterator[tuple]:
    """Rows of LISTED for the regular files below a folder, or the folder itself if it is a file; unreadable folders are skipped.

    Links are left out, or followed while they stay below the folder; a folder is entered once. root: what relative paths start
    from; prune: folders not to enter; deep: whether to enter any; first: the number of the first file.
    """
    folder = os.path.abspath(folder)
    root = root or folder
    if os.path.isfile(folder):
        st = os.stat(folder)
        yield folder, root, os.path.basename(folder), st.st_size, st.st_mtime, st.st_mtime_ns, st.st_dev, st.st_ino, os.path.islink(folder), first
        return
    stack, seen, k, top = [folder], set(), first, os.path.realpath(folder) + os.sep
    while stack:
        here = stack.pop()
        try:
            st = os.stat(here)
            if (st.st_dev, st.st_ino) in seen:
                continue
            seen.add((st.st_dev, st.st_ino))
            entries = sorted(os.scandir(here), key=lambda e: e.name, reverse=True)
        except OSError:
            continue
        for e in reversed(entries):
            try:
                link = e.is_symlink()
                if link and not (follow_symlinks and os.path.realpath(e.path).startswith(top)):
                    continue
                if e.is_dir():
                    continue
                st = e.stat()
                if e.is_file():
                    yield e.path, root, os.path.relpath(e.path, root), st.st_size, st.st_mtime, st.st_mtime_ns, st.st_dev, st.st_ino, link, k
                    k += 1
            except OSError:
                continue
        if deep:
            stack += [e.path for e in entries if e.is_dir() and (not e.is_symlink() or follow_symlinks) and not (prune and prune(os.path.relpath(e.path, root)))]


def shards_of(root: str, prune: Callable[[str], bool], levels: int = 2) -> list[tuple[str, bool]]:
    """Folders that tasks walk on their own: those above `levels` without what lies below them, and those at `levels` with it."""
    out, level = [], [root]
    for _ in range(levels if os.path.isdir(root) else 0):
        below = []
        for folder in level:
            out.append((folder, False))
            try:
                below += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not prune(os.path.relpath(e.path, root)))
            except OSError:
                continue
        level = below
    return out + [(folder, True) for folder in level]


def checked_roots(roots: list[str]) -> tuple[list[str], list[str]]:
    """The roots that can be scanned, each once, and an error for each of the others: missing, or in a photo library."""
    good, errors = [], []
    for r in dict.fromkeys(os.path.realpath(os.path.expanduser(r)) for r in roots):
        if not os.path.exists(r):
            errors.append(f"scan root does not exist: {r}")
        elif any(p.lower().endswith(".photoslibrary") for p in r.split("/")):
            errors.append(f"Photos libraries cannot be scanned directly; export media from Photos.app to a normal folder first: {r}")
        else:
            good.append(r)
    return good, errors


def listing(spark: SparkSession, roots: list[str], follow_symlinks: bool = False, include_hidden: bool = True, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """LISTED rows of all roots, for folders that every executor mounts: a task for each folder of the second level. Missing roots
    give nothing, and folders left out by name are not entered. With links followed a root is one task's, which knows where it has been.
    """
    own = list(dict.fromkeys(os.path.abspath(r) for r in roots))
    names = [c.split()[0] for c in LISTED.split(", ")]
    prune = pruner(include_hidden, exclusions)
    shards = [(r, folder, deep, k << 40) for r in own for k, (folder, deep) in enumerate([(r, True)] if follow_symlinks else shards_of(r, prune))]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for root, folder, deep, first in zip(batch["root"], batch["folder"], batch["deep"], batch["first"]):
                rows: list[tuple] = []
                for row in walk(folder, follow_symlinks, root, prune, bool(deep), int(first)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    if not shards:
        return spark.createDataFrame([], LISTED)
    return spark.createDataFrame(shards, "root string, folder string, deep boolean, first bigint").repartition(len(shards), "folder").mapInPandas(run, LISTED)


def collapse_links(records: DataFrame, order: str = "scan_ord") -> DataFrame:
    """One record of each (device, inode): the first in order and, of equals, by path. Records without either all stay."""
    known = F.col("device").isNotNull() & F.col("inode").isNotNull()
    first = records.where(known).groupBy("device", "inode").agg(F.min(F.struct(order, "path")).alias("__f")).select("device", "inode", F.col("__f.path").alias("path"))
    return records.where(known).join(first, ["device", "inode", "path"], "left_semi").select(*records.columns).union(records.where(~known))


def records(listed: DataFrame, images: bool = True, gifs: bool = True, videos: bool = True, include_hidden: bool = False, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """The files of a listing that a scan is about, with extension and medium; names, folders and packages left out are gone."""
    wanted = S.extensions(images, gifs, videos)
    out = listed.withColumn("extension", suffix(F.col("path"))).where(F.col("extension").isin(*wanted) if wanted else F.lit(False))
    parts = F.split("relative", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = out.where(~in_package(F.col("path")) & ~F.exists(prefixes, lambda x: excluded(x, (*ALWAYS_EXCLUDED, *(e.strip() for e in exclusions if e.strip())))))
    if not include_hidden:
        out = out.where(~hidden(F.col("relative")))
    return collapse_links(out.withColumn("media_type", S.media_type(F.col("extension"))))


def binary_files(spark: SparkSession, path: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """path, size, mtime, sha256, partial_hash of files in any store that Spark reads. Empty files and names from . and _ are not seen."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    clean = F.regexp_replace("path", "^file:/+", "/")
    out = raw.select(clean.alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), F.sha2("content", 256).alias("sha256"), F.sha2(F.substring("content", 1, 65536), 256).alias("partial_hash"))
    return out.where(suffix(F.col("path")).isin(*wanted)) if wanted else out


def file_digests(files: DataFrame, out: str, most: int | None = None) -> DataFrame:
    """path, out (sha256 of the first `most` bytes, or of all), problem; read piece by piece, whatever a file's size, where tasks run."""
    what = "partial hash" if most else "sha256"

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    h, left = hashlib.sha256(), most
                    with open(path, "rb") as f:
                        while piece := f.read(PIECE if left is None else min(PIECE, left)):
                            h.update(piece)
                            left = None if left is None else left - len(piece)
                    rows.append((path, h.hexdigest(), None))
                except OSError as e:
                    rows.append((path, None, f"{what} failed: {e}"))
            yield pd.DataFrame(rows, columns=["path", out, "problem"])

    return files.select("path").distinct().mapInPandas(run, f"path string, {out} string, problem string")


def with_hashes(records: DataFrame) -> DataFrame:
    """records with partial_hash, sha256 and error: only files of a size that occurs again are read, and only those whose first bytes
    do, too, are read whole."""
    near = settled(buckets(records.where("size > 0"), "size").select("path", "size"), "equal-sizes")
    heads = settled(near.join(file_digests(near, "partial_hash", HEAD), "path"), "heads")
    same = buckets(heads.where("partial_hash IS NOT NULL"), "size", "partial_hash")
    small = same.where(F.col("size") <= HEAD).select("path", F.col("partial_hash").alias("sha256"), F.lit(None).cast("string").alias("whole_problem"))
    large = file_digests(same.where(F.col("size") > HEAD), "sha256").withColumnRenamed("problem", "whole_problem")
    done = settled(heads.select("path", "partial_hash", "problem").join(small.union(large), "path", "left"), "hashes")
    known = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    out = records.drop("partial_hash", "sha256").join(done, "path", "left")
    return out.withColumn("error", F.coalesce("problem", "whole_problem", known)).drop("problem", "whole_problem")
