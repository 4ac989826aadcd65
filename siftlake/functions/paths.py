"""Functions of paths and names, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; empty for names without one, leading dots not counted."""
    return F.lower(F.regexp_extract(name(path), r"[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    """The folder; the root's is the root."""
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when((cut == "") & path.startswith("/"), "/").otherwise(cut)


def depth(path: Column) -> Column:
    """Parts of an absolute path, the root counted."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("bigint") + F.when(path.startswith("/"), 1).otherwise(0)


def in_package(path: Column, ending: str = ".photoslibrary") -> Column:
    """Whether a part of the path ends so, whatever its case."""
    return F.exists(F.split(F.lower(path), "/"), lambda x: x.endswith(ending))


def hidden(relative: Column) -> Column:
    """Whether a folder or the name starts with a dot."""
    return relative.rlike(r"(^|/)\.[^/]")


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern whose star crosses folders, matched against the whole text."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", k + 1 if glob[k : k + 1] not in ("!", "]") else k + 2)
            if end < 0:
                out += r"\["
            else:
                body = glob[k:end].replace("\\", r"\\")
                out += f"[{'^' + body[1:] if body.startswith('!') else body}]"
                k = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def excluded(relative: Column, globs: tuple[str, ...]) -> Column:
    """Whether a lower-cased pattern matches the lower-cased name or path below the root."""
    hit = F.lit(False)
    for g in globs:
        p = glob_pattern(g.lower())
        hit = hit | F.lower(name(relative)).rlike(p) | F.lower(relative).rlike(p)
    return hit


def path_matches(path: Column, wanted: str) -> Column:
    """A search box's match: without * and ? a part of the path, else a pattern anywhere in it; case does not count."""
    if not wanted:
        return F.lit(True)
    if "*" not in wanted and "?" not in wanted:
        return F.lower(path).contains(wanted.lower())
    return path.rlike("(?i)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in wanted))


def in_roots(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether the path is a root or lies below one; no roots allow all."""
    hit = F.lit(not roots)
    for r in roots:
        hit = hit | (path == r) | path.startswith(r.rstrip("/") + "/")
    return hit


def safe_name(text: Column, longest: int = 80) -> Column:
    """A file name: other than letters, digits and ._- ()[] becomes _, spaces, dots and _ at the ends go, the rest is cut; "file" if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}._\- ()\[\]]", "_"), "^[ ._]+|[ ._]+$", "")
    return F.substring(F.when(clean == "", "file").otherwise(clean), 1, longest)
