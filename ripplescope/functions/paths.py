"""Predicates and keys of repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder in a repository where this engine keeps its state.
STATE_FOLDER = ".ripplescope"
# Folders whose files are never sources or never copied, extensions that can ask for whole projects, and those that are watched.
BUILD_FOLDERS = ["obj", "bin"]
UNWATCHED_FOLDERS = ["bin", "obj", ".git", "node_modules"]
OVERLAY_FOLDERS = ["bin", "obj", "node_modules", ".git", ".vs", STATE_FOLDER, "packages"]
FALLBACK_EXTENSIONS = ["cs", "csproj", "props", "targets", "config", "resx", "json", "xml", "razor", "cshtml"]
WATCHED_EXTENSIONS = ["cs", "razor", "cshtml"]


def file_key(path: Column) -> Column:
    """Key for lookups: forward slashes, lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def folded(path: Column) -> Column:
    """Without ``.`` and ``..``; what climbs above the top stays."""
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")
    up = lambda a: (F.size(a) > 0) & (F.element_at(a, -1) != "..")
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when((p == "..") & up(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((p == "..") & rooted, a).otherwise(F.concat(a, F.array(p)))
    parts = F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), none, step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def from_root(path: Column, root: str) -> Column:
    """Relative to ``root``; outside of it, from ``root`` upwards with ``..``. A relative path stays as it is."""
    flat, home = folded(path), [p for p in root.replace("\\", "/").split("/") if p]
    lead = "" if re.match("[A-Za-z]:", root) else "/"
    found = flat
    for depth in range(len(home) + 1):  # the deepest folder that both are in wins
        top = lead + "/".join(home[:depth])
        inside = F.startswith(F.lower(F.concat(flat, F.lit("/"))), F.lit(top.rstrip("/").lower() + "/"))
        rest = F.substr(flat, F.lit(len(top.rstrip("/")) + 2))
        found = F.when(inside, F.concat(F.lit("../" * (len(home) - depth)), rest)).otherwise(found)
    return F.when(is_absolute(path), found).otherwise(path)


def _has_folder(path: Column, folders: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[\\/]+"), F.array(*[F.lit(f.lower()) for f in folders]))


def in_repo_tree(path: Column) -> Column:
    """Relative, and outside of build output."""
    inside = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~F.arrays_overlap(inside, F.array(*map(F.lit, BUILD_FOLDERS)))


def is_build_output(path: Column) -> Column:
    """Below a folder of build output, wherever that lies."""
    return path.rlike(r"(?i)(^|/)(" + "|".join(BUILD_FOLDERS) + ")/")


def has_extension(path: Column, extensions: list[str]) -> Column:
    return path.rlike(r"(?i)\.(" + "|".join(extensions) + r")\z")


def fallback_eligible(path: Column) -> Column:
    return has_extension(path, FALLBACK_EXTENSIONS)


def watchable(path: Column) -> Column:
    return has_extension(path, WATCHED_EXTENSIONS) & ~_has_folder(path, UNWATCHED_FOLDERS)


def overlay_skipped(path: Column) -> Column:
    return _has_folder(path, OVERLAY_FOLDERS)


def under(path: Column, base: Column) -> Column:
    return F.startswith(file_key(path), F.concat(F.rtrim(file_key(base), F.lit("/")), F.lit("/")))


def remapped(path: Column, shadow: Column, repo: Column) -> Column:
    """``path`` with the prefix ``shadow`` replaced by ``repo``, whatever the case and slashes."""
    rest = F.substr(F.replace(path, F.lit("\\"), F.lit("/")), F.length(F.rtrim(shadow, F.lit("/"))) + 1)
    return F.when(under(path, shadow), F.concat(F.rtrim(repo, F.lit("/")), rest)).otherwise(path)


def relative(path: Column, root: Column) -> Column:
    """Relative to ``root`` with forward slashes; outside of it, the path as it is."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(under(path, root), F.substr(flat, F.length(F.rtrim(root, F.lit("/"))) + 2)).otherwise(flat)


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest first, the root as ''."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth < 1, F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit("")))
    )
