"""Which classes and projects a set of changed files can affect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import stored
from .graph import dependents_to
from .index import FileIndex


@dataclass
class Affected:
    """The three parts of a selection."""

    classes: DataFrame
    fallback_projects: DataFrame
    changed: DataFrame

    def lines(self) -> DataFrame:
        """``(line)``: classes, then ``project:<name>``."""
        return self.classes.select(F.col("class_fqn").alias("line")).union(self.fallback_projects.select(F.concat(F.lit("project:"), "project"))).orderBy("line")

    def document(self, map_ready: bool = True) -> DataFrame:
        """One row with the selection as JSON."""
        gathered = lambda df, c, name: df.agg(F.array_sort(F.collect_set(c)).alias(name))
        parts = gathered(self.classes, "class_fqn", "classes").join(gathered(self.fallback_projects, "project", "projects")).join(gathered(self.changed, "file", "changedFiles"))
        return parts.select(F.to_json(F.struct(F.lit(map_ready).alias("mapReady"), "classes", "projects", "changedFiles")).alias("json"))


def index(class_map: DataFrame) -> DataFrame:
    """``(file_key, class_fqn)`` from ``class_map(class_fqn, files)``; a pair can stand twice, as those who look it up keep few of them."""
    return class_map.select(F.explode("files").alias("file"), "class_fqn").select(paths.file_key(F.col("file")).alias("file_key"), "class_fqn")


def usable(changed: DataFrame, root: str | None = None) -> DataFrame:
    """Changed files, normalised, without build output, each once.

    Absolute ones are made relative to ``root``; one outside of it begins with
    ``..``, and without a ``root`` they stay absolute: no map knows such a file, so
    that it asks for whole projects and nothing that changed is lost.
    """
    flat = paths.normalised(F.col("file")) if root is None else paths.from_root(paths.normalised(F.col("file")), root)
    flat = changed.select(flat.alias("file")).where(~paths.is_build_output(F.col("file")))
    return flat.withColumn("file_key", paths.file_key(F.col("file"))).dropDuplicates(["file_key"])


def hit_classes(changed: DataFrame, by_file: DataFrame) -> DataFrame:
    return changed.select("file_key").distinct().join(by_file, "file_key").select("class_fqn").distinct()


def unknown_files(changed: DataFrame, by_file: DataFrame) -> DataFrame:
    return changed.join(by_file, "file_key", "left_anti")


def owners(files: DataFrame, projects: DataFrame, file: str = "file") -> DataFrame:
    """``files`` with ``project``: the one in the nearest folder above; null without one. An equi-join on the folders above each file."""
    above = files.select(file).distinct().select(file, F.posexplode(paths.ancestors(F.col(file))).alias("up", "dir"))
    found = above.join(projects.select(paths.file_key(F.col("dir")).alias("_dir"), "project"), paths.file_key(F.col("dir")) == F.col("_dir"))
    nearest = found.groupBy(file).agg(F.min_by("project", F.struct("up", "project")).alias("project"))
    return files.join(nearest, file, "left")


def learned(changed: DataFrame, bindings: DataFrame, class_map: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes that learnt edges add, and the files that these cover.

    An edge (from_key, to) adds the static rows that refer to ``from_key``; rows
    with measured coverage are never extended. A file is covered by a class that was
    added and an edge that is parsed or confirmed twice; the same edge if ``strict``.
    """
    edges = bindings.select("from_key", paths.file_key(F.col("to")).alias("file_key"), ((F.col("source") == "parsed") | (F.col("confirms") >= 2)).alias("covering"))
    static = class_map.where("source = 'static'").select("class_fqn", F.explode("abstract_files").alias("a")).select("class_fqn", paths.file_key(F.col("a")).alias("from_key"))
    met = changed.select("file_key").distinct().join(edges, "file_key").join(static, "from_key", "left")
    hit = F.col("class_fqn").isNotNull()
    tests = [F.bool_or(hit & F.col("covering")).alias("hit"), F.lit(True).alias("covering")] if strict else [F.bool_or(hit).alias("hit"), F.bool_or("covering").alias("covering")]
    covered = met.groupBy("file_key").agg(*tests).where("hit and covering").select("file_key")
    return met.where(hit).select("class_fqn").distinct(), covered


def without_full_projects(classes: DataFrame, class_map: DataFrame, projects: DataFrame) -> DataFrame:
    """Selected classes whose project doesn't run as a whole anyway."""
    full = projects.select(F.lower("project").alias("_p"))
    own = classes.join(class_map.select("class_fqn", F.lower("project").alias("_p")), "class_fqn", "left")
    return own.join(full, "_p", "left_anti").select("class_fqn").distinct()


#: So many changed files are sent to every task that looks through the map.
FEW = 100_000


def affected(changed: DataFrame, class_map: DataFrame, bindings: DataFrame, projects: DataFrame, refs: DataFrame, root: str | None = None, kept: FileIndex | None = None) -> Affected:
    """The whole selection: index hits, learnt classes, and the test projects that depend on what neither knows.

    With a ``kept`` index the hits come from it, else the map is looked through once.
    What several steps need is stored: the changed files, their hits, and what is left.
    """
    files = stored(usable(changed, root), "affected-files")
    keys = files.select("file_key")
    hits = kept.rows(keys) if kept is not None else index(class_map).join(F.broadcast(keys) if files.count() <= FEW else keys, "file_key", "left_semi")
    hits = stored(hits.distinct(), "affected-hits")
    more, covered = learned(files, bindings, class_map)
    classes = stored(hits.select("class_fqn").union(more).distinct(), "affected-classes")
    left = stored(unknown_files(files, hits.select("file_key").distinct()).join(covered, "file_key", "left_anti").where(paths.fallback_eligible(F.col("file"))), "affected-left")
    owned = owners(left, projects).where(F.col("project").isNotNull() | F.lower("file").endswith(".cs"))
    targets = projects.where("is_test").select(F.col("project").alias("node"))
    fallback = stored(dependents_to(refs, owned.select(F.col("project").alias("node")).distinct(), targets).select(F.col("node").alias("project")), "affected-projects")
    return Affected(without_full_projects(classes, class_map, fallback), fallback, files.select("file"))


def by_project(classes: DataFrame, class_map: DataFrame, class_owners: DataFrame) -> DataFrame:
    """``(project, class_fqn)``: by the map, else by the known owner; classes without either are dropped."""
    joined = classes.join(class_map.select("class_fqn", F.col("project").alias("p1")), "class_fqn", "left").join(class_owners.select("class_fqn", F.col("project").alias("p2")), "class_fqn", "left")
    return joined.select(F.coalesce("p1", "p2").alias("project"), "class_fqn").where("project is not null")


def pruned(class_map: DataFrame, live_classes: DataFrame, live_projects: DataFrame, discovered: DataFrame) -> DataFrame:
    """Rows to keep: of a discovered project the live classes, of another those whose project exists."""
    mark = lambda df, c, name: df.select(c).distinct().withColumn(name, F.lit(True))
    joined = class_map.join(mark(live_classes, "class_fqn", "_c"), "class_fqn", "left").join(mark(live_projects, "project", "_p"), "project", "left").join(mark(discovered, "project", "_d"), "project", "left")
    return joined.where(F.when(F.col("_d"), F.col("_c")).otherwise(F.col("_p"))).select(class_map.columns)


def alive(static: DataFrame, discovered: DataFrame) -> DataFrame:
    """``(project, class_fqn)`` that are known to exist, of ``static(project, class_fqn)`` and ``discovered(project, classes)``.

    A project whose discovery found nothing isn't among them by that, so that a
    listing that failed silently prunes nothing.
    """
    return static.select("project", "class_fqn").union(discovered.select("project", F.explode("classes"))).distinct()


# The refs that are asked for a branch's base, the first that there is.
BASE_REFS = ["@{upstream}", "origin/HEAD", "origin/main", "origin/master"]


def base_ref(refs: DataFrame) -> DataFrame:
    """``(repo, base)`` of ``refs(repo, name, target)``: the branch's upstream, else what origin's head points to, else its main or master. Repositories without any have no row."""
    target = F.when(F.col("name").isin(BASE_REFS[:2]), F.nullif(F.trim("target", F.lit(" \t\r\n")), F.lit(""))).otherwise(F.col("name"))
    rank = F.array_position(F.array(*map(F.lit, BASE_REFS)), F.col("name"))
    told = refs.where(F.col("name").isin(BASE_REFS)).select("repo", target.alias("base"), rank.alias("rank")).where((F.col("base") != "") & (F.col("base") != BASE_REFS[1]))
    return told.groupBy("repo").agg(F.min_by("base", "rank").alias("base"))


def merged_map(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """The map after new rows: static never replaces coverage unless forced; coverage keeps static abstractions."""
    o, n = old.select(F.struct(*old.columns).alias("o"), "class_fqn"), new.select(F.struct(*old.columns).alias("n"), "class_fqn")
    joined = o.join(n, "class_fqn", "full")
    stays = F.col("n").isNull() | (F.col("o").isNotNull() & (F.col("o.source") == "coverage") & (F.col("n.source") == "static") & F.lit(not force))
    pick = lambda c: F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    abstract = F.when(stays, F.col("o.abstract_files")).when((F.col("n.source") == "coverage") & (F.size(F.coalesce("n.abstract_files", F.array().cast("array<string>"))) == 0), F.col("o.abstract_files")).otherwise(F.col("n.abstract_files")).alias("abstract_files")
    return joined.select(*[abstract if c == "abstract_files" else pick(c) for c in old.columns])


def change_set(committed: DataFrame, dirty: DataFrame) -> DataFrame:
    """``(file)`` of all changes, with the origins of renames."""
    both = committed.select("file", "origin").union(dirty.select("file", "origin"))
    return both.select(F.explode(F.array_compact(F.array("file", "origin"))).alias("file")).distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, cold: bool = False) -> DataFrame:
    """``(file, kind)`` between two tables ``(file, fp)``; a cold start has no changes."""
    joined = before.select("file", F.col("fp").alias("b")).join(after.select("file", F.col("fp").alias("a")), "file", "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("edited")
    return joined.where(~F.col("a").eqNullSafe(F.col("b")) & F.lit(not cold)).select("file", kind.alias("kind"))


def overlay_restores(previous: DataFrame, current: DataFrame, tracked: DataFrame) -> DataFrame:
    """``(file, tracked)``: what the former overlay had and this one has not."""
    gone = previous.select("file").join(current.select("file"), "file", "left_anti")
    return gone.join(tracked.select("file", F.lit(True).alias("tracked")).distinct(), "file", "left").fillna(False, ["tracked"])
