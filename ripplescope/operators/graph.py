"""Walks over edge tables ``(src, dst)``."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.shared import discarded, stored


def closure(edges: DataFrame, roots: DataFrame, capped: DataFrame | None = None, deep: bool = False) -> DataFrame:
    """``(root, node)``: all that each root of ``roots(root)`` reaches, itself included.

    Nodes of ``capped(node)`` are reached but not passed. Each round follows only
    what the last one found and is stored in the shared folder, so cycles end and
    the plan stays short. There are as many rounds as the longest way has edges; with
    ``deep`` as many as its logarithm, as a round doubles the ways of all nodes, which
    pays where most nodes are roots or ways are long.
    """
    edges = edges.select("src", "dst").distinct()
    if capped is not None:
        edges = edges.join(capped.select(F.col("node").alias("src")), "src", "left_anti")
    edges = stored(edges, "closure-edges")
    if deep:
        pairs = _doubled(edges).select(F.col("src").alias("root"), F.col("dst").alias("node")).join(roots.select("root").distinct(), "root", "left_semi")
        return pairs.unionByName(roots.select("root", F.col("root").alias("node")).distinct()).distinct()
    frontier = reached = stored(roots.select("root", F.col("root").alias("node")).distinct(), "closure")
    while True:  # each round finds a new pair, and there are only so many
        step = frontier.join(edges, frontier.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(reached, ["root", "node"], "left_anti"), "closure")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def _doubled(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` of all that a node reaches by one edge or more.

    A shortest way of up to twice as many edges begins with one that the last round
    found and goes on with one that is known.
    """
    known = new = edges
    while True:
        step = new.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct()
        new = stored(step.join(known, ["src", "dst"], "left_anti"), "doubled")
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new), "doubled")


def reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node)``: all that any of ``sources(node)`` reaches, themselves included; a row a node, however many sources there are."""
    edges = stored(edges.select("src", "dst").distinct(), "reached-edges")
    frontier = found = stored(sources.select("node").distinct(), "reached")
    while True:
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(found, "node", "left_anti"), "reached")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hubs(edges: DataFrame, nodes: DataFrame, percent: int = 30, least_world: int = 20, least_degree: int = 10) -> DataFrame:
    """``(node, degree)`` of what too many refer to; nodes with ``is_test`` never count, small worlds have none."""
    degree = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("degree"))
    world = nodes.agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(least_degree), F.floor(F.col("n") * percent / 100)).alias("bar"))  # one row
    tests = nodes.where("is_test").select(F.col("node").alias("dst"))
    found = degree.join(F.broadcast(world), F.expr(f"n >= {least_world} and degree >= bar"))
    return found.join(tests, "dst", "left_anti").select(F.col("dst").alias("node"), "degree")


def dependents_to(edges: DataFrame, changed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(node)`` among ``targets(node)`` that reach one of ``changed(node)`` along ``edges``.

    A null among the changed, something without an owner, reaches every target.
    """
    hit = reached(reversed_edges(edges), changed.where("node is not null"))
    everything = targets.join(changed.where("node is null").limit(1).select(F.lit(1).alias("all")))
    return targets.join(hit, "node", "left_semi").select("node").union(everything.select("node")).distinct()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, level)``: a node's level is above those of all it depends on (``src`` depends on ``dst``), within ``nodes(node)``.

    Nodes on a cycle and those above one have no level and are left out.
    """
    own = nodes.select("node").distinct()
    # Merge joins: what the rounds join is as large as the graph, and a broadcast goes through the driver.
    within = lambda df, side, some: df.join(some.withColumnRenamed("node", side).hint("merge"), side, "left_semi")
    inside, left = stored(within(within(edges.select("src", "dst"), "src", own), "dst", own).distinct(), "levels-edges"), stored(own, "levels")
    done = None
    for level in itertools.count():  # each round takes some nodes out, and the edges to them
        waiting = stored(inside.select(F.col("src").alias("node")).distinct(), "levels")
        ready = stored(left.join(waiting.hint("merge"), "node", "left_anti"), "levels")
        if ready.isEmpty():
            break
        done = ready.withColumn("level", F.lit(level)) if done is None else done.union(ready.withColumn("level", F.lit(level)))
        before, inside = inside, stored(within(inside, "dst", waiting), "levels-edges")
        discarded(before)
        discarded(left)
        left = waiting
    return done if done is not None else own.limit(0).withColumn("level", F.lit(0))


def guard_exempt(edges: DataFrame, owners: DataFrame, baselines: DataFrame) -> DataFrame:
    """``(owner, dependent)``: owners all of whose transitive dependents are in ``baselines(node)``, with those dependents."""
    reach = closure(reversed_edges(edges), owners.select(F.col("owner").alias("root"))).where("root <> node")
    judged = reach.join(baselines.select("node", F.lit(True).alias("has")), "node", "left")
    whole = judged.groupBy("root").agg(F.every(F.coalesce("has", F.lit(False))).alias("ok")).where("ok")
    return judged.join(whole, "root", "left_semi").select(F.col("root").alias("owner"), F.col("node").alias("dependent"))


def transitive_stamps(edges: DataFrame, stamps: DataFrame) -> DataFrame:
    """``(node, stamp)``: a digest of the stamps of all that a node reaches; changes when any of them does."""
    reach = closure(edges, stamps.select(F.col("node").alias("root")), deep=True)
    each = reach.join(stamps, "node").groupBy("root").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col("node").cast("string"), "stamp"))).alias("all"))
    return each.select(F.col("root").alias("node"), F.sha1(F.array_join("all", "+")).alias("stamp"))


def resolved_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` from ``nodes(node, fqn, ref_names)``: a name refers to every node that has it."""
    refs = nodes.select(F.col("node").alias("src"), F.explode("ref_names").alias("fqn")).distinct()
    return refs.join(nodes.select("fqn", F.col("node").alias("dst")), "fqn").select("src", "dst").distinct()


def resolved_degrees(nodes: DataFrame) -> DataFrame:
    """``(src, refs, highest)``: how many nodes each refers to by ``resolved_edges``, and the highest of them; what refers to none is left out.

    Nodes that refer to the same names have the same edges, so these are counted
    once for each set of names, and the pairs of nodes are never made.
    """
    refs = nodes.select(F.col("node").alias("src"), F.explode("ref_names").alias("fqn")).where("fqn is not null")
    sets = refs.groupBy("src").agg(F.array_sort(F.collect_set("fqn")).alias("names"))
    held = nodes.where("fqn is not null").select("fqn", F.col("node").alias("dst")).distinct()
    met = sets.select("names").distinct().select("names", F.explode("names").alias("fqn")).join(held, "fqn").select("names", "dst").distinct()
    return sets.join(met.groupBy("names").agg(F.count("*").alias("refs"), F.max("dst").alias("highest")), "names").select("src", "refs", "highest")


def merged_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of one assembly and name as one: sets are joined, flags are or-ed, the first project stays."""
    flags = [c for c in rows.columns if c.startswith("is_")]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("asm", "fqn").agg(F.min_by("project", "seq").alias("project"), *[F.bool_or(c).alias(c) for c in flags], union("files"), union("ref_names"))


def type_index(nodes: DataFrame) -> DataFrame:
    """``(fqn, files)`` over all assemblies, where there are any files."""
    return nodes.select("fqn", F.explode("files").alias("file")).groupBy("fqn").agg(F.array_sort(F.collect_set("file")).alias("files"))


def abstraction_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, abstract_files)``: files of the interfaces and abstract types that a node refers to itself."""
    targets = nodes.where("is_interface or is_abstract").select(F.col("node").alias("dst"), F.explode("files").alias("file"))
    return edges.join(targets, "dst").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("file")).alias("abstract_files"))


def name_candidates(nodes: DataFrame) -> DataFrame:
    """``(node, short, files)`` of ``nodes(node, fqn, is_enum, is_const_only, files)``: what compiled code can lose, so that only a text names it; with files, and short names of three characters or more that aren't generic."""
    short = F.substring_index("fqn", ".", -1)
    return nodes.where((F.col("is_enum") | F.col("is_const_only")) & (F.size("files") > 0) & (F.length(short) >= 3) & ~F.contains(short, F.lit("<"))).select("node", short.alias("short"), "files")


#: Bits of a filter for each name it holds, and at most: two to the power of so many.
NAME_BITS, MOST_BITS_LOG2 = 16, 26


def name_filter(candidates: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of the short names of ``candidates(short)``: one row with ``bits``, words of 64 bits, and their number.

    Its size follows from how many names there are, up to 8 MB; beyond that more
    words pass, but none that counts is lost.
    """
    n = max(1, candidates.select("short").distinct().count())
    words = 1 << min(MOST_BITS_LOG2, max(12, (n * NAME_BITS - 1).bit_length())) - 6
    at = candidates.select(F.explode(_positions(F.col("short"), words)).alias("at")).distinct()
    filled = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = candidates.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(filled, "w", "left")
    gathered = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(gathered, lambda x: x["bits"]).alias("bits")), words


def _positions(word: Column, words: int) -> Column:
    """The two bits of a word, both from one hash; ``words`` is a power of two."""
    h, last = F.xxhash64(word), F.lit(64 * words - 1)
    return F.array(h.bitwiseAND(last), F.shiftrightunsigned(h, 32).bitwiseAND(last))


def mentions(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(node, file, word)`` of the words of ``texts(node, file, text)`` that can be a short name of ``candidates``.

    The filter drops the other words of a text while they are still an array, before
    they become rows and are shuffled. Some words pass that are no name.
    """
    filter_, words = name_filter(candidates)
    bits = filter_.scalar()  # made once, before the texts are read

    held = texts.select("node", "file", names.words(F.col("text")).alias("words"), bits.alias("bits"))
    test = "forall(p, at -> getbit(bits[cast(shiftright(at, 6) as int)], cast(at & 63 as int)) = 1)"
    at = f"array(xxhash64(w) & {64 * words - 1}L, shiftrightunsigned(xxhash64(w), 32) & {64 * words - 1}L)"
    return held.select("node", "file", F.explode(F.expr(f"filter(words, w -> length(w) >= 3 and {test.replace('forall(p', 'forall(' + at)})")).alias("word"))


def mention_edges(mentions: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst)`` for nodes whose own text has a candidate's short name as a word.

    ``mentions(node, file, word)``, ``candidates(node, short, files)``: short names
    of fewer than three characters don't count, nor a node itself, an edge that is
    there already, or a file that the candidate shares.
    """
    named = candidates.where("length(short) >= 3 and not contains(short, '<')").select(F.col("node").alias("dst"), F.col("short").alias("word"), "files")
    met = mentions.join(named, "word").where((F.col("node") != F.col("dst")) & ~F.array_contains("files", F.col("file")))
    return met.select(F.col("node").alias("src"), "dst").distinct().join(edges, ["src", "dst"], "left_anti")
