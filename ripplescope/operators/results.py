"""Test outcomes, coverage hits and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths

# How a source declares a namespace and a class.
NAMESPACE = r"^\s*namespace\s+([A-Za-z_][\w.]*)"
CLASS = r"^\s*(?:\[[^\]]*\]\s*)*(?:public|internal|protected|private)?\s*(?:sealed\s+|abstract\s+|static\s+|partial\s+)*class\s+([A-Za-z_]\w*)"


def method_verdicts(outcomes: DataFrame) -> DataFrame:
    """``(class_fqn, method, verdict)``: cases of a method together. Skipped is neither passed nor failed."""
    failed = F.bool_or(~F.col("passed") & ~F.col("skipped"))
    each = outcomes.groupBy("class_fqn", names.strip_args(F.col("method")).alias("method")).agg(failed.alias("f"), F.every("skipped").alias("s"))
    return each.select("class_fqn", "method", F.when(F.col("f"), "failed").when(F.col("s"), "skipped").otherwise("passed").alias("verdict"))


def class_verdicts(outcomes: DataFrame) -> DataFrame:
    """``(class_fqn, verdict)``: failed before passed before skipped."""
    rank = F.max(F.when(F.col("verdict") == "failed", 2).when(F.col("verdict") == "passed", 1).otherwise(0))
    each = method_verdicts(outcomes).groupBy("class_fqn").agg(rank.alias("r"))
    return each.select("class_fqn", F.element_at(F.array(F.lit("skipped"), F.lit("passed"), F.lit("failed")), F.col("r") + 1).alias("verdict"))


def method_report(outcomes: DataFrame) -> DataFrame:
    """``(class_fqn, method, duration_ms, skipped, passed, message)`` of ``outcomes(seq, ...)``.

    The message has a line ``case: message`` for each failed case, in order, with
    ``failed`` for one that says nothing; it is null where no case failed. A skip of
    a whole class, named like the class, is no method.
    """
    bad, said = ~F.col("passed") & ~F.col("skipped"), F.concat(F.col("method"), F.lit(": "), F.coalesce("message", F.lit("failed")))
    lines = F.array_sort(F.collect_list(F.when(bad, F.struct("seq", said.alias("line")))))
    each = outcomes.groupBy("class_fqn", names.strip_args(F.col("method")).alias("name")).agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.every("skipped").alias("skipped"), (~F.bool_or(bad)).alias("passed"), lines.alias("lines"))
    message = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda m: m["line"]), "\n"))
    return each.where(~(F.col("skipped") & (F.col("name") == F.col("class_fqn")))).select("class_fqn", F.col("name").alias("method"), "duration_ms", "skipped", "passed", message.alias("message"))


def class_report(report: DataFrame) -> DataFrame:
    return report.groupBy("class_fqn").agg(F.every("passed").alias("passed"), F.sum("duration_ms").alias("duration_ms"))


def hit_files(lines: DataFrame) -> DataFrame:
    """Files with a line that ran."""
    return lines.groupBy("file").agg(F.bool_or(F.col("hits") > 0).alias("hit")).where("hit").select("file")


def merged_hits(lines: DataFrame) -> DataFrame:
    """``(file, line, hits)`` of ``lines(project, file, line, hits)``: the most within a project, added over projects."""
    fine = lines.where("line > 0").select("project", "file", "line", F.coalesce("hits", F.lit(0)).alias("hits"))
    return fine.groupBy("project", "file", "line").agg(F.max("hits").alias("hits")).groupBy("file", "line").agg(F.sum("hits").alias("hits"))


def replayed(known: DataFrame, reported: DataFrame) -> DataFrame:
    """Known results that a run did not report again, with their state."""
    left = known.join(reported.select("method_fqn"), "method_fqn", "left_anti")
    return left.withColumn("state", F.when(F.col("skipped"), "skipped").when(F.col("passed"), "passed").otherwise("failed"))


def forgotten(known: DataFrame, live: DataFrame) -> DataFrame:
    """Known results of methods that still exist."""
    return known.join(live.select("method_fqn"), "method_fqn", "left_semi")


def synthesised(discovered: DataFrame, failures: DataFrame) -> DataFrame:
    """``(class_fqn, method, passed, skipped, message)``: ``failures(method_fqn, message)`` as they are, everything else of ``discovered(method_fqn)`` as passed; a name that tells no class is no test."""
    rest = discovered.select("method_fqn").distinct().join(failures.select("method_fqn"), "method_fqn", "left_anti")
    both = failures.select("method_fqn", F.lit(False).alias("passed"), "message").union(rest.select("method_fqn", F.lit(True), F.lit(None).cast("string")))
    told = both.withColumn("class_fqn", names.class_of_listed(F.col("method_fqn"))).where("class_fqn is not null")
    return told.select("class_fqn", F.substr("method_fqn", F.length("class_fqn") + 2).alias("method"), "passed", F.lit(False).alias("skipped"), "message")


def build_skips(selected: DataFrame, reach: DataFrame, failed: DataFrame) -> DataFrame:
    """``(class_fqn, method_fqn)`` that can't run: their project reaches (``reach(root, node)``) one whose build failed. Classes without known methods give a row with a null method."""
    bad = reach.join(failed.select(F.col("project").alias("node")), "node", "left_semi").select(F.col("root").alias("project")).distinct()
    return selected.join(bad, "project", "left_semi").select("class_fqn", "method_fqn").distinct()


def diagnostic_owners(diagnostics: DataFrame, owned: DataFrame, projects: DataFrame) -> DataFrame:
    """Diagnostics ``(file, hint, built, ...)`` with ``owner``: the file's project, else the hinted one, else the one that was built."""
    by_name = projects.groupBy(F.lower("name").alias("_n")).agg(F.min("project").alias("by_name"))
    joined = diagnostics.join(owned.select("file", F.col("project").alias("by_file")).dropDuplicates(["file"]), "file", "left").join(by_name, F.lower("hint") == F.col("_n"), "left")
    return joined.withColumn("owner", F.coalesce("by_file", "by_name", "built")).drop("_n", "by_name", "by_file")


def picked_nodes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Test nodes of the classes."""
    return nodes.join(classes.select("class_fqn").distinct(), "class_fqn", "left_semi")


def failure_first(classes: DataFrame, last_failures: DataFrame) -> DataFrame:
    """Classes with ``run_pass``: those that failed last go first."""
    joined = classes.join(last_failures.select("class_fqn", F.lit(0).alias("run_pass")).distinct(), "class_fqn", "left")
    return joined.withColumn("run_pass", F.coalesce("run_pass", F.lit(1))).orderBy("run_pass", "class_fqn")


def failure_location(stack: Column, root: str, shadow: str | None = None) -> Column:
    """(file, line) of the first stack frame below ``root``, whatever the case and slashes; frames below ``shadow`` are as if they were below ``root``."""
    rx = r"(?m)\bin (.+?):line (\d+)"
    files, lines = (F.regexp_extract_all(stack, F.lit(rx), F.lit(i)) for i in (1, 2))
    flat = lambda f: F.rtrim(F.replace(f, F.lit("\\"), F.lit("/")), F.lit("/"))
    home = root.replace("\\", "/").rstrip("/")
    own = (lambda f: paths.remapped(flat(f), F.lit(shadow.replace("\\", "/").rstrip("/")), F.lit(home))) if shadow else flat
    frames = F.arrays_zip(F.transform(files, own).alias("file"), F.transform(lines, lambda x: x.cast("int")).alias("line"))
    return F.get(F.filter(frames, lambda f: (F.lower(f["file"]) == home.lower()) | F.startswith(F.lower(f["file"]), F.lit(home.lower() + "/"))), F.lit(0))


def run_summary(outcomes: DataFrame) -> DataFrame:
    ok = F.col("passed") & ~F.col("skipped")
    return outcomes.agg(F.count_if(ok).alias("passed"), F.count_if(~F.col("passed") & ~F.col("skipped")).alias("failed"), F.count_if(F.col("skipped")).alias("skipped"), F.count("*").alias("total"))


def shared_capabilities(hosts: DataFrame, default: list[str]) -> DataFrame:
    """``(capability)`` that all ``hosts(host, capabilities)`` have; a host that doesn't say has the default ones."""
    own = F.coalesce("capabilities", F.array(*map(F.lit, default)))
    each = hosts.select("host", F.explode(own).alias("capability")).distinct().groupBy("capability").agg(F.count("*").alias("n"))
    total = hosts.agg(F.count_distinct("host").alias("hosts"))  # one row
    return each.join(F.broadcast(total), F.expr("n = hosts")).select("capability")


def push_tally(replies: DataFrame) -> DataFrame:
    """``(push, applied, not_loaded, rejected, patched)`` of ``replies(push, code)``: rejection by one host rejects the push."""
    kind = names.reply_kind(F.col("code"))
    count = lambda k: F.count_if(kind == k)
    return replies.groupBy("push").agg(count("applied").alias("applied"), count("not-loaded").alias("not_loaded"), count("rejected").alias("rejected"), ((count("applied") > 0) & (count("rejected") == 0)).alias("patched"))


def run_ok(invocations: DataFrame) -> DataFrame:
    """``(run, ok)`` of ``invocations(run, ok, cancelled)``: all are fine; cancelled ones are forgiven."""
    return invocations.groupBy("run").agg(F.every(F.col("ok") | F.col("cancelled")).alias("ok"))


def coherent(hosts: DataFrame) -> DataFrame:
    """``(group, coherent)`` of ``hosts(group, generation)``: no host is behind another."""
    return hosts.groupBy("group").agg((F.min("generation") >= F.max("generation")).alias("coherent"))


def steady_median(runs: DataFrame) -> DataFrame:
    """``(op, median_ms, steady_ms)`` of ``runs(op, pass, ms)``: over all passes, and without the first."""
    return runs.groupBy("op").agg(F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.percentile(F.when(F.col("pass") > 1, F.col("ms")), F.lit(0.5)).alias("steady_ms"))


def compared(before: DataFrame, after: DataFrame, noise: float = 3.0) -> DataFrame:
    """``(op, percent, verdict)`` of two results of ``steady_median``; changes within the noise are none."""
    joined = before.select("op", F.col("steady_ms").alias("b")).join(after.select("op", F.col("steady_ms").alias("a")), "op").where("b <> 0")
    percent = (F.col("a") - F.col("b")) / F.col("b") * 100
    return joined.select("op", percent.alias("percent"), F.when(F.abs(percent) <= noise, "same").when(percent < 0, "faster").otherwise("slower").alias("verdict"))


def last_failures(outcomes: DataFrame) -> DataFrame:
    """``(class_fqn)`` whose last outcome by ``seq`` that was not skipped failed."""
    return outcomes.where("not skipped").groupBy("class_fqn").agg(F.max_by("passed", "seq").alias("ok")).where("not ok").select("class_fqn")


def classes_by_project(methods: DataFrame) -> DataFrame:
    """``(project, classes)`` of ``methods(project, method)``."""
    listed = methods.select("project", names.class_of_listed(F.col("method")).alias("c")).where("c is not null")
    return listed.groupBy("project").agg(F.array_sort(F.collect_set("c")).alias("classes"))


def joined_results(results: DataFrame, definitions: DataFrame) -> DataFrame:
    """Outcomes of a report: results ``(test_id, name, outcome, duration, message, stack)`` with the class that ``definitions(test_id, class_fqn)`` has, without its assembly, else that of the name.

    The method is the case's whole name, arguments included; a name without a dot has
    an empty class. Empty messages and durations count as missing. Texts are as an
    XML reader gives them, so nothing is decoded here. All but the class is told
    before the join, as that is shorter than what a report says.
    """
    known = F.nullif(F.substring_index("class_fqn", ",", 1), F.lit(""))
    name, outcome = F.coalesce("name", F.lit("")), F.coalesce("outcome", F.lit(""))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    each = results.select(
        "test_id", name.alias("method"), (outcome == "Passed").alias("passed"), outcome.isin("NotExecuted", "Inconclusive", "Skipped").alias("skipped"),
        filled("message").alias("message"), filled("stack").alias("stack_trace"), F.when(filled("duration").isNotNull(), names.duration_ms(F.col("duration"))).alias("duration_ms"),
    )
    joined = each.join(definitions.where("test_id <> ''").select("test_id", known.alias("_c")).where("_c is not null").dropDuplicates(["test_id"]), "test_id", "left")
    own = F.regexp_extract(names.strip_args(F.col("method")), r"(?s)^(.*)\.[^.]*\z", 1)
    return joined.select(F.coalesce("_c", own).alias("class_fqn"), "method", "passed", "skipped", "message", "stack_trace", "duration_ms")


def best_by_version(paths: DataFrame) -> DataFrame:
    """The one with the highest three-part version of ``paths(path, version)``."""
    parts = F.transform(F.split("version", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return paths.withColumn("_v", F.struct(*[F.get(parts, F.lit(i)).alias(f"p{i}") for i in range(3)])).orderBy(F.desc("_v"), "path").limit(1).drop("_v")


def carried_namespace(lines: DataFrame) -> DataFrame:
    """``(file, line, fqn)`` of the classes that ``lines(file, line, text)`` declare, each with the namespace that was declared last above; the first line of a class counts.

    A declaration begins its line, behind attributes and modifiers; a line that opens
    a namespace declares no class.
    """
    space, cls = (F.nullif(F.regexp_extract("text", rx, 1), F.lit("")) for rx in (NAMESPACE, CLASS))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.select("file", "line", F.when(space.isNull(), cls).alias("cls"), F.last(space, ignorenulls=True).over(w).alias("ns")).where("cls is not null")
    return named.groupBy("file", F.concat_ws(".", "ns", "cls").alias("fqn")).agg(F.min("line").alias("line"))
