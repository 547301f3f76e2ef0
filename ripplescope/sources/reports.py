"""Readers of XML reports, with Spark's XML source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

COVERAGE = "_filename string, lines struct<line:array<struct<_number:string,_hits:string>>>"
RESULT = "_testId string, _testName string, _outcome string, _duration string, Output struct<ErrorInfo:struct<Message:string,StackTrace:string>>"
DEFINITION = "_id string, TestMethod struct<_className:string>"
#: Bytes of reports, as they lie in their files, whose results one task reads or whose lines it adds up.
TASK_BYTES = 1 << 24


def _read(spark: SparkSession, path: str, tag: str, schema: str, *suffixes: str) -> DataFrame:
    """Rows of one tag in all files below ``path`` with one of the suffixes, whatever its case."""
    rows = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("report")).where(F.lower("report").rlike("(" + "|".join(map(re.escape, suffixes)) + r")\z"))


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``, which can be a pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(f.getPath()).getLength() for f in fs.globStatus(where) or [])


def line_hits(spark: SparkSession, path: str) -> DataFrame:
    """``(report, file, line, hits)``, the most where lines overlap; lines that aren't numbers above 0 are left out, missing hits are 0.

    Lines are dealt by file and line into parts by the size of the reports, as
    their rows compress so well that parts by shuffled bytes hold millions; who adds
    hits over reports needs no further shuffle.
    """
    rows = _read(spark, path, "class", COVERAGE, ".cobertura.xml")
    each = rows.select("report", F.replace("_filename", F.lit("\\"), F.lit("/")).alias("file"), F.explode("lines.line").alias("x"))
    each = each.select("report", "file", F.col("x._number").try_cast("int").alias("line"), F.coalesce(F.col("x._hits").try_cast("long"), F.lit(0)).alias("hits")).where("line > 0 and file is not null")
    parts = max(spark.sparkContext.defaultParallelism, _size(spark, path) // TASK_BYTES + 1)
    return each.repartition(parts, "file", "line").groupBy("report", "file", "line").agg(F.max("hits").alias("hits"))


def hit_files(spark: SparkSession, path: str) -> DataFrame:
    return line_hits(spark, path).where("hits > 0").select("file").distinct()


def test_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of result files, compressed ones (``.trx.gz``) too, by the rules of ``joined_results``. The XML source has decoded entities."""
    from ..operators.results import joined_results

    parts = max(spark.sparkContext.defaultParallelism, _size(spark, path) // TASK_BYTES + 1)
    results = _read(spark, path, "UnitTestResult", RESULT, ".trx", ".trx.gz").coalesce(parts).select(F.col("_testId").alias("test_id"), F.col("_testName").alias("name"), F.col("_outcome").alias("outcome"), F.col("_duration").alias("duration"), F.col("Output.ErrorInfo.Message").alias("message"), F.col("Output.ErrorInfo.StackTrace").alias("stack"))
    definitions = _read(spark, path, "UnitTest", DEFINITION, ".trx", ".trx.gz").coalesce(parts).select(F.col("_id").alias("test_id"), F.col("TestMethod._className").alias("class_fqn"))
    return joined_results(results, definitions)


def source_roots(spark: SparkSession, path: str) -> DataFrame:
    """``(report, pos, dir)``: the source folders that coverage files name, in their order."""
    rows = _read(spark, path, "sources", "source array<string>", ".cobertura.xml")
    return rows.select("report", F.posexplode("source").alias("pos", "dir"))


def resolved_files(hits: DataFrame, roots: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """``hits(report, file, ...)`` with files relative to ``root``.

    A relative file is below the first of its report's source folders where it
    exists, by ``existing(path)`` of absolute files, else below ``root``; one that is
    then outside of ``root`` keeps its absolute path.
    """
    absolute = F.col("file").rlike(r"^(/|[A-Za-z]:)")
    there = existing.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct()
    tried = hits.where(~absolute).select("report", "file").distinct().join(roots, "report")
    tried = tried.select("report", "file", "pos", F.concat(F.rtrim(F.replace("dir", F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"), "file").alias("path")).join(there, "path", "left_semi")
    found = tried.groupBy("report", "file").agg(F.min_by("path", "pos").alias("path"))
    whole = F.when(absolute, F.col("file")).otherwise(F.coalesce("path", F.concat(F.lit(root.rstrip("/") + "/"), "file")))
    return hits.join(found, ["report", "file"], "left").withColumn("file", paths.relative(whole, F.lit(root))).drop("path")


def collector_settings(assemblies: list[str]) -> str:
    """The settings file that lets both coverage collectors see only these assemblies."""
    from xml.etree import ElementTree

    top = ElementTree.Element("RunSettings")
    collectors = ElementTree.SubElement(ElementTree.SubElement(top, "DataCollectionRunSettings"), "DataCollectors")
    inside = lambda node, *tags: inside(ElementTree.SubElement(node, tags[0]), *tags[1:]) if tags else node
    own = inside(collectors, "DataCollector", "Configuration")
    collectors[0].set("friendlyName", "Code Coverage")
    inside(own, "Format").text = "cobertura"
    modules = inside(own, "CodeCoverage", "ModulePaths", "Include")
    for name in assemblies:
        escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", name)
        inside(modules, "ModulePath").text = rf".*[/\\]{escaped}\.(dll|exe)$"
    other = inside(collectors, "DataCollector", "Configuration")
    collectors[1].set("friendlyName", "XPlat Code Coverage")
    inside(other, "Include").text = ",".join(f"[{name}]*" for name in assemblies)
    return ElementTree.tostring(top, encoding="unicode", xml_declaration=True)
