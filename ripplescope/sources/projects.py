"""Project files, their graph, source texts, fingerprints and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .tree import TreeSource

# Folders that are never searched, extensions that a build depends on, properties and packages of test projects.
SKIPPED_FOLDERS = ["bin", "obj", "node_modules", ".git", ".vs", paths.STATE_FOLDER, "packages"]
STAMPED_EXTENSIONS = ["cs", "csproj", "props", "targets", "razor", "cshtml", "resx", "config", "json", "xml", "xsl", "xsd", "txt", "sql", "tsql", "csv", "md", "html", "htm", "yml", "yaml"]
OWN_RUNNER_PROPERTIES = ["TestingPlatformDotnetTestSupport", "UseMicrosoftTestingPlatformRunner", "EnableMSTestRunner", "EnableNUnitRunner", "EnableAspireTestingPlatform"]
ADAPTER_PACKAGES = [r"xunit\.runner\.visualstudio", "NUnit3TestAdapter", r"MSTest\.TestAdapter", r"Microsoft\.NET\.Test\.Sdk"]
TEST_PACKAGES = [r"Microsoft\.NET\.Test\.Sdk", 'xunit[^"]*', 'NUnit[^"]*', 'MSTest[^"]*', r'Microsoft\.Testing\.Platform[^"]*']


def _tree(spark: SparkSession, root: str, extensions: list[str], any_case: bool, nested: bool, content: bool) -> DataFrame:
    spark.dataSource.register(TreeSource)
    flag = {True: "true", False: "false"}
    options = {"endings": "/".join("." + e for e in extensions), "skipped": "/".join(SKIPPED_FOLDERS), "any_case": flag[any_case], "nested": flag[nested], "content": flag[content]}
    return spark.read.format("source_tree").options(**options).load(root)


def files_below(spark: SparkSession, root: str, extensions: list[str], any_case: bool = True) -> DataFrame:
    """``(file, modified_ms, size)`` of the files with one of the extensions below ``root``. Folders that are skipped and other repositories, with a ``.git`` of their own, are not listed."""
    return _tree(spark, root, extensions, any_case, False, False).select("file", "modified_ms", "size")


def source_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(file, text)`` of all source files, those of repositories within among them."""
    return _tree(spark, root, ["cs"], True, True, True).select("file", "text")


def project_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(file, text)`` of all project files; the case of their extension counts."""
    return _tree(spark, root, ["csproj"], False, False, True).select("file", "text")


def _has_package(text: Column, names: list[str], whole: bool = True) -> Column:
    """Whether a project file refers to a package of one of the names, or that begins so."""
    return text.rlike(r'(?i)PackageReference\s+Include\s*=\s*"(' + "|".join(names) + (')"' if whole else ")"))


def uses_own_runner(text: Column) -> Column:
    """Whether a project file asks for the platform's own test runner: by a property or its SDK, or by a package without any adapter."""
    props = text.rlike(r"(?i)<(" + "|".join(OWN_RUNNER_PROPERTIES) + r")>\s*true\s*<")
    sdk = text.rlike(r'(?i)Sdk\s*=\s*"MSTest\.Sdk[/"]')
    return props | sdk | (_has_package(text, [r"xunit\.v3"], whole=False) & ~_has_package(text, ADAPTER_PACKAGES))


def is_test_project(text: Column) -> Column:
    return _has_package(text, TEST_PACKAGES) | uses_own_runner(text)


def resolved(dir_: Column, ref: Column) -> Column:
    """``dir/ref`` without ``.`` and ``..``."""
    return paths.folded(F.concat_ws("/", F.nullif(dir_, F.lit("")), ref))


def project_graph(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects and references of ``texts(file, text)`` of project files."""
    dir_ = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]+$", "")
    text = F.col("text")
    assembly = F.nullif(F.trim(F.regexp_extract("text", r"(?i)<AssemblyName>([^<$]+)</AssemblyName>", 1)), F.lit(""))
    projects = texts.select(F.col("file").alias("project"), dir_.alias("dir"), name.alias("name"), F.coalesce(assembly, name).alias("assembly_name"), is_test_project(text).alias("is_test"), uses_own_runner(text).alias("uses_mtp"))
    refs = texts.select(F.col("file").alias("src"), dir_.alias("d"), F.explode(F.regexp_extract_all("text", F.lit(r'(?i)ProjectReference\s+Include\s*=\s*"([^"]+)"'), F.lit(1))).alias("ref"))
    refs = refs.select("src", F.lower(resolved(F.col("d"), F.col("ref"))).alias("k"))
    return projects, refs.join(projects.select(F.col("project").alias("dst"), F.lower("project").alias("k")), "k").select("src", "dst").distinct()


def content_files(spark: SparkSession, root: str) -> DataFrame:
    """``(file, modified_ms, size)`` of all files below ``root`` whose change makes a build stale, contents among them."""
    return files_below(spark, root, STAMPED_EXTENSIONS)


def fingerprints(files: DataFrame) -> DataFrame:
    """``(file, fp)``: time and size."""
    return files.select("file", F.concat_ws(":", F.col("modified_ms").cast("string"), F.col("size").cast("string")).alias("fp"))


def folder_stamps(files: DataFrame) -> DataFrame:
    """``(project, n, newest_ms, digest)`` of ``files(project, file, modified_ms)``: how many, the newest, and a digest of their sorted names."""
    digest = F.substr(F.sha1(F.array_join(F.array_sort(F.collect_list("file")), "\n")), F.lit(1), F.lit(12))
    return files.groupBy("project").agg(F.count("*").alias("n"), F.max("modified_ms").alias("newest_ms"), digest.alias("digest"))


def recordable(stamps: DataFrame, synced_at_ms: int) -> DataFrame:
    """Stamps whose newest source is older than the sync's start."""
    return stamps.where(F.col("newest_ms") < F.lit(synced_at_ms))


def output_tokens(files: DataFrame) -> DataFrame:
    """``(project, newest_ms, token)`` of built files ``(project, name, size, modified_ms)``."""
    each = F.concat_ws(":", "name", F.col("size").cast("string"), F.col("modified_ms").cast("string"))
    return files.groupBy("project").agg(F.max("modified_ms").alias("newest_ms"), F.array_join(F.array_sort(F.collect_list(each)), "|").alias("token"))


def newest_artifacts(files: DataFrame, depth: int = 4) -> DataFrame:
    """``(project, file)``: the newest of ``files(project, file, depth, modified_ms)`` within the depth, reference assemblies aside."""
    fine = files.where((F.col("depth") <= depth) & ~F.col("file").rlike("(?i)(^|/)ref/"))
    return fine.groupBy("project").agg(F.min_by("file", F.struct(-F.col("modified_ms"), F.col("file"))).alias("file"))


def newest_by_framework(files: DataFrame) -> DataFrame:
    """``(project, framework, file)``: the newest in each framework's folder."""
    fine = files.where(~F.col("file").rlike("(?i)(^|/)ref/")).withColumn("framework", F.lower(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)))
    return fine.groupBy("project", "framework").agg(F.min_by("file", F.struct(-F.col("modified_ms"), F.col("file"))).alias("file"))
