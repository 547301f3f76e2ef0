"""Parsers, names, reports, snapshots, streams."""

import gzip
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ripplescope.functions import names, paths
from ripplescope.operators import results, selection
from ripplescope.plans import catalogue, workspace
from ripplescope.sources import projects, records, reports, shared
from ripplescope.sources.shared import Snapshots
from ripplescope.streaming import batching


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (names.strip_args, "A.B(1, (2))", "A.B"), (names.class_of_listed, "Ns.C.M(1.5)", "Ns.C"), (names.class_of_listed, "not a name", None), (names.class_of_listed, "Ns.C<T>.M(a.b)", "Ns.C<T>"), (names.class_of_listed, "C.M", "C"), (names.class_of_listed, ".M", None), (names.class_of_run, "Ns.C.M(a.b)", "Ns.C"), (names.class_of_run, "plain", "plain"), (names.class_of_run, "a).B.C.M", "a).B.C"), (names.class_of_run, "Ns.Fix(1.5).M(2)", "Ns.Fix(1.5)"),
        (names.strip_nesting, "Ns.Outer+Inner", "Ns.Inner"), (names.decode_entities, "&amp;lt; &lt;", "&lt; <"), (names.duration_ms, "00:00:01.5", 1500.0), (names.duration_ms, "x", 0.0), (names.stamp_newest_ms, "3:42:x", 42.0),
        (names.stamp_newest_ms, "bad", float("inf")), (names.polynomial_hash, "hello", 99162322), (names.polynomial_hash, "", 0), (names.escape_regex, "a.b", "a\\.b"), (names.short_name, "A.B`1", "B"), (names.bare_name, "A.B<C>", "A.B"),
        (paths.watchable, "src/a.cs", True), (paths.watchable, "src/obj/a.cs", False), (paths.watchable, "src/a.json", False), (paths.watchable, "a\\Node_Modules\\b.cs", False), (paths.watchable, "src/a.Razor", True), (paths.fallback_eligible, "a/x.XML", True), (paths.fallback_eligible, "a/x.sln", False), (paths.fallback_eligible, "a/xxml", False), (paths.in_repo_tree, "x/bin/y.cs", False), (paths.in_repo_tree, "x/binary/y.cs", True), (paths.overlay_skipped, "a/node_modules/b", True), (paths.overlay_skipped, "a/.ripplescope/b", True), (paths.overlay_skipped, "a/TestResults/b", False),
        (projects.is_test_project, '<PackageReference Include="xunit" Version="2"/>', True), (projects.is_test_project, '<PackageReference Include="Microsoft.Testing.Platform.MSBuild"/>', True), (projects.is_test_project, '<PackageReference Include="Moq"/>', False), (projects.is_test_project, "<EnableNUnitRunner> true </EnableNUnitRunner>", True),
        (projects.uses_own_runner, '<PackageReference Include="xunit.v3"/><PackageReference Include="Microsoft.NET.Test.Sdk"/>', False), (projects.uses_own_runner, '<PackageReference Include="xunit.v3.core"/>', True), (projects.uses_own_runner, "<EnableAspireTestingPlatform>true</EnableAspireTestingPlatform>", True), (projects.uses_own_runner, '<Project Sdk="MSTest.Sdk/3.6">', True),
        (lambda x: names.is_test_class(x, F.array(F.lit("FactAttribute")), F.lit(True)), "Ns.C", True), (lambda x: names.is_test_class(x, F.array(F.lit("FactAttribute")), F.lit(False)), "Ns.C", False), (lambda x: names.is_test_class(x, F.array(F.lit("TestAttribute")), F.lit(True)), "Ns.<C>d", False), (lambda x: names.is_test_class(x, F.array(F.lit("Obsolete")), F.lit(True)), "Ns.C", False),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_paths(spark):
    assert one(spark, "a/b/c.cs", paths.ancestors) == ["a/b", "a", ""]
    assert one(spark, "C:\\Shadow\\src\\a.cs", lambda x: paths.remapped(x, F.lit("c:/shadow"), F.lit("/repo"))) == "/repo/src/a.cs"
    assert one(spark, "/r/x/y.cs", lambda x: paths.relative(x, F.lit("/r"))) == "x/y.cs"
    assert one(spark, "src", lambda x: projects.resolved(x, F.lit("..\\lib\\./L.csproj"))) == "lib/L.csproj"


def test_registrations(spark):
    text = "services.AddScoped<IFoo, Foo>(); s.TryAddSingleton<IQux, Qux<int>>(); s.AddSingleton< IBar >( new Ns.Bar(x)); s.AddSingleton<INo>(sp => new No(sp)); RegisterType<IReg, Reg>(); s.AddTransient<Foo, Foo>(); services.AddScoped<IFoo, Foo>();"
    assert [tuple(p) for p in one(spark, text, names.registrations)] == [("IFoo", "Foo"), ("IQux", "Qux<int>"), ("IReg", "Reg"), ("IBar", "Ns.Bar")]


def test_record_formats(spark):
    raw = spark.createDataFrame([("a", " M f1\x00R  new\x00old\x00?? q\x00x\x00"), ("e", "")], "id string, text string")
    assert [tuple(r) for r in records.status_records(raw).collect()] == [("a", " M", "f1", None), ("a", "R ", "new", "old"), ("a", "??", "q", None)]
    raw = spark.createDataFrame([("a", "M\x00f1\x00R100\x00old\x00new\x00A\x00z\x00")], "id string, text string")
    assert [tuple(r) for r in records.name_status_records(raw).collect()] == [("a", "M", "f1", None), ("a", "R100", "new", "old"), ("a", "A", "z", None)]
    raw = spark.createDataFrame([("m", "x\nthe Following tests are available:\n    A.B.C(1, 2)\n\tbare\nA.B\n"), ("n", "A.B.C\nA.B\nnoise here\nA.B.dll\nA.G<T>.M"), ("f", "The following Tests are available:\n  A.B")], "id string, text string")
    assert sorted(tuple(r) for r in records.listed_tests(raw).collect()) == [("f", "A.B"), ("m", "A.B"), ("m", "A.B.C"), ("n", "A.B.C"), ("n", "A.G<T>.M")]
    assert {r["id"]: r["bare"] for r in records.has_bare_names(raw).collect()} == {"m": True, "n": False, "f": False}


def test_run_output_and_messages(spark):
    raw = spark.createDataFrame([("r", "failed A.B (3ms)\n  one\n  two\npassed C\n  no\nTest run summary:\n  total: 3\n  failed: 1\nfailed: 9"), ("s", "Total: 3\nin total: 4\nfailed: 1")], "id string, text string")
    failures, counts = records.run_output(raw)
    assert [tuple(r) for r in failures.collect()] == [("r", "A.B", "one\ntwo")]
    assert sorted(tuple(r) for r in counts.collect()) == [("r", "failed", 1), ("r", "skipped", 0), ("r", "succeeded", 0), ("r", "total", 3)]
    raw = spark.createDataFrame([("b", "a.cs(3,5): error CS1: bad [p.csproj]\na.cs(3,5): error CS1: bad [p.csproj]\nMSB : warning MSB1: odd\nC:\\x (86)\\b.cs(1,2,3,4) : warning AB12: w[x] [q]\nerror CS9: no file\na.cs(1,1): error cs1: low")], "id string, text string")
    got = sorted((r["file"], r["start_line"], r["start_col"], r["severity"], r["code"], r["message"], r["project"]) for r in records.build_messages(raw).collect())
    assert got == [("C:\\x (86)\\b.cs", 0, 1, "warning", "AB12", "w[x]", "q"), ("MSB", 0, 0, "warning", "MSB1", "odd", None), ("a.cs", 2, 4, "error", "CS1", "bad", "p.csproj")]
    assert {(r["end_line"], r["end_col"]) for r in records.build_messages(raw).where("code = 'AB12'").collect()} == {(2, 3)}


def test_declarations_and_command_line(spark):
    raw = spark.createDataFrame([("f", "namespace A.B;\nclass X {}\nnamespace C {\n public class Y\n class Y\n")], "id string, text string")
    assert sorted(tuple(r) for r in records.declarations(raw).collect()) == [("f", "A.B.X", 1), ("f", "C.Y", 3)]
    raw = spark.createDataFrame([("f", "class X {\n  public void Run() {}\n  private int Run(int x) => Other<int>(x);\n void Bare() {}")], "id string, text string")
    wanted = spark.createDataFrame([("f", m) for m in ("Run", "Other", "Bare", "None")], "id string, method string")
    assert sorted(tuple(r) for r in records.method_lines(raw, wanted).collect()) == [("f", "Other", 2), ("f", "Run", 1)]
    assert records.command_line(["affected", "a.cs", "--format=json", "--ci"]) == {"command": "affected", "files": ["a.cs"], "format": "json", "ci": True}
    for bad in (["what"], ["status", "x"], ["affected", "--base"], ["run", "--nope"]):
        with pytest.raises(ValueError, match=r"."):
            records.command_line(bad)


def test_build_messages_cast_no_empty_places(spark):
    """An empty text would make an error for each cast; places that are missing or beyond an int are as before."""
    text = "a.cs(3,4): error CS1: x\nb.cs(3,4,5,6): warning CS2: y\x01z [p.csproj]\nMSB : error MSB1: w\nc.cs(99999999999,2): error CS3: v"
    found = records.build_messages(spark.createDataFrame([("1", text)], "id string, text string"))
    assert not re.search(r"try_cast\((get\()?f#\d+", found._jdf.queryExecution().analyzed().toString())
    got = sorted((r["file"], r["start_line"], r["start_col"], r["end_line"], r["end_col"], r["code"], r["message"], r["project"]) for r in found.collect())
    assert got == [("MSB", 0, 0, 0, 0, "MSB1", "w", None), ("a.cs", 2, 3, 2, 3, "CS1", "x", None), ("b.cs", 2, 3, 4, 5, "CS2", "y z", "p.csproj"), ("c.cs", 0, 1, 0, 1, "CS3", "v", None)]


def test_parts_of_report_lines_grow_with_the_reports(spark, tmp_path, monkeypatch):
    """One shuffle, by file and line, for the most in a report and the sum over reports."""
    for i in range(20):
        lines = "".join(f'<line number="{n}" hits="{i + n}"/><line number="{n}" hits="1"/>' for n in range(1, 30))
        (tmp_path / f"r{i}.cobertura.xml").write_text(f'<coverage><packages><package><classes><class filename="a.cs"><lines>{lines}</lines></class></classes></package></packages></coverage>')
    size = sum(p.stat().st_size for p in tmp_path.glob("*.xml"))
    monkeypatch.setattr(reports, "TASK_BYTES", size // 40)
    added = results.merged_hits(reports.line_hits(spark, str(tmp_path)).withColumnRenamed("report", "project"))
    assert added._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert added.rdd.getNumPartitions() >= 40
    assert sorted((r["line"], r["hits"]) for r in added.collect()) == [(n, sum(i + n for i in range(20))) for n in range(1, 30)]


def test_files_are_written_in_pieces(spark):
    """A file's rows follow each other over batches of any size; rows without a name or a text are left out."""
    tables = catalogue.Tables(spark, "/none")
    rows = [(f"d/f{n}", f"{n}:{i} ") for n in range(3) for i in range(25)] + [(None, "x"), ("d/none", None)]
    former = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        base = workspace._written(tables, "pieces", spark.createDataFrame(rows, "file string, text string").coalesce(1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", former)
    got = {r["path"].rpartition("/")[2]: bytes(r["content"]).decode() for r in spark.read.format("binaryFile").load(f"{base}/d").select("path", "content").collect()}
    assert got == {f"f{n}": "".join(f"{n}:{i} " for i in range(25)) for n in range(3)}


def test_result_files_take_little_disk(spark, tmp_path, monkeypatch):
    """Result files are written compressed and read so, as others are; what was shuffled to write them is gone once they stand."""
    text = '<TestRun><Results><UnitTestResult testId="1" testName="A.B.%s" outcome="Passed"/></Results></TestRun>'
    with gzip.open(tmp_path / "a.TRX.gz", "wt") as out:
        out.write(text % "zipped")
    (tmp_path / "b.trx").write_text(text % "plain")
    (tmp_path / "c.trxx.gz").write_bytes((tmp_path / "a.TRX.gz").read_bytes())
    assert sorted(r["method"] for r in reports.test_outcomes(spark, str(tmp_path)).collect()) == ["A.B.plain", "A.B.zipped"]
    bases, written = [], workspace._written
    monkeypatch.setattr(workspace, "_written", lambda *a: bases.append(written(*a)) or bases[-1])
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(os.path.getsize(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and os.path.exists(f))
    setting, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), shuffled()
    found = workspace.result_outcomes(catalogue.Tables(spark, "/root/testdata/sf0.001"))
    until = time.time() + 20
    while time.time() < until and shuffled() - before > 20_000:  # files are deleted behind the query's back
        time.sleep(0.2)
    assert shuffled() - before <= 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    size = spark.read.format("binaryFile").load(bases[0]).selectExpr("sum(length)").head()[0]
    assert 0 < size < 40 * found.count()


def test_xml_reports(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/A.COBERTURA.xml").write_text('<coverage><packages><package><classes><class filename="src\\Hit.cs"><lines><line number="1" hits="3"/><line number="1" hits="5"/><line number="2"/><line number="0" hits="9"/><line number="x" hits="9"/></lines></class><class filename="src/Cold.cs"><lines><line number="1" hits="0"/></lines></class></classes></package></packages></coverage>')
    got = sorted((r["file"], r["line"], r["hits"]) for r in reports.line_hits(spark, str(tmp_path)).collect())
    assert got == [("src/Cold.cs", 1, 0), ("src/Hit.cs", 1, 5), ("src/Hit.cs", 2, 0)]
    assert [r["file"] for r in reports.hit_files(spark, str(tmp_path)).collect()] == ["src/Hit.cs"]
    (tmp_path / "deep/B.cobertura.xml").write_text('<coverage><sources><source>/a/</source><source>/r/src</source></sources><packages><package><classes><class filename="x.cs"><lines><line number="1" hits="1"/></lines></class><class filename="gone.cs"><lines><line number="2" hits="1"/></lines></class><class filename="/sdk/y.cs"><lines><line number="3" hits="1"/></lines></class></classes></package></packages></coverage>')
    existing = spark.createDataFrame([("/r/src/x.cs",), ("/r/gone.cs",)], "path string")
    found = reports.resolved_files(reports.line_hits(spark, str(tmp_path)), reports.source_roots(spark, str(tmp_path)), existing, "/r/")
    assert {r["file"] for r in found.where("report like '%B.cobertura.xml'").collect()} == {"src/x.cs", "gone.cs", "/sdk/y.cs"}
    assert "<ModulePath>.*[/\\\\]A\\.B\\.(dll|exe)$</ModulePath>" in reports.collector_settings(["A.B", "C"]) and "<Include>[A.B]*,[C]*</Include>" in reports.collector_settings(["A.B", "C"])
    (tmp_path / "r.trx").write_text('<TestRun><Results><UnitTestResult testId="1" testName="M" outcome="Passed" duration="00:00:01.5"/><UnitTestResult testId="2" testName="Ns.D.Bad(1)" outcome="Failed"><Output><ErrorInfo><Message>a &amp;lt; b</Message><StackTrace>at X in /repo/a.cs:line 7</StackTrace></ErrorInfo></Output></UnitTestResult></Results><TestDefinitions><UnitTest id="1"><TestMethod className="Ns.C" name="M"/></UnitTest></TestDefinitions></TestRun>')
    got = {r["method"]: r for r in reports.test_outcomes(spark, str(tmp_path)).collect()}
    assert got["M"]["class_fqn"] == "Ns.C" and got["M"]["duration_ms"] == 1500.0 and got["M"]["passed"] and got["M"]["message"] is None
    assert got["Ns.D.Bad(1)"]["message"] == "a &lt; b" and got["Ns.D.Bad(1)"]["duration_ms"] is None
    assert got["Ns.D.Bad(1)"]["class_fqn"] == "Ns.D" and not got["Ns.D.Bad(1)"]["passed"]
    where = one(spark, "at Y in C:\\other\\b.cs:line 3\n at X in /Repo/a.cs:line 7", lambda x: results.failure_location(x, "/repo"))
    assert (where["file"], where["line"]) == ("/Repo/a.cs", 7)
    where = one(spark, "at Y in C:\\Shadow\\src\\b.cs:line 3\n at X in /repo/a.cs:line 7", lambda x: results.failure_location(x, "/repo", "c:/shadow/"))
    assert (where["file"], where["line"]) == ("/repo/src/b.cs", 3)


def test_project_files(spark, tmp_path):
    for name, text in {"src/L.csproj": "<Project></Project>", "tests/T.csproj": '<PackageReference Include="Microsoft.NET.Test.Sdk"/><ProjectReference Include="..\\src\\L.csproj"/>', "src/bin/X.csproj": "", "src/data.json": "{}", "packages/P.csproj": "", ".ripplescope/S.csproj": "", "nested/.git/HEAD": "x", "nested/N.csproj": "<Project/>"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    texts = projects.project_texts(spark, str(tmp_path))
    found, refs = projects.project_graph(texts)
    assert {r["project"]: (r["dir"], r["is_test"]) for r in found.collect()} == {"src/L.csproj": ("src", False), "tests/T.csproj": ("tests", True)}
    assert [tuple(r) for r in refs.collect()] == [("tests/T.csproj", "src/L.csproj")]
    assert projects.fingerprints(projects.files_below(spark, str(tmp_path), ["csproj"])).count() == 2
    assert {r["file"] for r in projects.content_files(spark, str(tmp_path)).collect()} == {"src/L.csproj", "src/data.json", "tests/T.csproj"}


def test_snapshots(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1")], "file string, fp string")
    store = Snapshots(spark, str(tmp_path / "state"), frame.schema)
    assert store.load().count() == 0
    store.save(frame)
    store.save(store.load().union(store.load()))
    assert store.load().count() == 2
    assert Snapshots(spark, str(tmp_path / "state"), frame.schema, version=2).load().count() == 0
    (tmp_path / "state/current.json").write_text("{")
    (tmp_path / "state/.current.json.crc").unlink(missing_ok=True)
    assert store.load().count() == 0


def test_debounce_boundary(spark):
    rows = [("k", t * 1000, i, f) for i, (t, f) in enumerate([(0, "A"), (400, "B"), (800, "C"), (1800, "D")])]
    got = sorted((r["batch"], r["n_files"], r["due_us"]) for r in batching.batches(spark.createDataFrame(rows, "key string, us long, seq long, file string"), 1_000_000).collect())
    assert got == [(1, 3, 1_800_000), (2, 1, 2_800_000)]


def test_pauses(spark):
    """A second pause begins none, and takes up no aborted run; a resume while on frees nothing."""
    rows = [("k", i, i, kind, f, a) for i, (kind, f, a) in enumerate([("resume", None, None), ("change", "x", None), ("pause", None, ["A", "B"]), ("change", "A", None), ("pause", None, ["Z"]), ("change", "C", None), ("resume", None, None), ("resume", None, None), ("pause", None, []), ("resume", None, None), ("pause", None, None), ("change", "D", None)])]
    frame = spark.createDataFrame(rows, "key string, us long, seq long, kind string, file string, aborted array<string>")
    assert sorted(tuple(r) for r in batching.paused(frame).collect()) == [("k", 1, 6, 3, False), ("k", 2, 9, 0, True)]
    assert sorted(tuple(r) for r in batching.paused(frame.drop("aborted")).collect()) == [("k", 1, 6, 2, False)]


def test_remembered_saves(spark):
    saves = spark.createDataFrame([(f"f{i}", i * 100) for i in range(6)] + [("f0", 5)], "file string, us long")
    assert batching.remembered_saves(saves, 600, 20, most=10).count() == 6
    assert sorted(r["file"] for r in batching.remembered_saves(saves, 600, 20, most=3).collect()) == ["f4", "f5"]


def test_kept_tables(spark, tmp_path):
    store = shared.state(spark, str(tmp_path), "last_failures")
    store.save(spark.createDataFrame([("Ns.C",)], "class_fqn string"))
    assert [r["class_fqn"] for r in shared.state(spark, str(tmp_path), "last_failures").load().collect()] == ["Ns.C"]


def test_streaming_debounce(spark, tmp_path):
    source, name = tmp_path / "in", "debounced"
    schema = "key string, file string"
    spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b")], schema).write.parquet(str(source))
    stream = batching.stream_debounced(spark.readStream.schema(schema).parquet(str(source)), 500)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table(name).count():
            time.sleep(0.5)
        assert [(r["key"], r["files"]) for r in spark.table(name).collect()] == [("k", ["a", "b"])]
    finally:
        q.stop()


def test_refresh_order_and_comparison(spark):
    queue = spark.createDataFrame([("A", 2), ("B", 1)], "class_fqn string, seq long")
    scored = spark.createDataFrame([("A", 9), ("C", 5), ("D", 7)], "class_fqn string, score long")
    tried = spark.createDataFrame([("D",)], "class_fqn string")
    assert [r["class_fqn"] for r in batching.refresh_order(queue, scored, tried).orderBy("place").collect()] == ["B", "A", "C"]
    a = spark.createDataFrame([("x", 100.0), ("y", 100.0), ("z", 100.0)], "op string, steady_ms double")
    b = spark.createDataFrame([("x", 102.0), ("y", 90.0), ("z", 110.0)], "op string, steady_ms double")
    assert {r["op"]: r["verdict"] for r in results.compared(a, b).collect()} == {"x": "same", "y": "faster", "z": "slower"}


def test_definitions_and_names_of_results(spark):
    """The class is the definition's, without its assembly, else the name's; a name without a dot tells none."""
    shape = "test_id string, name string, outcome string, duration string, message string, stack string"
    found = spark.createDataFrame([("1", "M(a.b)", "Passed", None, None, None), ("2", "A.B.M(x: 1.5)", "Failed", "bad", "m&lt;", ""), ("3", "plain", "NotExecuted", "", "", None), (None, "A.Q.R", None, "1:00:00", None, None), ("4", "A.M", "Inconclusive", None, None, None)], shape)
    known = spark.createDataFrame([("1", "Ns.C, My.Tests, Version=1"), ("1", "Ns.C, My.Tests, Version=1"), ("4", ""), ("", "X")], "test_id string, class_fqn string")
    got = sorted(tuple(r) for r in results.joined_results(found, known).collect())
    assert got == [("", "plain", False, True, None, None, None), ("A", "A.M", False, True, None, None, None), ("A.B", "A.B.M(x: 1.5)", False, False, "m&lt;", None, 0.0), ("A.Q", "A.Q.R", False, False, None, None, 3600000.0), ("Ns.C", "M(a.b)", True, False, None, None, None)]


def test_reports_of_methods(spark):
    """Failed cases are named, one that says nothing has failed, and a skip of a whole class is no method."""
    shape = "seq long, class_fqn string, method string, passed boolean, skipped boolean, message string, duration_ms double"
    frame = spark.createDataFrame([(2, "C", "C.M(2)", False, False, None, 1.0), (1, "C", "C.M(1)", False, False, "bad", None), (3, "C", "C.M(3)", True, False, "fine", 2.0), (4, "D", "D", False, True, None, None), (5, "C", "C.N", False, True, "why", None)], shape)
    got = sorted(tuple(r) for r in results.method_report(frame).collect())
    assert got == [("C", "C.M", 3.0, False, False, "C.M(1): bad\nC.M(2): failed"), ("C", "C.N", 0.0, True, True, None)]


def test_synthesised(spark):
    discovered = spark.createDataFrame([(m,) for m in ("A.B.M", "A.B.N(1.5)", "noise", "Adds", "A.B.F")], "method_fqn string")
    failed = spark.createDataFrame([("A.B.F", "bad"), ("chatter", "x")], "method_fqn string, message string")
    got = sorted(tuple(r) for r in results.synthesised(discovered, failed).collect())
    assert got == [("A.B", "F", False, False, "bad"), ("A.B", "M", True, False, None), ("A.B", "N(1.5)", True, False, None)]


def test_hosts_and_filters(spark):
    raw = spark.createDataFrame([("a", " pipe-1 \r\nBaseline\tAddMethod \nmore"), ("b", "pipe-2"), ("c", ""), ("d", "p\n \n")], "id string, text string")
    assert {r["id"]: (r["pipe"], r["capabilities"]) for r in records.host_registrations(raw).collect()} == {"a": ("pipe-1", ["Baseline", "AddMethod"]), "b": ("pipe-2", None), "c": ("", None), "d": ("p", None)}
    got = spark.createDataFrame([(["N.B(x)", "N.A\\q", "N.B(x)"],)], "c array<string>").select(names.class_filter(F.col("c")).alias("f")).head()["f"]
    each = ["FullyQualifiedName~N.B\\(x\\).|FullyQualifiedName~N.B\\(x\\)+", "FullyQualifiedName~N.A\\q.|FullyQualifiedName~N.A\\q+"]
    assert got == "|".join([*each, each[0]])


def test_anchored_declarations(spark):
    text = "// the class under test\nnamespace N.M;\n// class Not\n[Fact] [X(1)] public sealed partial class A : B\nvar x = new { @class = 1 }; class Z\nnamespace O { class P {}\n  internal class Q\nstatic class R\nfile class S"
    raw = spark.createDataFrame([("f", text)], "id string, text string")
    assert sorted((r["fqn"], r["line"]) for r in records.declarations(raw).collect()) == [("N.M.A", 3), ("O.Q", 6), ("O.R", 7)]


def test_messages_lose_tabs_and_listing_files(spark):
    raw = spark.createDataFrame([("r", "failed A.B (3ms)\n\tone\t \n \u00a0two\n")], "id string, text string")
    assert [tuple(r) for r in records.run_output(raw)[0].collect()] == [("r", "A.B", "one\ntwo")]
    raw = spark.createDataFrame([("f", "C.M\r\n\tA.B.C(1, 2)\nbare\nA.B.C\n.x\nhas space.y")], "id string, text string")
    assert sorted(r["test"] for r in records.named_tests(raw).collect()) == ["A.B.C", "C.M"]


def test_messages_below_a_folder(spark):
    raw = spark.createDataFrame([("b", "src/../a.cs(3,5): error CS1: bad\nC:\\x\\b.cs(1,2): warning AB12: w\n/r/c.cs(1,2): warning AB12: w")], "id string, text string")
    assert sorted(r["file"] for r in records.build_messages(raw, "/build").collect()) == ["/build/a.cs", "/r/c.cs", "C:\\x\\b.cs"]


def test_long_records_take_linear_time(spark):
    """One text of 10 MB; ten times the records take about ten times as long, not a hundred."""
    def text(n):
        return "".join(f"R100\x00from/{i:08d}\x00to/{i:08d}\x00M\x00R{i:020d}\x00" for i in range(n))

    took = {}
    for n in (20_000, 200_000):
        raw = spark.createDataFrame([("a", text(n))], "id string, text string").cache()
        raw.count()
        began = time.time()
        told = records.name_status_records(raw).agg(F.count("*").alias("n"), F.count("origin").alias("moved"), F.max("file").alias("last")).head()
        took[n] = time.time() - began
        assert tuple(told) == (2 * n, n, f"to/{n - 1:08d}")
    assert len(text(200_000)) > 10_000_000 and took[200_000] < 30 * max(took[20_000], 0.5)
    raw = spark.createDataFrame([("a", "\x00".join(["R  x", "y"] * 200_000))], "id string, text string")
    assert records.status_records(raw).where("origin = 'y'").count() == 200_000


def test_trees(spark, tmp_path):
    """Hidden and empty files count; other repositories, by a .git file or folder, and skipped folders don't."""
    made = {"src/a.cs": "class A {}", "src/empty.cs": "", "_gen/d.cs": "d", ".hid/e.cs": "e", "src/Obj/o.cs": "o", "nested/.git/HEAD": "x", "nested/b.cs": "b", "sub/.git": "gitdir: x", "sub/c.cs": "c", "sub/deep/c.cs": "c", ".git/x.cs": "x", "UP.CS": "é", "src/b.csx": "", "deep/1/2/3/4/f.cs": "f", "a b/q%20.cs": "q", "p.csproj": "<P/>", "P.CSPROJ": "", "src/data.JSON": "{}"}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    own = {"src/a.cs", "src/empty.cs", "_gen/d.cs", ".hid/e.cs", "UP.CS", "deep/1/2/3/4/f.cs", "a b/q%20.cs"}
    for root in (str(tmp_path), tmp_path.as_uri() + "/", f"file:{tmp_path}"):
        found = {r["file"]: (r["size"], r["modified_ms"]) for r in projects.files_below(spark, root, ["cs"]).collect()}
        assert set(found) == own
        assert found["src/empty.cs"][0] == 0 and found["UP.CS"] == (2, round((tmp_path / "UP.CS").stat().st_mtime_ns / 1e6))
    texts = {r["file"]: r["text"] for r in projects.source_texts(spark, str(tmp_path)).collect()}
    assert set(texts) == own | {"nested/b.cs", "sub/c.cs", "sub/deep/c.cs"} and texts["UP.CS"] == "é" and texts["src/empty.cs"] == ""
    assert [r["file"] for r in projects.project_texts(spark, str(tmp_path)).collect()] == ["p.csproj"]
    assert {r["file"] for r in projects.content_files(spark, str(tmp_path)).collect()} == own | {"p.csproj", "P.CSPROJ", "src/data.JSON"}
    before = projects.fingerprints(projects.content_files(spark, str(tmp_path))).collect()
    (tmp_path / "src/a.cs").write_text("")
    after = projects.fingerprints(projects.content_files(spark, str(tmp_path)))
    shape = "file string, fp string"
    assert [tuple(r) for r in selection.snapshot_diff(spark.createDataFrame(before, shape), after).collect()] == [("src/a.cs", "edited")]  # emptied, not deleted
    assert projects.files_below(spark, str(tmp_path / "none"), ["cs"]).count() == 0
    assert projects.files_below(spark, str(tmp_path), ["nothing"]).count() == 0


def test_trees_are_dealt_out(tmp_path):
    from ripplescope.sources.tree import Tree, TreeReader

    for i in range(40):
        for name in (f"d{i}/x/{i}.cs", f"d{i}/{i}.cs", "bin/x.cs"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("")
    for parts in (1, 8, 64, 500):
        options = {"path": str(tmp_path), "endings": ".cs", "skipped": "bin", "parts": str(parts)}
        reader = TreeReader(options)
        dealt = reader.partitions()
        assert len(dealt) <= parts
        assert sorted(r[0] for p in dealt for r in reader.read(p)) == sorted([f"d{i}/x/{i}.cs" for i in range(40)] + [f"d{i}/{i}.cs" for i in range(40)])
    listed = []
    tree = Tree({"path": str(tmp_path), "endings": ".cs", "skipped": "bin"})
    whole = tree.listed
    tree.listed = lambda folder: listed.append(folder) or whole(folder)
    assert len(list(tree.walk(tree.root))) == 80 and not any(f.endswith("bin") for f in listed)


def test_failures_of_long_runs_stay_in_their_row(spark):
    """At most eight lines of each, up to the first that isn't indented; no line is shuffled."""
    rng = random.Random(4)
    lines = [rng.choice(["failed N.A%d (1ms)" % i, "  said %d" % i, "\t x ", "   ", "", "passed", " failed N.B (2ms)", "failed N.C"]) for i in range(3000)] + ["failed N.Last (1ms)", *[f"  l{i}" for i in range(12)]]
    want, at = [], None
    for line in lines:
        if re.match(r"\s+\S", line):
            if at is not None:
                at.append(line.strip())
            continue
        at = None
        if found := re.match(r"failed\s+(\S+)\s+\(", line):
            at = []
            want.append((found[1], at))
    failures = records.run_output(spark.createDataFrame([("r", "\r\n".join(lines)), ("e", ""), ("n", None)], "id string, text string"))[0]
    assert "Exchange" not in failures._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in failures.collect()] == [("r", m, "\n".join(said[:8])) for m, said in want]


def test_registrations_of_a_long_text(spark):
    """Each pair once, also with blanks, commas and dots in names; ten times the pairs don't take a hundred times as long."""
    def took(n):
        text = "".join(f"s.AddScoped<I{i}, M>();s.AddScoped<I{i}, M>();" for i in range(n)) + "AddSingleton<A.B<x, y>, C<z>>(); AddTransient<Q>(new R<a,b>()); AddScoped<S, S>()"
        df, begin = spark.createDataFrame([(text,)], "text string").select(F.explode(names.registrations(F.col("text"))).alias("p")), time.perf_counter()
        found = [tuple(r["p"]) for r in df.collect()]
        assert found == [(f"I{i}", "M") for i in range(n)] + [("A.B<x, y>", "C<z>"), ("Q", "R<a,b>")]
        return time.perf_counter() - begin

    took(100)
    assert took(40_000) < 30 * max(took(4000), 0.2)
