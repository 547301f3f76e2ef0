"""Selection, graphs and snapshots on small fixtures."""

from pyspark.sql import functions as F

from ripplescope.operators import graph, selection


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def class_map(spark):
    return spark.createDataFrame(
        [("Ns.ATests", "tests/T.csproj", ["src/a.cs", "src/shared.cs"], "static", ["src/i.cs"]), ("Ns.BTests", "tests/T.csproj", ["src/b.cs", "src/shared.cs"], "coverage", ["src/i.cs"])],
        "class_fqn string, project string, files array<string>, source string, abstract_files array<string>",
    )


def projects(spark):
    return spark.createDataFrame([("tests/T.csproj", "tests", "T", True), ("src/Lib.csproj", "src", "Lib", False), ("other/U.csproj", "other", "U", True)], "project string, dir string, name string, is_test boolean")


def refs(spark):
    return spark.createDataFrame([("tests/T.csproj", "src/Lib.csproj")], "src string, dst string")


def run(spark, files, bindings=(), root=None):
    changed = spark.createDataFrame([(f,) for f in files], "file string")
    edges = spark.createDataFrame(list(bindings), "from_key string, to string, source string, confirms long")
    out = selection.affected(changed, class_map(spark), edges, projects(spark), refs(spark), root)
    return [r[0] for r in rows(out.classes)], [r[0] for r in rows(out.fallback_projects)]


def test_mapped_files(spark):
    assert run(spark, ["src/a.cs"]) == (["Ns.ATests"], [])
    assert run(spark, ["SRC\\Shared.cs"]) == (["Ns.ATests", "Ns.BTests"], [])


def test_fallback(spark):
    assert run(spark, ["src/new.cs"]) == ([], ["tests/T.csproj"])
    assert run(spark, ["src/bin/new.cs", "src/obj/x.cs", "/abs/obj/x.cs"]) == ([], [])
    assert run(spark, ["src/app.json"]) == ([], ["tests/T.csproj"])
    assert run(spark, ["stray.json"]) == ([], [])
    assert run(spark, ["stray.cs"]) == ([], ["other/U.csproj", "tests/T.csproj"])
    assert run(spark, ["src/a.cs", "src/new.cs"]) == ([], ["tests/T.csproj"])


def test_absolute_paths(spark):
    assert run(spark, ["/repo/src/a.cs"], root="/repo") == (["Ns.ATests"], [])
    assert run(spark, ["/Repo/x/../src/./a.cs", "/repo/obj/x.cs"], root="/repo/") == (["Ns.ATests"], [])
    assert run(spark, ["/repo/src/new.cs"], root="/repo") == ([], ["tests/T.csproj"])
    everything = ([], ["other/U.csproj", "tests/T.csproj"])  # outside of the repository, or of an unknown one, nothing owns it
    assert run(spark, ["/elsewhere/x.cs"], root="/repo") == everything
    assert run(spark, ["/repo/src/a.cs"]) == everything
    files = spark.createDataFrame([("/a/b/c.cs",), ("/a/b2/c.cs",), ("/a/x.cs",), ("C:\\r\\x.cs",), ("q/../r.cs",)], "file string")
    assert sorted(r["file"] for r in selection.usable(files, "/a/b").collect()) == ["../b2/c.cs", "../x.cs", "C:/r/x.cs", "c.cs", "q/../r.cs"]


def test_learnt_edges_only_add(spark):
    assert run(spark, ["src/impl.cs"], [("src/i.cs", "src/impl.cs", "mined", 1)]) == ([], ["tests/T.csproj"])
    assert run(spark, ["src/impl.cs"], [("src/i.cs", "src/impl.cs", "mined", 2)]) == (["Ns.ATests"], [])
    assert run(spark, ["src/impl.cs"], [("src/i.cs", "src/impl.cs", "parsed", 0)]) == (["Ns.ATests"], [])


def test_nearest_folder_wins(spark):
    files = spark.createDataFrame([("a/b/c.cs",), ("a/x.cs",), ("z.cs",)], "file string")
    own = spark.createDataFrame([("P1", "a"), ("P2", "a/b"), ("P3", "q")], "project string, dir string")
    assert rows(selection.owners(files, own)) == [("a/b/c.cs", "P2"), ("a/x.cs", "P1"), ("z.cs", None)]


def test_closure_of_cycles_and_hubs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert [r[1] for r in rows(graph.closure(edges, roots))] == [1, 2, 3, 4, 5]
    capped = spark.createDataFrame([(4,)], "node long")
    assert [r[1] for r in rows(graph.closure(edges, roots, capped))] == [1, 2, 3, 4]


def test_deep_closure(spark, monkeypatch):
    """The same pairs in rounds by the logarithm of the depth, cycles, hubs and unknown roots included."""
    rounds, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: rounds.append(name) or store(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(130)] + [(130, 120), (7, 7), (40, 3)], "src long, dst long")
    roots, capped = spark.createDataFrame([(0,), (41,), (999,)], "root long"), spark.createDataFrame([(60,)], "node long")
    told = graph.closure(chain, roots, deep=True)
    assert rounds.count("doubled") <= 2 * 9
    assert rows(told) == rows(spark.createDataFrame([(0, i) for i in range(131)] + [(41, i) for i in range(41, 131)] + [(999, 999)], "root long, node long"))
    few = spark.createDataFrame([(i, i + 1) for i in range(54, 66)], "src long, dst long")
    assert rows(graph.closure(few, spark.createDataFrame([(54,), (60,)], "root long"), capped, deep=True)) == rows(graph.closure(few, spark.createDataFrame([(54,), (60,)], "root long"), capped))


def test_hub_cap_needs_a_world(spark):
    edges = spark.createDataFrame([(i, 100) for i in range(24)] + [(0, 101)], "src long, dst long")
    nodes = spark.createDataFrame([(i, False) for i in range(24)] + [(100, False), (101, True)], "node long, is_test boolean")
    assert rows(graph.hubs(edges, nodes)) == [(100, 24)]
    assert rows(graph.hubs(edges, nodes.limit(19))) == []


def test_levels_leave_cycles_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6)], "node long")
    assert rows(graph.levels(edges, nodes)) == [(1, 2), (2, 1), (3, 0)]


def test_levels_bring_nothing_to_the_driver(spark, monkeypatch):
    """However small a round is, none of its joins is a broadcast, which goes through the driver; levels are those of the longest ways down."""
    plans, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, name))
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 2), (4, 3), (3, 99), (5, 6), (6, 5), (7, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8)], "node long")
    assert rows(graph.levels(edges, nodes)) == [(1, 2), (2, 1), (3, 0), (4, 1), (8, 0)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_degrees_are_those_of_the_edges(spark):
    """Also where nodes come twice, have no name, or refer to nothing or to what nobody has; and without a pair for each two nodes, which would be 900 million here."""
    made = [(1, "a", ["a", "none"]), (1, "b", ["b"]), (2, "a", ["b", "a", "a"]), (3, None, ["a", None]), (4, "c", ["none"]), (5, "b", None), (6, "b", ["a", "b"])]
    nodes = spark.createDataFrame(made, "node long, fqn string, ref_names array<string>")
    want = graph.resolved_edges(nodes).groupBy("src").agg(F.count("*").alias("refs"), F.max("dst").alias("highest"))
    assert rows(graph.resolved_degrees(nodes)) == rows(want) == [(1, 4, 6), (2, 4, 6), (3, 2, 2), (6, 4, 6)]
    many = spark.range(30_000).select(F.col("id").alias("node"), F.lit("a").alias("fqn"), F.array(F.lit("a")).alias("ref_names"))
    assert rows(graph.resolved_degrees(many).groupBy("refs", "highest").count()) == [(30_000, 29_999, 30_000)]


def test_mentions(spark):
    mentions = spark.createDataFrame([("n1", "f1", "Color"), ("n2", "f2", "Color"), ("n3", "f3", "ab")], "node string, file string, word string")
    candidates = spark.createDataFrame([("e", "Color", ["f2"]), ("n1", "Color", ["f9"]), ("s", "ab", ["f0"])], "node string, short string, files array<string>")
    none = spark.createDataFrame([], "src string, dst string")
    assert rows(graph.mention_edges(mentions, candidates, none)) == [("n1", "e"), ("n2", "n1")]


def test_static_never_replaces_coverage(spark):
    new = class_map(spark).withColumn("project", F.lit("new")).withColumn("source", F.lit("static"))
    out = {r["class_fqn"]: (r["project"], r["source"]) for r in selection.merged_map(class_map(spark), new).collect()}
    assert out == {"Ns.ATests": ("new", "static"), "Ns.BTests": ("tests/T.csproj", "coverage")}
    forced = {r["class_fqn"]: r["source"] for r in selection.merged_map(class_map(spark), new, force=True).collect()}
    assert forced["Ns.BTests"] == "static"


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("n", None)], "file string, fp string")
    b = spark.createDataFrame([("y", "2"), ("z", "1"), ("n", None)], "file string, fp string")
    assert rows(selection.snapshot_diff(a, b)) == [("x", "deleted"), ("y", "edited"), ("z", "added")]
    assert rows(selection.snapshot_diff(a, b, cold=True)) == []


def test_document(spark):
    changed = spark.createDataFrame([("src/a.cs",)], "file string")
    none = spark.createDataFrame([], "from_key string, to string, source string, confirms long")
    out = selection.affected(changed, class_map(spark), none, projects(spark), refs(spark))
    assert out.document().head()["json"] == '{"mapReady":true,"classes":["Ns.ATests"],"projects":[],"changedFiles":["src/a.cs"]}'
    assert [r["line"] for r in out.lines().collect()] == ["Ns.ATests"]
