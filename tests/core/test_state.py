"""Kept tables: commits of batches that fail and are tried again, and the inverted index."""

import re

import pytest
from pyspark.sql import functions as F

from ripplescope.operators import learning, selection
from ripplescope.operators.index import FileIndex
from ripplescope.operators.order import numbered
from ripplescope.sources import shared
from ripplescope.sources.shared import Pointer, Snapshots
from ripplescope.streaming import batching
from ripplescope.streaming.queue import RefreshQueue


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SHOT = "file string, fp string, seq long"


def started(spark, tmp_path, store, run):
    source = spark.readStream.schema(SHOT).parquet(str(tmp_path / "in"))
    query = batching.commit_snapshots(store, source, run).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def shot(spark, tmp_path, files):
    spark.createDataFrame([(f, p, i) for i, (f, p) in enumerate(files)], SHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_a_batch_that_fails_before_its_commit(spark, tmp_path, monkeypatch):
    """The table is written, the pointer isn't moved: the batch comes again, and its run isn't repeated."""
    store, seen = Snapshots(spark, str(tmp_path / "state"), spark.createDataFrame([], "file string, fp string").schema), []
    run = lambda changes: seen.append(rows(changes))
    shot(spark, tmp_path, [("a", "1"), ("b", "1")])
    started(spark, tmp_path, store, run)
    assert seen == [[]] and rows(store.load()) == [("a", "1"), ("b", "1")]
    shot(spark, tmp_path, [("a", "2"), ("c", "1")])
    whole = Pointer.write

    def broken(self, said):
        if "table" in said:
            raise RuntimeError("lost before the commit")
        whole(self, said)

    monkeypatch.setattr(Pointer, "write", broken)
    with pytest.raises(Exception, match="lost before the commit"):
        started(spark, tmp_path, store, run)
    monkeypatch.setattr(Pointer, "write", whole)
    assert rows(store.load()) == [("a", "1"), ("b", "1")] and store.committed("snapshots") == 0
    started(spark, tmp_path, store, run)
    assert seen[1:] == [[("a", "edited"), ("b", "deleted"), ("c", "added")]]
    assert rows(store.load()) == [("a", "2"), ("c", "1")] and store.committed("snapshots") == 1
    tables = [p for p in (tmp_path / "state").iterdir() if p.name.startswith("table-")]
    store.vacuum()
    assert len(tables) == 3 and len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("table-")]) == 2
    assert rows(store.load()) == [("a", "2"), ("c", "1")] and not list((tmp_path / "state/steps").glob("*.json"))


def test_a_run_that_fails(spark, tmp_path):
    """Nothing moves on; the next try sees the same changes."""
    store, seen, fails = Snapshots(spark, str(tmp_path / "state"), spark.createDataFrame([], "file string, fp string").schema), [], [False, True, False]

    def run(changes):
        seen.append(rows(changes))
        if fails.pop(0):
            raise RuntimeError("cancelled")

    shot(spark, tmp_path, [("a", "1")])
    started(spark, tmp_path, store, run)
    shot(spark, tmp_path, [("a", "2")])
    with pytest.raises(Exception, match="cancelled"):
        started(spark, tmp_path, store, run)
    assert rows(store.load()) == [("a", "1")]
    started(spark, tmp_path, store, run)
    assert seen == [[], [("a", "edited")], [("a", "edited")]] and rows(store.load()) == [("a", "2")]


def test_a_batch_that_comes_twice(spark, tmp_path):
    """A crash between the table's commit and the stream's own: the batch is left alone."""
    store = shared.state(spark, str(tmp_path), "diagnostics")
    shape = "project string, seq long, kind string, items array<string>"
    first = spark.createDataFrame([("P", 1, "set", ["a", "b"]), ("Q", 2, "set", ["c"]), ("P", 3, "set", ["d"])], shape)
    second = spark.createDataFrame([("P", 4, "clear", None), ("R", 5, "set", ["e", "f"])], shape)
    each = {}

    class Stream:  # takes the function that a stream's batches go to
        writeStream = type("W", (), {"foreachBatch": staticmethod(lambda f: each.update(run=f))})

    batching.commit_diagnostics(store, Stream)
    each["run"](first, 0)
    assert rows(store.load()) == [("P", "d"), ("Q", "c")]
    each["run"](second, 1)
    each["run"](second, 1)
    each["run"](first, 0)
    assert rows(store.load()) == [("Q", "c"), ("R", "e"), ("R", "f")]
    assert store.committed("diagnostics") == 1 and store.committed("other") == -1


def test_pointer_is_replaced_as_a_whole(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path))
    assert pointer.read() == {}
    pointer.write({"a": 1})
    pointer.write({"b": [1, 2]})
    assert pointer.read() == {"b": [1, 2]}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["current.json"]


def test_folding_in_parts(spark, tmp_path):
    """Onto what is stored, in three parts, as at once; a part that comes again changes nothing."""
    import random

    rng, made, last = random.Random(11), [], {}
    for seq in range(150):
        cls = f"C{rng.randrange(4)}"
        measured = sorted({f"f{rng.randrange(6)}" for _ in range(3)})
        made.append((seq, cls, measured, last.get(cls, ["f0"]), [f"A{rng.randrange(3)}", "F1"]))
        last[cls] = measured
    frame = spark.createDataFrame(made, "seq long, class_fqn string, measured array<string>, baseline array<string>, abstract_files array<string>")
    seeds = spark.createDataFrame([("a0", "f2"), ("a0", "F2"), ("a9", "f9"), ("a1", "f3")], "from_key string, to string")
    whole = rows(learning.evidence(frame, seeds))
    store = shared.state(spark, str(tmp_path), "bindings")
    for number, (lo, hi) in enumerate([(0, 40), (40, 41), (41, 150)]):
        part = frame.where((F.col("seq") >= lo) & (F.col("seq") < hi))
        assert learning.fold_into(store, part, number, seeds if number == 0 else None)
        assert not learning.fold_into(store, part, number)
    assert rows(store.load()) == whole and ("a9", "f9", "parsed", 1, 0, None, []) in whole
    again = learning.evidence(frame.limit(0), spark.createDataFrame([("a9", "F9")], "from_key string, to string"), store.load())
    assert rows(again) == whole  # an edge that is known isn't seeded again, whatever its case


def test_index_after_edits_and_deletes(spark, tmp_path):
    shape = "class_fqn string, files array<string>"
    state = {f"C{i}": [f"src/f{j}.cs" for j in range(i % 7)] + ["Src\\Shared.cs"] for i in range(60)}
    kept = FileIndex(spark, str(tmp_path), parts=16, most=4)
    kept.build(spark.createDataFrame(list(state.items()), shape))
    for step in range(6):
        edits = {f"C{i}": [f"src/f{i}.cs", f"src/new{step}.cs"] for i in range(step, 60, 13)} | {f"N{step}": ["src/f1.cs"]}
        removed = [f"C{i}" for i in range(step + 3, 60, 17) if f"C{i}" not in edits]
        state = {k: v for k, v in state.items() if k not in removed} | edits
        kept.update(spark.createDataFrame(list(edits.items()), shape), spark.createDataFrame([(c,) for c in removed], "class_fqn string"))
        want = sorted({(f.replace("\\", "/").lower(), c) for c, files in state.items() for f in files})
        assert rows(kept.rows()) == want
        keys = ["src/f1.cs", f"src/new{step}.cs", "src/none.cs"]
        assert rows(kept.rows(spark.createDataFrame([(k,) for k in keys], "file_key string"))) == [w for w in want if w[0] in keys]
    assert len(kept.pointer.read()["layers"]) <= 4


def test_index_reads_few_parts(spark, tmp_path):
    kept = FileIndex(spark, str(tmp_path), parts=64)
    kept.build(spark.createDataFrame([(f"C{i}", [f"f{i}", f"f{i + 1}"]) for i in range(400)], "class_fqn string, files array<string>"))
    found = kept.rows(spark.createDataFrame([("f7",), ("f8",)], "file_key string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    wanted = re.search(r"PartitionFilters: \[.*?part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert wanted and len((wanted[1] or wanted[2]).split(",")) <= 2, plan
    assert rows(found) == [("f7", "C6"), ("f7", "C7"), ("f8", "C7"), ("f8", "C8")]


def test_selection_from_the_index(spark, tmp_path):
    from .test_selection import class_map, projects, refs

    kept = FileIndex(spark, str(tmp_path), parts=8)
    kept.build(class_map(spark).select("class_fqn", "files"))
    none = spark.createDataFrame([], "from_key string, to string, source string, confirms long")
    changed = spark.createDataFrame([("SRC\\Shared.cs",), ("src/new.cs",)], "file string")
    plain, quick = (selection.affected(changed, class_map(spark), none, projects(spark), refs(spark), kept=k) for k in (None, kept))
    assert rows(plain.lines()) == rows(quick.lines()) == [("project:tests/T.csproj",)]
    changed = spark.createDataFrame([("SRC\\Shared.cs",)], "file string")
    assert rows(selection.affected(changed, class_map(spark), none, projects(spark), refs(spark), kept=kept).classes) == [("Ns.ATests",), ("Ns.BTests",)]


def test_a_queue_that_is_aborted_and_lost(spark, tmp_path):
    queue, ran = RefreshQueue(spark, str(tmp_path)), []
    entries = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "class_fqn string, seq long")
    scored = spark.createDataFrame([("T1", 1), ("T2", 9), ("B", 5)], "class_fqn string, score long")
    order = lambda: [r["class_fqn"] for r in queue.queued().orderBy("seq").collect()]
    queue.add(entries("ABCDE"))
    queue.add(entries("CF"))
    assert order() == list("ABCDEF")

    def measure(*say):
        left = list(say)

        def run(classes):
            ran.append([r["class_fqn"] for r in classes.orderBy("seq").collect()])
            said = left.pop(0)
            if said == "lost":
                raise RuntimeError("lost")
            return said

        return run

    assert queue.drain(measure(True, False), each=2) == 1
    assert ran == [["A", "B"], ["C", "D"]] and order() == list("EFCD")
    with pytest.raises(RuntimeError, match="lost"):
        queue.drain(measure("lost"), each=3)
    assert queue.queued().where("flying").count() == 3
    again = RefreshQueue(spark, str(tmp_path))  # after the crash
    ran.clear()
    assert again.drain(measure(True, True, True), lambda tried: scored, each=2, stop=lambda: len(ran) == 3) == 3
    assert ran == [["D", "E"], ["F", "C"], ["T2", "B"]] and order() == ["T1"]
    ran.clear()
    assert again.drain(measure(True), lambda tried: scored, each=2) == 1  # what was tried isn't taken again
    assert ran == [["T1"]] and again.store.load().count() == 0
    assert again.drain(measure(True, True), lambda tried: scored, each=9) == 1  # a new drain tries anew


def test_numbers_in_order(spark):
    rows_ = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k long, v long").repartition(7)
    assert [(r["place"], r["k"]) for r in numbered(rows_, "k").orderBy("place").collect()] == [(i, i) for i in range(1000)]
    assert numbered(rows_.limit(0), "k").count() == 0


def test_names_are_filtered_before_they_are_rows(spark):
    from ripplescope.operators import graph

    words = [f"word{i}" for i in range(3000)]
    texts = spark.createDataFrame([(i, f"f{i}", " ".join(words[i * 10 : i * 10 + 200]) + " Naïve_9 a") for i in range(280)] + [(900, "g", None), (901, "g", "")], "node long, file string, text string")
    candidates = spark.createDataFrame([(1000 + i, w, ["f0"]) for i, w in enumerate([*words[::100], "Naïve_9", "gone"])], "node long, short string, files array<string>")
    edges = spark.createDataFrame([(3, 1000)], "src long, dst long")
    every = texts.select("node", "file", F.explode(graph.names.words(F.col("text"))).alias("word"))
    few = graph.mentions(texts, candidates)
    assert few.count() < every.count() / 20
    assert rows(graph.mention_edges(few, candidates, edges)) == rows(graph.mention_edges(every, candidates, edges)) != []
    assert rows(graph.mentions(texts, candidates.limit(0))) == []
