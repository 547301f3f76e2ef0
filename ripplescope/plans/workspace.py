"""Queries over what a workspace keeps and reads: streams, state tables, file trees, reports and source texts, made of the driver's tables."""

from __future__ import annotations

import contextlib
import gzip
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import learning, results, selection
from ..operators.index import FileIndex
from ..sources import projects, records, reports
from ..sources.shared import Snapshots, shared_dir, state, stored
from ..streaming import batching, live
from ..streaming.queue import RefreshQueue
from .catalogue import ORACLE, US, Tables, _class_files, _events, _measurements, query

HOURS = 3_600_000_000
#: Rows that a task sorts to write files.
TASK_ROWS = 1 << 18
#: How hard files are compressed.
GZIP = 6


def _folder(t: Tables, name: str) -> str:
    """A new folder that all share, until the application ends."""
    base = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    where = t.spark._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return base


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _written(t: Tables, name: str, pieces: DataFrame) -> str:
    """Writes ``pieces(file, text)`` below a new shared folder, in tasks; rows of a file that follow each other are its pieces, so that no file is held whole. Names that end with ``.gz`` are compressed. What was shuffled for it is deleted when it is done."""
    base = _folder(t, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.tree import Tree

        tree, now, out = Tree({"path": base}), None, None
        with contextlib.ExitStack() as opened:
            for batch in batches:
                texts, runs, begin = batch.column(1).cast(pa.large_binary()), pc.run_end_encode(batch.column(0)), 0
                ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :], texts.buffers()[2] or pa.py_buffer(b"")
                for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if file != now:
                        opened.close()
                        at = f"{tree.root}/{file}"
                        tree.fs.create_dir(at.rpartition("/")[0], recursive=True)
                        now, out = file, opened.enter_context(tree.fs.open_output_stream(at, compression=None))
                        if file.endswith(".gz"):
                            out = opened.enter_context(gzip.GzipFile(fileobj=out, mode="wb", compresslevel=GZIP))
                    out.write(data.slice(ends[begin], ends[end] - ends[begin]))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    conf, cleanup = t.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    former = conf.get(cleanup)
    conf.set(cleanup, "true")
    try:
        pieces.select("file", "text").dropna().mapInArrow(write, "n long").agg(F.sum("n")).collect()
    finally:
        conf.set(cleanup, former)
    return base


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, in as many tasks as give each about as many rows whatever the table's size."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS + 1), key)


def _live_events(t: Tables) -> DataFrame:
    """Views and purchases are saves, clicks changes, errors pauses that abort a run or none, signups resumes."""
    kind = F.when(F.col("event_type") == "click", "change").when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").otherwise("save")
    aborted = F.when((kind == "pause") & (F.col("value") < 5), F.array().cast("array<string>")).when((kind == "pause") & (F.col("value") < 40), F.array(_text("r", F.col("event_id") % 3)))
    file = F.when(kind.isin("save", "change"), _text("f", F.col("event_id") % 10))
    return t.events.select(F.col("user_id").cast("string").alias("key"), F.expr(US).alias("us"), F.col("event_id").alias("seq"), kind.alias("kind"), file.alias("file"), aborted.alias("aborted"))


_LIVE = """with e as (select user_id::varchar as key, epoch_us(ts) as us, event_id as n, case event_type when 'click' then 'change' when 'error' then 'pause' when 'signup' then 'resume' else 'save' end as kind, 'f' || event_id % 10 as file,
      case when event_type = 'error' and value < 5 then []::varchar[] when event_type = 'error' and value < 40 then ['r' || event_id % 3] end as aborted from events),
    steps as (select key, us, n, {'us': us, 'kind': kind, 'file': file, 'aborted': aborted, 'live': true, 'due': null::bigint, 'pend': []::varchar[], 'every': false, 'runs': []::struct(us bigint, files varchar[], every boolean)[]} as s from e
      union all select key, max(us) + 1000000000000, max(n) + 1, {'us': (max(us) + 1000000000000)::bigint, 'kind': 'end', 'file': '', 'aborted': null::varchar[], 'live': true, 'due': null::bigint, 'pend': []::varchar[], 'every': false, 'runs': []::struct(us bigint, files varchar[], every boolean)[]} from e group by key),
    l as (select key, list(s order by us, n) as s from steps group by key),
    done as (select key, list_reduce(list_concat([{'us': 0::bigint, 'kind': '', 'file': '', 'aborted': null::varchar[], 'live': true, 'due': null::bigint, 'pend': []::varchar[], 'every': false, 'runs': []::struct(us bigint, files varchar[], every boolean)[]}], s), lambda a, e: {
      'us': e.us, 'kind': e.kind, 'file': e.file, 'aborted': e.aborted,
      'live': case when e.kind = 'pause' then false when e.kind = 'resume' then true else a.live end,
      'due': case when e.kind = 'save' and a.live then e.us + 14400000000 when e.kind = 'change' or (e.kind = 'pause' and a.live) or (a.due is not null and e.us >= a.due) then null else a.due end,
      'pend': case when (e.kind = 'change' and a.live) or (e.kind = 'resume' and not a.live) then []::varchar[]
        else list_distinct(list_concat(case when a.due is not null and e.us >= a.due then []::varchar[] else a.pend end, case when e.kind in ('save', 'change') then [e.file] when e.kind = 'pause' and a.live then coalesce(e.aborted, []::varchar[]) else []::varchar[] end)) end,
      'every': case when e.kind = 'pause' and a.live then coalesce(len(e.aborted) = 0, false) when e.kind = 'resume' then false else a.every end,
      'runs': list_concat(a.runs, case when a.due is not null and e.us >= a.due then [{'us': a.due, 'files': a.pend, 'every': false}] else []::struct(us bigint, files varchar[], every boolean)[] end,
        case when e.kind = 'change' and a.live then [{'us': e.us, 'files': list_distinct(list_concat(case when a.due is not null and e.us >= a.due then []::varchar[] else a.pend end, [e.file])), 'every': false}]
          when e.kind = 'resume' and not a.live and (a.every or len(a.pend) > 0) then [{'us': e.us, 'files': case when a.every then []::varchar[] else a.pend end, 'every': a.every}] else []::struct(us bigint, files varchar[], every boolean)[] end)}) as z from l),
    r as (select key, unnest(z.runs) as x from done) select key, x.us as us, array_to_string(list_sort(x.files), ',') as files, x.every as everything from r"""


@query(_LIVE)
def live_runs(t: Tables) -> DataFrame:
    """The runs of saves, changes, pauses and resumes; a save that waits when a pause comes runs with the resume."""
    return live.live_runs(_live_events(t), 4 * HOURS).withColumn("files", F.array_join("files", ","))


@query(_LIVE)
def live_runs_streamed(t: Tables) -> DataFrame:
    """The same, from a stream with state and timers that is stopped and started again."""
    runs = live.replayed(_live_events(t), lambda s: live.stream_live_runs(s, 4 * HOURS), live.RUN, rest_us=4 * HOURS)
    return runs.withColumn("files", F.array_join("files", ","))


@query(ORACLE["change_verdicts"])
def change_verdicts_streamed(t: Tables) -> DataFrame:
    """Verdicts from a stream whose state forgets saves of long ago."""
    rows = _events(t).withColumns({"key": F.col("key").cast("string"), "file": F.col("file").cast("string"), "kind": F.when(F.col("event_type") == "view", "save").otherwise("change"), "watched": F.coalesce(F.col("value") > 5, F.lit(False)), "dirty": F.coalesce(F.col("value") > 60, F.lit(False))})
    rows = rows.select("key", "file", "us", "seq", "kind", "watched", "dirty")
    return live.replayed(rows, lambda s: live.stream_change_verdicts(s, 24 * HOURS), live.VERDICT, rest_us=24 * HOURS).select("seq", "verdict")


@query(ORACLE["evidence_fold"])
def evidence_in_parts(t: Tables) -> DataFrame:
    """Measurements folded onto the stored bindings in three batches, one of which comes twice."""
    rows = stored(learning.with_baseline(_measurements(t)), "measurements")
    most = rows.agg(F.max("seq")).head()[0] or 0
    store = state(t.spark, _folder(t, "bindings"), "bindings")
    for number, (lo, hi) in enumerate([(-1, most // 3), (most // 3, most // 2), (most // 2, most)]):
        for _ in range(2 if number == 1 else 1):
            learning.fold_into(store, rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)), number)
    return store.load().withColumn("evidence", F.array_join("evidence", ","))


@query("""with cf as (select distinct o_custkey as c, 'src/p' || l_partkey as file from orders join lineitem on o_orderkey = l_orderkey where o_custkey % 3 <> 1 or l_quantity > 25) select file as file_key, 'C.' || c as class_fqn from cf where c % 11 <> 0 and file in (select 'src/p' || p_partkey from part where p_brand = 'Brand#4')""")
def indexed_classes(t: Tables) -> DataFrame:
    """Classes of changed files from the kept index, after an edit of some classes, new ones, and deletions."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), "l_quantity", _text("src/p", F.col("l_partkey")).alias("file"))
    maps = lambda df: df.groupBy(_text("C.", F.col("c")).alias("class_fqn")).agg(F.collect_set("file").alias("files"))
    kept = FileIndex(t.spark, _folder(t, "index"), parts=16)
    kept.build(maps(rows.where("c % 3 > 0")))
    kept.update(maps(rows.where("c % 3 = 0 or (c % 3 = 1 and l_quantity > 25)")), t.customer.where("c_custkey % 3 = 1").select(_text("C.", F.col("c_custkey")).alias("class_fqn")))
    kept.update(maps(rows.limit(0)), t.customer.where("c_custkey % 11 = 0").select(_text("C.", F.col("c_custkey")).alias("class_fqn")))
    changed = t.part.where("p_brand = 'Brand#4'").select(_text("SRC\\P", F.col("p_partkey")).alias("file"))
    return kept.rows(selection.usable(changed))


_TREE = """with f as (select page_id, 'P' || page_id % 5 as project, ['src', '_gen', '.hid', 'Obj', 'nested', 'sub/deep', 'a b/c', 'Packages'][page_id % 8 + 1] || '/p' || page_id || '.' || ['cs', 'JSON', 'CS', 'dll', 'csproj'][page_id % 7 % 5 + 1] as file, page_id % 3 as size from pages)"""


def _tree(t: Tables) -> str:
    """A file for each page, in folders that count or don't; two folders are repositories of their own."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    k = F.col("page_id")
    project = _text("P", k % 5, "/")
    files = t.pages.select(F.concat(project, pick(["src", "_gen", ".hid", "Obj", "nested", "sub/deep", "a b/c", "Packages"], k % 8), F.lit("/p"), k, F.lit("."), pick(["cs", "JSON", "CS", "dll", "csproj"], k % 7 % 5)).alias("file"), F.repeat(F.lit("x"), (k % 3).cast("int")).alias("text"))
    gits = t.pages.select((k % 5).alias("p")).distinct().select(F.explode(F.array(_text("P", F.col("p"), "/nested/.git/HEAD"), _text("P", F.col("p"), "/sub/.git"))).alias("file"), F.lit("ref: x").alias("text"))
    return _written(t, "tree", files.union(gits))


@query(_TREE + """ select project, count(*) as n, substr(sha1(string_agg(file, chr(10) order by file)), 1, 12) as digest, sum(size)::bigint as bytes from f where page_id % 8 in (0, 1, 2, 6) and file not like '%.dll' group by project""")
def tree_stamps(t: Tables) -> DataFrame:
    """What makes a build stale in each project of a tree; hidden and empty files count, skipped folders and other repositories don't."""
    found = projects.content_files(t.spark, _tree(t)).select(F.substring_index("file", "/", 1).alias("project"), F.expr("substr(file, instr(file, '/') + 1)").alias("file"), "modified_ms", "size")
    return projects.folder_stamps(found).select("project", "n", "digest").join(found.groupBy("project").agg(F.sum("size").alias("bytes")), "project")


@query(_TREE + """ select 'P' || page_id % 5 || '/' || file as file, 'cs' as kind, repeat('x', size::int) as text from f where page_id % 8 not in (3, 7) and lower(file) like '%.cs' union all
    select 'P' || page_id % 5 || '/' || file, 'csproj', repeat('x', size::int) from f where page_id % 8 in (0, 1, 2, 6) and file like '%.csproj'""")
def tree_texts(t: Tables) -> DataFrame:
    """Source files, those of repositories within too, and project files without these."""
    root = _tree(t)
    kind = lambda df, name: df.select("file", F.lit(name).alias("kind"), "text")
    return kind(projects.source_texts(t.spark, root), "cs").union(kind(projects.project_texts(t.spark, root), "csproj"))


@query("""with m as (select l_suppkey, 'src/p' || l_partkey || '.cs' as file, l_linenumber - 1 as line, max(case when l_returnflag = 'N' then 0 else l_quantity::bigint end) as h from lineitem where l_linenumber > 1 group by all) select file, line, sum(h)::bigint as hits, max(h) > 0 as hit from m group by file, line""")
def report_hits(t: Tables) -> DataFrame:
    """Coverage files, one for each supplier, whatever the case of their names; the most in a report, added over reports."""
    hits = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(_text(' hits="', F.col("l_quantity").cast("long"), '"'))
    line = F.concat(F.lit('<line number="'), F.col("l_linenumber") - 1, F.lit('"'), hits, F.lit("/>"))
    report = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    before, after = (f("l_partkey").over(report) for f in (F.lag, F.lead))
    head = F.when(before.isNull(), "<coverage><packages><package><classes>").otherwise("")
    begin = F.when(before.isNull() | (before != F.col("l_partkey")), _text('<class filename="src\\p', F.col("l_partkey"), '.cs"><lines>')).otherwise("")
    end = F.when(after.isNull() | (after != F.col("l_partkey")), "</lines></class>\n").otherwise("")
    foot = F.when(after.isNull(), "</classes></package></packages></coverage>").otherwise("")
    rows = _dealt(t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag").where(line.isNotNull()).dropna(subset=["l_suppkey", "l_partkey"]), "l_suppkey")
    files = rows.select(_text("deep/s", F.col("l_suppkey"), ".Cobertura.XML").alias("file"), F.concat(head, begin, line, end, foot).alias("text"))
    found = reports.line_hits(t.spark, _written(t, "coverage", files))
    return results.merged_hits(found.withColumnRenamed("report", "project")).withColumn("hit", F.col("hits") > 0)


@query("""select case when l_orderkey % 3 = 0 then 'Ns.K' || l_partkey when l_orderkey % 3 = 1 then 'Ns.C' || l_suppkey else '' end as class_fqn,
    case when l_orderkey % 3 = 1 then 'Ns.C' || l_suppkey || '.' else '' end || 'M' || l_linenumber || '(' || case when l_orderkey % 3 = 1 then 'x.y' else l_orderkey || '' end || ' <&>)' as method, l_returnflag = 'A' as passed, l_returnflag = 'N' as skipped,
    case when l_returnflag = 'R' then 'said &lt; ' || l_partkey end as message, case when l_returnflag <> 'N' then (l_quantity::int % 60) * 1000.0 end::double as duration_ms from lineitem""")
def result_outcomes(t: Tables) -> DataFrame:
    """Result files, one for each supplier; classes by definition, without the assembly, else by the name, and entities decoded once."""
    third, key = F.col("l_orderkey") % 3, F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"))
    name = F.concat(F.when(third == 1, _text("Ns.C", F.col("l_suppkey"), ".")).otherwise(F.lit("")), F.lit("M"), "l_linenumber", F.lit("("), F.when(third == 1, F.lit("x.y")).otherwise(F.col("l_orderkey").cast("string")), F.lit(" &lt;&amp;&gt;)"))
    outcome = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "Passed", "N", "NotExecuted", "R", "Failed")]), F.col("l_returnflag"))
    took = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.concat(F.lit(' duration="00:00:'), F.lpad((F.col("l_quantity").cast("int") % 60).cast("string"), 2, "0"), F.lit('.0000000"')))
    said = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<Output><ErrorInfo><Message>said &amp;lt; "), "l_partkey", F.lit("</Message></ErrorInfo></Output>"))).otherwise(F.lit(""))
    result = F.concat(F.lit('<UnitTestResult testId="'), key, F.lit('" testName="'), name, F.lit('" outcome="'), outcome, F.lit('"'), took, F.lit(">"), said, F.lit("</UnitTestResult>"))
    definition = F.when(third == 0, F.concat(F.lit('<UnitTest id="'), key, F.lit('"><TestMethod className="Ns.K'), "l_partkey", F.lit(', My.Tests" name="x"/></UnitTest>')))
    rows = _dealt(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").dropna(subset=["l_suppkey"]), "l_suppkey")
    rows = rows.select("*", F.explode(F.when(third == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("at"))
    report = Window.partitionBy("l_suppkey").orderBy("at")
    before, after = (f("at").over(report) for f in (F.lag, F.lead))
    head = F.when(before.isNull(), "<TestRun><Results>").otherwise("")
    body = F.coalesce(F.concat(F.when(F.col("at") == 1, result).otherwise(definition), F.lit("\n")), F.lit(""))
    middle = F.when((F.col("at") == 1) & (after.isNull() | (after == 2)), "</Results><TestDefinitions>").otherwise("")
    foot = F.when(after.isNull(), "</TestDefinitions></TestRun>").otherwise("")
    files = rows.select(_text("s", F.col("l_suppkey"), ".trx.gz").alias("file"), F.concat(head, body, middle, foot).alias("text"))
    return reports.test_outcomes(t.spark, _written(t, "results", files)).drop("stack_trace")


@query("""with p as (select s_suppkey as k, case when s_suppkey % 4 = 0 then 'Asm' || s_suppkey else 'S' || s_suppkey end as assembly_name, s_suppkey % 3 = 0 or s_suppkey % 5 = 0 as is_test, s_suppkey % 5 = 0 as uses_mtp from supplier)
    select 'n/s' || p.k || '/S' || p.k || '.csproj' as project, 'n/s' || p.k as dir, p.assembly_name, p.is_test, p.uses_mtp, case when q.k is not null then 'n/s' || q.k || '/S' || q.k || '.csproj' end as dst from p left join p q on q.k = p.k // 2 and p.k > 0""")
def project_files(t: Tables) -> DataFrame:
    """Projects and their references, from the texts of project files."""
    k = F.col("s_suppkey")
    parts = [
        F.when(k % 4 == 0, _text("<assemblyname> Asm", k, " </assemblyname>")).otherwise(F.lit("<AssemblyName>$(Other)</AssemblyName>")),
        F.when(k % 3 == 0, F.lit('<PackageReference Include="NUnit3TestAdapter"/>')).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit("<EnableNUnitRunner> True </EnableNUnitRunner>")).otherwise(F.lit("<EnableNUnitRunner>false</EnableNUnitRunner>")),
        F.when(k > 0, _text('<ProjectReference Include="..\\other/..\\S', F.floor(k / 2), "/../s", F.floor(k / 2), "\\S", F.floor(k / 2), '.csproj"/>')).otherwise(F.lit("")),
    ]
    texts = t.supplier.select(_text("n/s", k, "/S", k, ".csproj").alias("file"), F.concat(*parts).alias("text"))
    found, refs = projects.project_graph(texts)
    return found.drop("name").join(refs.withColumnRenamed("src", "project"), "project", "left")


@query("""with r as (select p_brand as file, 'I' || p_partkey as service, 'M' || p_size as impl from part where p_partkey % 5 < 3 union select p_brand, 'J' || p_size, 'Q.N' || p_size || '<int>' from part where p_partkey % 5 = 3) select * from r""")
def registered_pairs(t: Tables) -> DataFrame:
    """F16: services and implementations that source texts register, each once a file."""
    k, size = F.col("p_partkey"), F.col("p_size")
    call = F.when(k % 5 < 2, _text("services.AddScoped<I", k, ", M", size, ">();")).when(k % 5 == 2, _text("x.TryAddSingleton< I", k, " ,\n M", size, " >()")).when(k % 5 == 3, _text("s.AddTransient<J", size, ">(new Q.N", size, "<int>(1));")).otherwise(_text("s.AddScoped<T", k, ", T", k, ">(); AddSingleton<U>(p => new V())"))
    texts = t.part.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.collect_list(call), "\n").alias("text"))
    return texts.select("file", F.inline(names.registrations(F.col("text"))))


@query("""with t as (select 'A.T' || p_partkey % 400 as fqn, 'src/F' || p_partkey % 900 || '.cs' as file from part group by all), s as (select distinct 'A.T' || c_custkey % 400 as service, case when c_custkey % 3 = 0 then 'T' || c_custkey % 390 else 'A.T' || c_nationkey end as impl from customer),
    i as (select service, case when impl like 'A.%' then impl else 'A.' || impl end as impl from s)
    select lower(a.file) as from_key, min(b.file) as "to" from i join t a on a.fqn = service join t b on b.fqn = impl where a.file <> b.file group by lower(a.file), lower(b.file)""")
def seeded_edges(t: Tables) -> DataFrame:
    """Files of a service with files of its implementation, by exact or short names."""
    types = t.part.groupBy(_text("A.T", F.col("p_partkey") % 400).alias("fqn")).agg(F.collect_set(_text("src/F", F.col("p_partkey") % 900, ".cs")).alias("files"))
    c = F.col("c_custkey")
    seeds = t.customer.select(_text("A.T", c % 400).alias("service"), F.when(c % 3 == 0, _text("T", c % 390)).otherwise(_text("A.T", F.col("c_nationkey"))).alias("impl"))
    return learning.seeded_edges(seeds, types)


_BUILT = """with f as (select l_suppkey as project, ['net8.0', 'NET9.0', 'ref'][l_partkey % 3 + 1] as folder, l_linenumber as depth, epoch_ms(l_shipdate) as ms, 'bin/' || repeat('d/', l_linenumber) || ['net8.0', 'NET9.0', 'ref'][l_partkey % 3 + 1] || '/' || l_partkey || '.dll' as file from lineitem)"""


def _built(t: Tables) -> DataFrame:
    folder = F.element_at(F.array(F.lit("net8.0"), F.lit("NET9.0"), F.lit("ref")), (F.col("l_partkey") % 3 + 1).cast("int"))
    file = F.concat(F.lit("bin/"), F.repeat(F.lit("d/"), F.col("l_linenumber")), folder, F.lit("/"), "l_partkey", F.lit(".dll"))
    return t.lineitem.select(F.col("l_suppkey").alias("project"), file.alias("file"), F.col("l_linenumber").alias("depth"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)").alias("modified_ms"))


@query(_BUILT + " select project, lower(folder) as framework, arg_min(file, (-ms, file)) as file from f where folder <> 'ref' group by project, lower(folder)")
def newest_by_framework(t: Tables) -> DataFrame:
    """The newest built file in each framework's folder."""
    return projects.newest_by_framework(_built(t))


@query(_BUILT + " select project, arg_min(file, (-ms, file)) as file from f where folder <> 'ref' and depth <= 6 group by project")
def newest_artifacts_deep(t: Tables) -> DataFrame:
    """The newest within six levels."""
    return projects.newest_artifacts(_built(t), depth=6)


@query("""select page_id::varchar as id, 'Ns' || page_id % 7 || '.C' || page_id as fqn, 2::int as line from pages union all select page_id::varchar, 'Ns' || page_id % 7 || '.D' || page_id % 3, 3 from pages union all select page_id::varchar, 'Other.C' || page_id, 7 from pages where page_id % 2 = 0""")
def declared_classes(t: Tables) -> DataFrame:
    """Classes with the namespace above them; comments declare none, and the first line of a class counts."""
    k = F.col("page_id")
    text = F.concat(_text("// the class under test\nnamespace Ns", k % 7, ";\n[Fact] public sealed class C", k, "\r\n\tabstract partial class D", k % 3, " : class\n class C", k, "\nvar class1 = class2;\n"), F.when(k % 2 == 0, _text("namespace Other { class X {}\n internal class C", k, "\n")).otherwise(F.lit("")))
    return records.declarations(t.pages.select(k.cast("string").alias("id"), text.alias("text")))


@query("""select page_id::varchar as id, 'M' || page_id % 5 as method, 1::int as line from pages union all select page_id::varchar, 'Generic', 2 from pages""")
def declared_methods(t: Tables) -> DataFrame:
    """The first line that declares a method."""
    k = F.col("page_id")
    raw = t.pages.select(k.cast("string").alias("id"), _text("void M", k % 5, "()\n  public async Task M", k % 5, "(int x)\n\tprivate T Generic<T>(T x) => Other;\npublic void M", k % 5, "()").alias("text"))
    wanted = raw.select("id", F.explode(F.array(_text("M", F.col("id").cast("long") % 5), F.lit("Generic"), F.lit("Other"), F.lit("M"))).alias("method"))
    return records.method_lines(raw, wanted)


@query("""select c_custkey::varchar as id, 'pipe-' || c_custkey as pipe, case when c_custkey % 3 > 0 then 'Baseline,' || c_mktsegment end as capabilities from customer""")
def host_registrations(t: Tables) -> DataFrame:
    """The pipe on the first line, the capabilities on the second, if there are any."""
    k = F.col("c_custkey")
    text = F.concat(_text("\tpipe-", k, " \r\n"), F.when(k % 3 > 0, F.concat(F.lit(" Baseline \t"), "c_mktsegment", F.lit("\nmore text"))).otherwise(F.lit(" \n x")))
    return records.host_registrations(t.customer.select(k.cast("string").alias("id"), text.alias("text"))).withColumn("capabilities", F.array_join("capabilities", ","))


@query("""select c_custkey, case when c_custkey % 4 < 3 then case when c_custkey % 4 = 2 then '/Repo/' else '/repo/' end || 'src/f' || c_nationkey || '.cs' end as file, case when c_custkey % 4 < 3 then c_custkey end as line from customer""")
def failure_locations(t: Tables) -> DataFrame:
    """L4: the first frame of a stack below the repository; the shadow's folder counts as its."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    home = F.when(k % 4 == 0, F.lit("/repo/src/f")).when(k % 4 == 1, F.lit("C:\\Shadow\\src\\f")).when(k % 4 == 2, F.lit("/Repo/src/f")).otherwise(F.lit("/repository/src/f"))
    stack = F.concat(F.lit("at A.B() in /sdk/x.cs:line 3\n  at C.D() in "), home, n, F.lit(".cs:line "), k, F.lit("\n at E.F() in /elsewhere/y.cs:line 9"))
    where = results.failure_location(stack, "/repo/", "c:/shadow")
    return t.customer.select("c_custkey", where["file"].alias("file"), where["line"].cast("long").alias("line"))


@query("""select 'sdk' || p_partkey as path, (p_size % 12) || '.' || (p_partkey % 30) || '.' || (p_partkey % 100) as version from part order by p_size % 12 desc, p_partkey % 30 desc, p_partkey % 100 desc, 'sdk' || p_partkey limit 1""")
def newest_version(t: Tables) -> DataFrame:
    """The highest of three-part versions."""
    k = F.col("p_partkey")
    return results.best_by_version(t.part.select(_text("sdk", k).alias("path"), F.concat_ws(".", F.col("p_size") % 12, k % 30, k % 100).alias("version")))


@query("select 'f' || o_custkey as file from orders where o_orderstatus = 'O' union select 'f' || o_custkey from orders where o_orderstatus = 'P'")
def superseded_files(t: Tables) -> DataFrame:
    """A run that takes over has the files of the one that it aborts."""
    files = lambda status: t.orders.where(F.col("o_orderstatus") == status).select(_text("f", F.col("o_custkey")).alias("file"))
    return batching.superseded(files("O"), files("P"))


@query("""with s as (select 'f' || event_id % 5000 as file, max(epoch_us(ts)) as us from events where event_type = 'view' group by 1) select * from s where (select count(*) from s) <= 100 or us >= (select max(epoch_us(ts)) from events) - 864000000000""")
def remembered_saves(t: Tables) -> DataFrame:
    """T5: beyond so many files, saves of more than ten windows ago are forgotten."""
    rows = t.events.select("event_type", _text("f", F.col("event_id") % 5000).alias("file"), F.expr(US).alias("us"))
    now = rows.agg(F.max("us")).head()[0] or 0
    return batching.remembered_saves(rows.where("event_type = 'view'").select("file", "us"), now, 24 * HOURS, most=100)


@query("""select page_id, case when page_id % 3 = 2 then 'D:\\Other\\a' || page_id else '/repo/src/a' || page_id end as remapped, case page_id % 3 when 0 then 'src/a' || page_id when 1 then '../x/a' || page_id else '/a' || page_id end as relative,
    case when page_id % 4 = 0 then 'infinity'::double else page_id::double end as newest, 'FullyQualifiedName~N.C' || page_id || '\\(\\&\\).|FullyQualifiedName~N.C' || page_id || '\\(\\&\\)+' as filter, 'a\\.b\\(' || page_id || '\\)' as regex from pages""")
def scalar_paths(t: Tables) -> DataFrame:
    """Paths mapped back and made relative, stamps, and escapes."""
    k = F.col("page_id")
    shadow = F.when(k % 3 == 0, _text("C:\\SHADOW\\src\\a", k)).when(k % 3 == 1, _text("c:/shadow/src/a", k)).otherwise(_text("D:\\Other\\a", k))
    absolute = F.when(k % 3 == 0, _text("/Work/Repo/x/../src/./a", k)).when(k % 3 == 1, _text("/work/x/a", k)).otherwise(_text("/a", k))
    stamp = F.when(k % 4 == 0, _text("3:x", k, ":d")).otherwise(_text("3:", k, ":d"))
    own = F.when(k % 3 == 2, absolute).otherwise(paths.from_root(absolute, "/work/repo/"))
    return t.pages.select("page_id", paths.remapped(shadow, F.lit("c:/shadow/"), F.lit("/repo")).alias("remapped"), own.alias("relative"), names.stamp_newest_ms(stamp).alias("newest"), names.class_filter(F.array(_text("N.C", k, "(&)"))).alias("filter"), names.escape_regex(_text("a.b(", k, ")")).alias("regex"))


@query("""select 'N.C' || c_custkey || case when c_custkey % 7 = 0 then '<x>' else '' end as class_fqn, 'T' || o_orderkey as node from customer join orders on o_custkey = c_custkey where c_custkey % 7 > 0 and c_nationkey % 2 = 0 and c_mktsegment in ('BUILDING', 'AUTOMOBILE')""")
def picked_nodes(t: Tables) -> DataFrame:
    """Test nodes of the classes that test attributes mark."""
    k = F.col("c_custkey")
    fqn = F.concat(_text("N.C", k), F.when(k % 7 == 0, F.lit("<x>")).otherwise(F.lit("")))
    attributes = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Obsolete"), F.lit("TheoryAttribute"))).when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("FactAttribute"))).otherwise(F.array(F.lit("FactsAttribute")))
    classes = t.customer.where(names.is_test_class(fqn, attributes, F.col("c_nationkey") % 2 == 0)).select(fqn.alias("class_fqn"))
    nodes = t.customer.select(k.alias("o_custkey"), fqn.alias("class_fqn")).join(t.orders, "o_custkey").select("class_fqn", _text("T", F.col("o_orderkey")).alias("node"))
    return results.picked_nodes(nodes, classes)


@query("select c_custkey as class_fqn, c_nationkey + 1 as project, c_mktsegment as source from customer where c_custkey % 2 = 0")
def kept_map(t: Tables) -> DataFrame:
    """A table that is saved over itself and read back; another format's is empty."""
    rows = t.customer.select(F.col("c_custkey").alias("class_fqn"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("source"))
    at = _folder(t, "map")
    store, other = Snapshots(t.spark, at, rows.schema), Snapshots(t.spark, at, rows.schema, version=2)
    store.save(rows)
    store.save(store.load().where("class_fqn % 2 = 0").withColumn("project", F.col("project") + 1).select(rows.columns))
    return store.load().unionByName(other.load())


@query("""select distinct o_custkey::varchar as id, case when o_orderkey % 3 = 0 then 'C' || o_orderkey % 50 || '.M' else 'Ns.C' || o_orderkey % 50 || '.M' end as test from orders where o_orderkey % 7 > 0""")
def listing_file_tests(t: Tables) -> DataFrame:
    """Names of a file that has nothing but names, of one dot too."""
    k = F.col("o_orderkey")
    line = F.when(k % 7 == 0, F.lit("not a name")).when(k % 3 == 0, _text("\tC", k % 50, ".M(1.5, \"a)\")")).otherwise(_text("Ns.C", k % 50, ".M "))
    return records.named_tests(t.orders.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.array_join(F.collect_list(line), "\r\n").alias("text")))


_SHOTS = "select user_id::varchar as file, event_id as seq, event_id::varchar as fp, case when event_type <> 'error' and value < 40 then 1 else 0 end as a, case when event_type <> 'click' and value < 30 then 1 else 0 end as b from events"


@query(f"""with e as ({_SHOTS}), a as (select file, max_by(fp, seq) as fp from e where a = 1 group by file), b as (select file, max_by(fp, seq) as fp from e where b = 1 group by file)
    select coalesce(a.file, b.file) as file, case when a.fp is null then 'added' when b.fp is null then 'deleted' else 'edited' end as kind, b.fp from a full join b on a.file = b.file where a.fp is distinct from b.fp""")
def committed_snapshots(t: Tables) -> DataFrame:
    """A stream of two snapshots; what changed between them, with the fingerprints that are kept at the end."""
    rows = t.events.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("string").alias("fp"), F.col("event_id").alias("seq"), "event_type", "value")
    at = _folder(t, "snapshots")
    store, told = Snapshots(t.spark, f"{at}/digest", rows.select("file", "fp").schema), Snapshots(t.spark, f"{at}/changes", t.spark.createDataFrame([], "file string, kind string").schema)
    for condition in ("event_type <> 'error' and value < 40", "event_type <> 'click' and value < 30"):
        rows.where(condition).select("file", "fp", "seq").write.mode("append").parquet(f"{at}/in")
        source = t.spark.readStream.schema("file string, fp string, seq long").parquet(f"{at}/in")
        batching.commit_snapshots(store, source, told.save).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return told.load().join(store.load(), "file", "left")


@query("""with l as (select o_custkey::varchar as project, o_orderkey as seq, case when o_orderstatus = 'P' then 'clear' else 'set' end as kind from orders), last as (select project, max_by(kind, seq) as kind, max(seq) as seq from l group by project)
    select project, 'd' || seq || x as item from last, (select unnest(['a', 'b']) as x) where kind = 'set'""")
def upserted_diagnostics(t: Tables) -> DataFrame:
    """K4: diagnostics that a stream's batches replace by project, one batch coming twice."""
    status = F.col("o_orderstatus")
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("project"), F.col("o_orderkey").alias("seq"), F.when(status == "P", "clear").otherwise("set").alias("kind"), F.when(status != "P", F.array(_text("d", F.col("o_orderkey"), "a"), _text("d", F.col("o_orderkey"), "b"))).alias("items"))
    most = rows.agg(F.max("seq")).head()[0] or 0
    at = _folder(t, "diagnostics")
    store = state(t.spark, at, "diagnostics")
    for condition in (F.col("seq") <= most // 2, F.col("seq") > most // 2):
        rows.where(condition).write.mode("append").parquet(f"{at}/in")
        source = t.spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        batching.commit_diagnostics(store, source).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.load()


@query("""select distinct 'C.' || o_custkey as line from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey where p_brand = 'Brand#4' union all select 'project:N' || n_nationkey from nation where n_nationkey % 2 = 0 and n_regionkey < 2""")
def selection_lines(t: Tables) -> DataFrame:
    """K3: classes, then projects that run whole, as lines."""
    file = t.part.where("p_brand = 'Brand#4'").select(_text("src/p", F.col("p_partkey")).alias("file"))
    classes = selection.hit_classes(selection.usable(file), selection.index(_class_files(t).select("class_fqn", F.array("file").alias("files"))))
    whole = t.nation.where("n_nationkey % 2 = 0 and n_regionkey < 2").select(_text("N", F.col("n_nationkey")).alias("project"))
    return selection.Affected(classes, whole, file).lines()


@query("""with q as (select user_id as c, min(event_id) as seq from events where event_type = 'view' group by user_id), s as (select user_id as c, count(*) as score from events group by user_id), b as (select c, 0 as tier, seq as rank from q union all select c, 1, -score from s),
    o as (select c, min((tier, rank)) as p from b group by c) select c::varchar as class_fqn, row_number() over (order by p, c::varchar) as place from o where c not in (select user_id from events where value > 250)""")
def refresh_places(t: Tables) -> DataFrame:
    """Queued classes first in, first out, then scored ones; places without a task that has all."""
    c = F.col("user_id").cast("string").alias("class_fqn")
    queue = t.events.where("event_type = 'view'").groupBy(c).agg(F.min("event_id").alias("seq"))
    return batching.refresh_order(queue, t.events.groupBy(c).agg(F.count("*").alias("score")), t.events.where("value > 250").select(c).distinct())


@query("""with q as (select s_suppkey as k, row_number() over (order by s_suppkey) - 1 as n, count(*) over () // 4 + 1 as e from supplier), p as (select k, e, row_number() over (order by n // e = 1, n) - 1 as n from q),
    s as (select s_nationkey as k, count(*) as score from supplier where s_nationkey > 3 group by s_nationkey order by score desc, 'T' || s_nationkey limit 6), r as (select k, row_number() over (order by score desc, 'T' || k) - 1 as n from s)
    select 'C' || k as class_fqn, (n // e)::bigint as turn from p union all select 'T' || k, ((select max(n // e) + 1 from p) + n // (select max(e) from p))::bigint from r""")
def drained_queue(t: Tables) -> DataFrame:
    """The queue measured a quarter at a time; the second batch is aborted and comes again at the end, and scored classes fill the queue when it is empty."""
    at = _folder(t, "refresh")
    queue, told, turn = RefreshQueue(t.spark, f"{at}/queue"), Snapshots(t.spark, f"{at}/told", t.spark.createDataFrame([], "class_fqn string, turn long").schema), itertools.chain([0, None], itertools.count(1))
    queue.add(t.supplier.select(_text("C", F.col("s_suppkey")).alias("class_fqn"), F.col("s_suppkey").alias("seq")))
    scored = t.supplier.where("s_nationkey > 3").groupBy(_text("T", F.col("s_nationkey")).alias("class_fqn")).agg(F.count("*").alias("score")).orderBy(F.desc("score"), "class_fqn").limit(6)

    def measure(classes: DataFrame) -> bool:
        now = next(turn)
        if now is not None:
            told.save(told.load().unionByName(classes.select("class_fqn", F.lit(now).cast("long").alias("turn"))))
        return now is not None

    for _ in range(2):  # the first drain ends with the abort
        queue.drain(measure, lambda tried: scored, each=t.supplier.count() // 4 + 1)
    return told.load()
