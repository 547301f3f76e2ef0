"""The operators over the driver's tables, which play roles, and the same in SQL.

Roles: part = source file, customer = test class (through its orders), nation =
project, l_quantity = line hits, l_returnflag = outcome (R failed, N skipped, A
passed), events = change events and measurements, documents = source texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import graph, learning, results, selection
from ..sources import projects, records
from ..sources.shared import stored
from ..streaming import batching

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _class_files(t: Tables) -> DataFrame:
    """(class_fqn, file): the parts that a customer ordered."""
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("C."), F.col("o_custkey")).alias("class_fqn"), F.concat(F.lit("src/p"), F.col("l_partkey")).alias("file"))


def _class_map(t: Tables) -> DataFrame:
    rows = _class_files(t).groupBy("class_fqn").agg(F.collect_set("file").alias("files"))
    owner = t.customer.select(F.concat(F.lit("C."), F.col("c_custkey")).alias("class_fqn"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("project"))
    return rows.join(owner, "class_fqn", "left")


def _changed(t: Tables) -> DataFrame:
    """Files of one brand, with a build output among them."""
    return t.part.where("p_brand = 'Brand#4'").select(F.explode(F.array(F.concat(F.lit("src/p"), F.col("p_partkey")), F.concat(F.lit("src/obj/p"), F.col("p_partkey")))).alias("file"))


_CLASS_FILES = "select 'C.' || o_custkey as class_fqn, 'src/p' || l_partkey as file from orders join lineitem on o_orderkey = l_orderkey"


@query(f"with cf as ({_CLASS_FILES}) select distinct class_fqn from cf join part on file = 'src/p' || p_partkey where p_brand = 'Brand#4' order by 1")
def affected_classes(t: Tables) -> DataFrame:
    """Classes that a changed file belongs to."""
    return selection.hit_classes(selection.usable(_changed(t)), selection.index(_class_files(t).select("class_fqn", F.array("file").alias("files")))).orderBy("class_fqn")


@query("""select case when p_partkey % 2 = 0 then 'Src' else '../other/Src' end || '/P' || p_partkey || '.v' || p_size as file from part where p_brand = 'Brand#4' and ('src/p' || p_partkey || '.v' || p_size not in (select 'src/p' || l_partkey || '.v' || cast(l_quantity as bigint) from lineitem) or p_partkey % 2 = 1)""")
def unknown_files(t: Tables) -> DataFrame:
    """Changed files that no class covers, with their own spelling. A part changed at its size, and a class covers it at the sizes in which it was ordered; the changes are absolute, half of them outside of the repository."""
    home = F.when(F.col("p_partkey") % 2 == 0, "/work/repo/Src/P").otherwise("/work/other/Src/P")
    changed = t.part.where("p_brand = 'Brand#4'").select(F.concat(home, "p_partkey", F.lit(".v"), "p_size").alias("file"))
    outputs = changed.select(F.concat(F.lit("/work/repo/obj/"), F.substring_index("file", "/", -1)))
    by_file = t.lineitem.select(F.concat(F.lit("src/p"), "l_partkey", F.lit(".v"), F.col("l_quantity").cast("bigint")).alias("file_key"), F.lit("x").alias("class_fqn"))
    return selection.unknown_files(selection.usable(changed.union(outputs), "/work/repo"), by_file).select("file")


@query("""with e as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey),
    recursive_walk as (with recursive w(node) as (select distinct s_nationkey from supplier where s_acctbal < 0 union select e.src from w join e on e.dst = w.node) select node from w)
    select node from recursive_walk""")
def fallback_projects(t: Tables) -> DataFrame:
    """Projects that depend on the owners of what is not mapped."""
    a, b = t.nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("dst > src").select("src", "dst")
    return graph.dependents_to(edges, t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("node")).distinct(), t.nation.select(F.col("n_nationkey").alias("node")))


@query("select 'C.' || c_custkey as class_fqn from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)")
def dedup_fallback(t: Tables) -> DataFrame:
    """Classes of projects that run whole are not listed again."""
    owned = t.customer.select(F.concat(F.lit("C."), F.col("c_custkey")).alias("class_fqn"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("project"))
    full = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("project")).distinct()
    return selection.without_full_projects(owned.select("class_fqn"), owned, full)


def _part_edges(t: Tables) -> DataFrame:
    """Halves and thirds, and a cycle of neighbours."""
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("src"))
    made = nodes.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3), F.col("src") + F.when(F.col("src") % 2 == 0, 1).otherwise(-1))).alias("dst"))
    return made.join(nodes.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", F.col("dst").cast("long").alias("dst"))


_EDGES = "select distinct src, dst from (select p_partkey as src, unnest([p_partkey // 2, p_partkey // 3, p_partkey + case when p_partkey % 2 = 0 then 1 else -1 end]) as dst from part) where dst in (select p_partkey from part)"


@query(f"with recursive e as ({_EDGES}), hub as (select dst as node from e group by dst having count(*) >= 6), w(root, node) as (select p_partkey, p_partkey from part union select w.root, e.dst from w join e on e.src = w.node where w.node not in (select node from hub)) select root, count(*) as reached, max(node) as highest from w group by root")
def forward_closure_capped(t: Tables) -> DataFrame:
    """G1, A10: what each node reaches; hubs are reached but not passed."""
    edges = _part_edges(t)
    hubs = edges.distinct().groupBy("dst").agg(F.count("*").alias("n")).where("n >= 6").select(F.col("dst").alias("node"))
    walk = graph.closure(edges, t.part.select(F.col("p_partkey").alias("root")), hubs)
    return walk.groupBy("root").agg(F.count("*").alias("reached"), F.max("node").alias("highest"))


@query("""with e as (select distinct o_custkey as src, l_suppkey + 1000000 as dst from orders join lineitem on o_orderkey = l_orderkey), n as (select (select count(*) from customer) + (select count(*) from supplier) as n)
    select dst as node, count(*) as degree from e where dst not in (select s_suppkey + 1000000 from supplier where s_acctbal > 9000) group by dst having count(*) >= (select greatest(10, floor(n * 30 / 100)) from n)""")
def hub_cap(t: Tables) -> DataFrame:
    """What too many refer to; tests are never capped."""
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    nodes = t.customer.select(F.col("c_custkey").alias("node"), F.lit(False).alias("is_test")).union(t.supplier.select(F.col("s_suppkey") + 1000000, F.col("s_acctbal") > 9000))
    return graph.hubs(edges, nodes)


@query("with recursive l(node, level) as (select p_partkey, 0 from part where p_partkey = 0 union select p.p_partkey, l.level + 1 from l join part p on p.p_partkey // 2 = l.node and p.p_partkey > 0) select node, max(level) as level from l group by node")
def dependency_levels(t: Tables) -> DataFrame:
    """An order in which what a node depends on comes first."""
    edges = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return graph.levels(edges, t.part.select(F.col("p_partkey").alias("node")))


@query("""with recursive e as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 0), w(root, node) as (select p_partkey, p_partkey from part union select w.root, e.src from w join e on e.dst = w.node),
    j as (select root, node, p_size > 3 as has from w join part on p_partkey = node where root <> node) select root as owner, node as dependent from j where root in (select root from j group by root having bool_and(has))""")
def guard_exempt(t: Tables) -> DataFrame:
    """Owners all of whose dependents have a baseline."""
    edges = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return graph.guard_exempt(edges, t.part.select(F.col("p_partkey").alias("owner")), t.part.where("p_size > 3").select(F.col("p_partkey").alias("node")))


@query("""with recursive e as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey), w(root, node) as (select n_nationkey, n_nationkey from nation union select w.root, e.dst from w join e on e.src = w.node)
    select root as node, sha1(string_agg(node || '=' || n_name, '+' order by node || '=' || n_name)) as stamp from w join nation on n_nationkey = node group by root""")
def transitive_stamps(t: Tables) -> DataFrame:
    """A stamp that changes with any dependency's."""
    a, b = t.nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("dst > src").select("src", "dst")
    return graph.transitive_stamps(edges, t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("stamp")))


@query("""with n as (select c_custkey as node, c_mktsegment as fqn, list_distinct([c_mktsegment, 'none']) as refs from customer), e as (select distinct x.src, n.node as dst from (select node as src, unnest(refs) as fqn from n) x join n on n.fqn = x.fqn) select src, count(*) as refs, max(dst) as highest from e group by src""")
def resolved_edges(t: Tables) -> DataFrame:
    """Names refer to every node that has them."""
    nodes = t.customer.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("fqn"), F.array("c_mktsegment", F.lit("none")).alias("ref_names"))
    return graph.resolved_degrees(nodes)


@query("""select p_type as asm, p_brand as fqn, arg_min('N' || p_size, p_partkey) as project, bool_or(p_size > 45) as is_test, string_agg(distinct 'f' || p_size, ',' order by 'f' || p_size) as files from part group by p_type, p_brand""")
def merged_nodes(t: Tables) -> DataFrame:
    """One node for each assembly and name."""
    rows = t.part.select(F.col("p_type").alias("asm"), F.col("p_brand").alias("fqn"), F.concat(F.lit("N"), F.col("p_size")).alias("project"), F.col("p_partkey").alias("seq"), (F.col("p_size") > 45).alias("is_test"), F.array(F.concat(F.lit("f"), F.col("p_size"))).alias("files"), F.array().cast("array<string>").alias("ref_names"))
    return graph.merged_nodes(rows).select("asm", "fqn", "project", "is_test", F.array_join("files", ",").alias("files"))


@query("select p_brand as fqn, string_agg(distinct p_name, '|' order by p_name) as files from part group by p_brand")
def type_index(t: Tables) -> DataFrame:
    """Files of each type over all assemblies."""
    nodes = t.part.select(F.col("p_brand").alias("fqn"), F.array("p_name").alias("files"))
    return graph.type_index(nodes).select("fqn", F.array_join("files", "|").alias("files"))


@query("""select o_custkey as node, string_agg(distinct p_name, '|' order by p_name) as abstract_files from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey where p_type in ('ECONOMY', 'PROMO') group by o_custkey""")
def abstraction_files(t: Tables) -> DataFrame:
    """Files of the abstractions that a node refers to itself."""
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_type") == "ECONOMY").alias("is_interface"), (F.col("p_type") == "PROMO").alias("is_abstract"), F.array("p_name").alias("files"))
    return graph.abstraction_files(edges, nodes).select("node", F.array_join("abstract_files", "|").alias("abstract_files"))


@query("""with w as (select distinct doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+')) as word from documents), c as (select distinct item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+')) as word from benchmark),
    n as (select item_id, word as short, row_number() over (partition by item_id order by length(word) desc, word) as r from c), e as (select distinct doc_id, item_id from w join n on short = word where r <= 2 and length(short) >= 3 and 1000000 + item_id <> doc_id and doc_id % 7 <> item_id % 7 and not (doc_id % 11 = 0 and item_id % 3 = 0))
    select item_id, count(*) as mentioning from e group by item_id""")
def name_mentions(t: Tables) -> DataFrame:
    """Texts that hold a candidate's short name as a whole word, as an equi-join of words; files that are shared and edges that exist don't count."""
    short = t.benchmark.select("item_id", F.explode(names.words(F.col("text"))).alias("word"))
    best = short.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.length("word")).alias("l"), "word"))), 1, 2).alias("two"))
    nodes = best.select((F.col("item_id") + 1000000).alias("node"), F.explode("two.word").alias("word")).select("node", F.concat(F.lit("Ns.T."), "word").alias("fqn"), F.lit(True).alias("is_enum"), F.lit(False).alias("is_const_only"), F.array(F.concat(F.lit("f"), (F.col("node") - 1000000) % 7)).alias("files"))
    texts = t.documents.select(F.col("doc_id").alias("node"), F.concat(F.lit("f"), F.col("doc_id") % 7).alias("file"), "text")
    known = t.documents.where("doc_id % 11 = 0").select(F.col("doc_id").alias("src")).join(t.benchmark.where("item_id % 3 = 0").select((F.col("item_id") + 1000000).alias("dst")))
    candidates = graph.name_candidates(nodes)
    found = graph.mention_edges(graph.mentions(texts, candidates), candidates, known)
    return found.groupBy((F.col("dst") - 1000000).alias("item_id")).agg(F.count("*").alias("mentioning"))


@query("""with f as (select page_id, regexp_extract(url, '://([^?#]*)', 1) as file from pages), d as (select distinct regexp_extract(file, '^([^/]*)', 1) as dir from f union select distinct regexp_extract(file, '^([^/]*/[^/]*)/', 1) from f where file like '%/%/%')
    select page_id, file, arg_max(dir, length(dir)) as project from f left join d on dir <> '' and starts_with(lower(file), lower(dir) || '/') group by page_id, file""")
def nearest_ancestor(t: Tables) -> DataFrame:
    """The nearest folder above that is a project's, by an equi-join on the folders above."""
    files = t.pages.select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("file"))
    dirs = files.select(F.regexp_extract("file", "^([^/]*)", 1).alias("dir")).union(files.where("file like '%/%/%'").select(F.regexp_extract("file", "^([^/]*/[^/]*)/", 1))).where("dir <> ''").distinct()
    return selection.owners(files, dirs.select("dir", F.col("dir").alias("project")))


def _outcomes(t: Tables) -> DataFrame:
    method = F.concat(F.lit("C."), F.col("l_suppkey"), F.lit(".M"), F.col("l_linenumber"), F.lit("(q: "), F.col("l_quantity").cast("int"), F.lit(")"))
    return t.lineitem.select(
        F.concat(F.lit("C."), F.col("l_suppkey")).alias("class_fqn"), method.alias("method"), (F.col("l_returnflag") == "A").alias("passed"), (F.col("l_returnflag") == "N").alias("skipped"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 3 > 0), F.concat(F.lit("m"), F.col("l_partkey"))).alias("message"), F.col("l_quantity").alias("duration_ms"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
    )


@query("""with m as (select l_suppkey, l_linenumber, max(case when l_returnflag = 'R' then 1 else 0 end) as f, min(case when l_returnflag = 'N' then 1 else 0 end) as s from lineitem group by all)
    select 'C.' || l_suppkey as class_fqn, case max(case when f = 1 then 2 when s = 1 then 0 else 1 end) when 2 then 'failed' when 1 then 'passed' else 'skipped' end as verdict from m group by l_suppkey""")
def class_verdicts(t: Tables) -> DataFrame:
    """A1, F1: failed before passed before skipped, cases of a method together."""
    return results.class_verdicts(_outcomes(t))


@query("""select 'C.' || l_suppkey as class_fqn, 'C.' || l_suppkey || '.M' || l_linenumber as method, sum(l_quantity) as duration_ms, bool_and(l_returnflag = 'N') as skipped, not bool_or(l_returnflag = 'R') as passed,
    string_agg(case when l_returnflag = 'R' then 'C.' || l_suppkey || '.M' || l_linenumber || '(q: ' || l_quantity::int || '): ' || case when l_partkey % 3 > 0 then 'm' || l_partkey else 'failed' end end, chr(10) order by l_orderkey, l_linenumber, l_partkey) as message from lineitem group by l_suppkey, l_linenumber""")
def method_report(t: Tables) -> DataFrame:
    """A2: a method's cases in one row, with the failed ones named in order; one that says nothing has failed."""
    return results.method_report(_outcomes(t))


@query("""select class_fqn, bool_and(ok) as passed, sum(q) as duration_ms from (select 'C.' || l_suppkey as class_fqn, l_linenumber, not bool_or(l_returnflag = 'R') as ok, sum(l_quantity) as q from lineitem group by all) group by class_fqn""")
def class_report(t: Tables) -> DataFrame:
    """A3."""
    return results.class_report(results.method_report(_outcomes(t)))


@query("select file, line, sum(h)::bigint as hits from (select l_suppkey, 'f' || l_partkey as file, l_linenumber as line, max(cast(l_quantity as bigint)) as h from lineitem group by all) group by file, line")
def line_hits_max_then_sum(t: Tables) -> DataFrame:
    """The most within a project, added over projects."""
    lines = t.lineitem.select(F.col("l_suppkey").alias("project"), F.concat(F.lit("f"), F.col("l_partkey")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("hits"))
    return results.merged_hits(lines)


@query("select 'f' || l_partkey as file from lineitem group by l_partkey having max(case when l_returnflag = 'R' then l_quantity else 0 end) > 0")
def hit_files(t: Tables) -> DataFrame:
    """Files with a line that ran."""
    return results.hit_files(t.lineitem.select(F.concat(F.lit("f"), F.col("l_partkey")).alias("file"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0).alias("hits")))


@query("""select 'O' || o_orderkey as method_fqn, case when o_orderstatus = 'P' then 'skipped' when o_orderstatus = 'O' then 'passed' else 'failed' end as state from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')
    and o_custkey in (select c_custkey from customer where c_acctbal > 0)""")
def replay_known(t: Tables) -> DataFrame:
    """Known results of live methods that were not reported again."""
    known = t.orders.select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("method_fqn"), "o_custkey", (F.col("o_orderstatus") == "O").alias("passed"), (F.col("o_orderstatus") == "P").alias("skipped"))
    live = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("method_fqn"))
    reported = t.lineitem.where("l_returnflag = 'R'").select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("method_fqn"))
    return results.replayed(results.forgotten(known, live), reported).select("method_fqn", "state")


@query("""with f as (select l_orderkey as k, 'M' || l_orderkey || '(' || l_linenumber || '.5)' as m, 'q' || l_quantity::int as message from lineitem where l_returnflag = 'R')
    select 'Ns.C' || k as class_fqn, m as method, false as passed, false as skipped, message from f where k % 5 > 0 union all
    select 'Ns.C' || l_orderkey, 'M' || l_orderkey || '(' || l_linenumber || '.5)', true, false, null from lineitem where l_orderkey % 5 > 0 group by l_orderkey, l_linenumber having not bool_or(l_returnflag = 'R')""")
def synthesised_outcomes(t: Tables) -> DataFrame:
    """What was discovered and did not fail has passed; names without a class are no tests."""
    bare = F.concat(F.lit("M"), "l_orderkey", F.lit("("), "l_linenumber", F.lit(".5)"))
    name = F.when(F.col("l_orderkey") % 5 > 0, F.concat(F.lit("Ns.C"), "l_orderkey", F.lit("."), bare)).otherwise(bare)
    return results.synthesised(t.lineitem.select(name.alias("method_fqn")), t.lineitem.where("l_returnflag = 'R'").select(name.alias("method_fqn"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("message")))


@query("""with b as (select user_id as file, max(event_id)::varchar as fp from events where event_type <> 'error' and value < 40 group by user_id), a as (select user_id as file, max(event_id)::varchar as fp from events where event_type <> 'click' and value < 30 group by user_id)
    select coalesce(a.file, b.file) as file, case when b.fp is null then 'added' when a.fp is null then 'deleted' else 'edited' end as kind from b full join a on a.file = b.file where a.fp is distinct from b.fp""")
def snapshot_diff(t: Tables) -> DataFrame:
    """What was added, deleted or edited between two snapshots."""
    shot = lambda c: t.events.where(c).groupBy(F.col("user_id").alias("file")).agg(F.max("event_id").cast("string").alias("fp"))
    return selection.snapshot_diff(shot("event_type <> 'error' and value < 40"), shot("event_type <> 'click' and value < 30"))


@query("""select c_custkey as class_fqn, c_nationkey as project from customer where case when c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) then c_custkey in (select o_custkey from orders where o_orderstatus = 'F') else c_nationkey in (select s_nationkey from supplier) end""")
def prune_rows(t: Tables) -> DataFrame:
    """J12."""
    rows = t.customer.select(F.col("c_custkey").alias("class_fqn"), F.col("c_nationkey").alias("project"))
    live = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("class_fqn"))
    return selection.pruned(rows, live, t.supplier.select(F.col("s_nationkey").alias("project")), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("project")))


@query("""with o as (select c_custkey as k, c_nationkey as p, case when c_acctbal > 0 then 'coverage' else 'static' end as s from customer where c_acctbal < 7000), n as (select c_custkey as k, c_nationkey + 100 as p, case when c_mktsegment = 'BUILDING' then 'coverage' else 'static' end as s from customer where c_acctbal > -500)
    select coalesce(o.k, n.k) as class_fqn, case when n.k is null or (o.s = 'coverage' and n.s = 'static') then o.p else n.p end as project, case when n.k is null or (o.s = 'coverage' and n.s = 'static') then o.s else n.s end as source from o full join n on o.k = n.k""")
def merged_map(t: Tables) -> DataFrame:
    """Static never replaces coverage."""
    none = F.array().cast("array<string>").alias("abstract_files")
    old = t.customer.where("c_acctbal < 7000").select(F.col("c_custkey").alias("class_fqn"), F.col("c_nationkey").alias("project"), F.when(F.col("c_acctbal") > 0, "coverage").otherwise("static").alias("source"), none)
    new = t.customer.where("c_acctbal > -500").select(F.col("c_custkey").alias("class_fqn"), (F.col("c_nationkey") + 100).alias("project"), F.when(F.col("c_mktsegment") == "BUILDING", "coverage").otherwise("static").alias("source"), none)
    return selection.merged_map(old, new).select("class_fqn", "project", "source")


def _measurements(t: Tables) -> DataFrame:
    """A user's errors and purchases measure files; the abstractions are by event type."""
    value = F.col("value").cast("int")
    files = F.array(F.concat(F.lit("f"), value % 7), F.concat(F.lit("f"), F.col("event_id") % 5), F.concat(F.lit("f"), F.col("user_id") % 3))
    return t.events.where("value is not null").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("class_fqn"), files.alias("measured"), F.array(F.concat(F.lit("f"), F.col("user_id") % 3)).alias("static_files"), F.array(F.concat(F.lit("A"), F.col("user_id") % 4), F.lit("F1")).alias("abstract_files"))


@query("""with m as (select event_id as seq, user_id::varchar as class_fqn, user_id, ['f' || trunc(value)::int % 7, 'f' || event_id % 5, 'f' || user_id % 3] as measured from events where value is not null), b as (select *, coalesce(lag(measured) over (partition by class_fqn order by seq), ['f' || user_id % 3]) as baseline from m),
    d as (select seq, class_fqn, user_id, unnest(list_distinct(list_filter(measured, lambda x: not list_contains(baseline, x)))) as "to" from b) select distinct seq, class_fqn, from_key, "to" from (select seq, class_fqn, unnest(['a' || user_id % 4, 'f1']) as from_key, "to" from d) where from_key <> "to" """)
def mine_delta(t: Tables) -> DataFrame:
    """What a measurement has over its baseline, with each abstraction."""
    return learning.mined_pairs(learning.with_baseline(_measurements(t)))


@query("""with m as (select event_id as seq, user_id::varchar as class_fqn, user_id, ['f' || trunc(value)::int % 7, 'f' || event_id % 5, 'f' || user_id % 3] as measured from events where value is not null), b as (select *, coalesce(lag(measured) over (partition by class_fqn order by seq), ['f' || user_id % 3]) as baseline from m),
    k as (select *, unnest(['a' || user_id % 4, 'f1']) as from_key from b), mined as (select distinct seq, from_key, f as "to" from (select seq, from_key, unnest(list_filter(measured, lambda x: not list_contains(baseline, x))) as f from k) where f <> from_key), edges as (select distinct from_key, "to" from mined),
    ev as (select k.from_key, e."to", k.seq, {'live': false, 'c': 0::bigint, 'x': 0::bigint, 'last': k.seq::bigint, 'who': [k.class_fqn], 'mined': mined.seq is not null, 'has': list_contains(k.measured, e."to")} as s from k join edges e using (from_key) left join mined on mined.seq = k.seq and mined.from_key = k.from_key and mined."to" = e."to"),
    l as (select from_key, "to", list(s order by seq) as s from ev group by from_key, "to"),
    done as (select from_key, "to", list_reduce(list_concat([{'live': false, 'c': 0::bigint, 'x': 0::bigint, 'last': 0::bigint, 'who': []::varchar[], 'mined': false, 'has': false}], s), lambda a, e: case
      when a.live and (e.mined or e.has) then {'live': true, 'c': a.c + 1, 'x': a.x, 'last': e.last, 'who': case when e.mined and not list_contains(a.who, e.who[1]) then list_concat(a.who, e.who) else a.who end, 'mined': false, 'has': false}
      when e.mined then {'live': true, 'c': 1::bigint, 'x': 0::bigint, 'last': e.last, 'who': e.who, 'mined': false, 'has': false}
      when a.live then {'live': not (a.x + 1 >= 4 and a.x + 1 > 2 * a.c), 'c': a.c, 'x': a.x + 1, 'last': a.last, 'who': a.who, 'mined': false, 'has': false} else a end) as z from l)
    select from_key, "to", 'mined' as source, z.c as confirms, z.x as contradicts, z.last as last_seq, list_aggregate(z.who, 'string_agg', ',') as evidence from done where z.live""")
def evidence_fold(t: Tables) -> DataFrame:
    """Bindings after all measurements, an ordered fold per edge."""
    return learning.evidence(learning.with_baseline(_measurements(t))).withColumn("evidence", F.array_join("evidence", ","))


@query("""with b as (select l_suppkey as from_key, 'f' || l_partkey as file_key, l_returnflag = 'R' as parsed, count(*) as confirms from lineitem group by l_suppkey, l_partkey, l_returnflag), s as (select c_custkey as class_fqn, c_nationkey as from_key from customer where c_acctbal < 3000)
    select distinct class_fqn from b join s on s.from_key = b.from_key where file_key in (select 'f' || p_partkey from part where p_brand = 'Brand#4')""")
def learned_selection(t: Tables) -> DataFrame:
    """Static classes that learnt edges add."""
    return _learned(t)[0]


@query("""with b as (select l_suppkey as from_key, 'f' || l_partkey as file_key, l_returnflag = 'R' as parsed, count(*) as confirms from lineitem group by l_suppkey, l_partkey, l_returnflag), s as (select c_custkey as class_fqn, c_nationkey as from_key from customer where c_acctbal < 3000)
    select file_key from b left join s on s.from_key = b.from_key where file_key in (select 'f' || p_partkey from part where p_brand = 'Brand#4') group by file_key having bool_or(class_fqn is not null) and bool_or(parsed or confirms >= 2)""")
def covered_files(t: Tables) -> DataFrame:
    """Files that learnt edges cover, so that they need no fallback."""
    return _learned(t)[1]


def _learned(t: Tables):
    bindings = t.lineitem.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count("*").alias("confirms")).select(F.col("l_suppkey").cast("string").alias("from_key"), F.concat(F.lit("F"), F.col("l_partkey")).alias("to"), F.when(F.col("l_returnflag") == "R", "parsed").otherwise("mined").alias("source"), "confirms")
    rows = t.customer.select(F.col("c_custkey").alias("class_fqn"), F.when(F.col("c_acctbal") < 3000, "static").otherwise("coverage").alias("source"), F.array(F.col("c_nationkey").cast("string")).alias("abstract_files"))
    changed = t.part.where("p_brand = 'Brand#4'").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("file_key"))
    return selection.learned(changed, bindings, rows)


@query("""with a as (select o_custkey as class_fqn, l_partkey as a from orders join lineitem on o_orderkey = l_orderkey where l_partkey not in (select p_partkey from part where p_size < 10)), s as (select a, count(*) as n from a group by a)
    select class_fqn, sum(n)::bigint as score from a join s using (a) group by class_fqn order by score desc, class_fqn limit 20""")
def learning_targets(t: Tables) -> DataFrame:
    """The classes that would tell most."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("class_fqn")).agg(F.collect_list("l_partkey").alias("abstract_files"))
    return learning.targets(rows, t.part.where("p_size < 10").select(F.col("p_partkey").alias("abstract_file")))


@query("select count(*) as total, count(*) filter (event_type = 'error') as mined, count(*) filter (event_type = 'click') as parsed from events")
def binding_counts(t: Tables) -> DataFrame:
    """A7."""
    return learning.binding_counts(t.events.select(F.when(F.col("event_type") == "error", "mined").when(F.col("event_type") == "click", "parsed").alias("source")))


@query("select event_id from events where epoch_ms(timestamp '2024-02-10') - epoch_ms(ts) <= 2592000000")
def decayed_bindings(t: Tables) -> DataFrame:
    """Seen in the last 30 days."""
    rows = t.events.select("event_id", F.expr(f"timestamp_micros({US})").alias("last_seen"))
    return learning.decayed(rows, 1707523200000).select("event_id")


@query("""select distinct l_suppkey as class_fqn from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag <> 'N' and not (s_acctbal > 0 and s_nationkey % 2 = 0)""")
def refresh_candidates(t: Tables) -> DataFrame:
    """Classes that ran and have no fresh coverage."""
    ran = t.lineitem.select(F.col("l_suppkey").alias("class_fqn"), (F.col("l_returnflag") == "N").alias("skipped"))
    old, new = F.lit(0), F.lit(1_000_000_000_000)
    rows = t.supplier.select(F.col("s_suppkey").alias("class_fqn"), F.lit("p").alias("project"), F.when(F.col("s_acctbal") > 0, "coverage").otherwise("static").alias("source"), F.timestamp_millis(F.when(F.col("s_nationkey") % 2 == 0, new).otherwise(old)).alias("updated_at"))
    return learning.to_refresh(ran, rows, 1_000_000_100_000)


@query("""select from_key, "to" from (select 'n' || c_nationkey as from_key, 'n' || c_custkey % 40 as "to" from customer group by all) where from_key in (select 'n' || n_nationkey from nation where n_regionkey < 3) and "to" in (select 'n' || n_nationkey from nation where n_regionkey < 3)""")
def pruned_bindings(t: Tables) -> DataFrame:
    """Both ends exist."""
    rows = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("from_key"), F.concat(F.lit("n"), F.col("c_custkey") % 40).alias("to")).distinct()
    return learning.existing(rows, t.nation.where("n_regionkey < 3").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("file")))


@query("""select name, case when exact is not null then exact when n = 1 then short end as fqn from (select distinct c_mktsegment || '.T' || c_custkey % 300 as name from customer) left join (select distinct p_type || '.T' || p_partkey % 300 as exact from part) on exact = name
    left join (select 'T' || p_partkey % 300 as s, min(p_type || '.T' || p_partkey % 300) as short, count(distinct p_type || '.T' || p_partkey % 300) as n from part group by 1) on s = split_part(name, '.', 2)""")
def resolution_ladder(t: Tables) -> DataFrame:
    """Exact, else bare, else the only one of that short name."""
    wanted = t.customer.select(F.concat("c_mktsegment", F.lit(".T"), F.col("c_custkey") % 300).alias("name"))
    return learning.resolved_names(wanted, t.part.select(F.concat("p_type", F.lit(".T"), F.col("p_partkey") % 300).alias("fqn")))


def _events(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.expr(US).alias("us"), F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("file"), "event_type", "value")


@query("""with g as (select user_id as key, epoch_us(ts) as us, event_id % 10 as file, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 14400000000 then 0 else 1 end as b, event_id from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(b) over (partition by key order by us, event_id rows unbounded preceding) as batch from g)
    select key, batch::bigint as batch, count(distinct file) as n_files, count(*) as n_events, max(us) + 14400000000 as due_us from s group by key, batch""")
def debounce_batches(t: Tables) -> DataFrame:
    """Bursts of events; one after exactly the gap begins a new burst."""
    return batching.batches(_events(t), 14_400_000_000)


@query("""with e as (select event_id, user_id, event_id % 10 as file, epoch_us(ts) as us, event_type, value, last_value(case when event_type = 'view' then epoch_us(ts) end ignore nulls) over (partition by user_id, event_id % 10 order by ts, event_id rows between unbounded preceding and 1 preceding) as saved from events)
    select event_id as seq, case when not coalesce(value > 5, false) then 'not-source' when us - saved <= 86400000000 then 'recent-save' when value > 60 then 'dirty-editor' else 'queued' end as verdict from e where event_type <> 'view'""")
def change_verdicts(t: Tables) -> DataFrame:
    """Echoes of saves are dropped."""
    rows = _events(t).withColumns({"kind": F.when(F.col("event_type") == "view", "save").otherwise("change"), "watched": F.coalesce(F.col("value") > 5, F.lit(False)), "dirty": F.coalesce(F.col("value") > 60, F.lit(False))})
    return batching.change_verdicts(rows, 86_400_000_000).select("seq", "verdict")


@query("""with e as (select user_id as key, epoch_us(ts) as us, event_id as n, event_id % 10 as file, case event_type when 'error' then 'pause' when 'signup' then 'resume' when 'purchase' then 'all' else 'change' end as kind from events),
    turns as (select key, us, n, kind, lag(kind, 1, 'resume') over (partition by key order by us, n) as former from e where kind in ('pause', 'resume')), real as (select key, us, n, kind, row_number() over (partition by key, kind order by us, n) as flush from turns where kind <> former),
    spans as (select a.key, a.flush, a.us as us_a, a.n as n_a, b.us as us_b, b.n as n_b from real a join real b on a.key = b.key and a.flush = b.flush and a.kind = 'pause' and b.kind = 'resume')
    select s.key, s.flush, us_b as us, case when bool_or(e.kind = 'all') then 0 else count(distinct e.file) end as n_files, bool_or(e.kind = 'all') as everything from spans s join e on e.key = s.key and e.kind in ('change', 'all') and (e.us, e.n) > (us_a, n_a) and (e.us, e.n) < (us_b, n_b) group by s.key, s.flush, us_b""")
def pause_resume(t: Tables) -> DataFrame:
    """Changes of a pause come at once when it ends; a pause while paused begins none."""
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").when(F.col("event_type") == "purchase", "all").otherwise("change")
    return batching.paused(_events(t).withColumn("kind", kind))


@query("select class_fqn from (select user_id as class_fqn, arg_max(event_type <> 'error', event_id) as ok from events where event_type <> 'signup' group by user_id) where not ok")
def last_failures(t: Tables) -> DataFrame:
    """Classes whose last outcome that counts failed."""
    return results.last_failures(t.events.select(F.col("user_id").alias("class_fqn"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("passed"), (F.col("event_type") == "signup").alias("skipped")))


@query("select s_suppkey as class_fqn, case when s_acctbal < 0 then 0 else 1 end as run_pass from supplier order by run_pass, class_fqn")
def failure_first(t: Tables) -> DataFrame:
    """L3."""
    return results.failure_first(t.supplier.select(F.col("s_suppkey").alias("class_fqn")), t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("class_fqn")))


@query("select event_type as op, median(value) as median_ms, median(case when user_id > 1 then value end) as steady_ms from events group by event_type")
def steady_median(t: Tables) -> DataFrame:
    """A18."""
    return results.steady_median(t.events.select(F.col("event_type").alias("op"), F.col("user_id").alias("pass"), F.col("value").alias("ms")))


@query("select count(*) filter (l_returnflag = 'A') as passed, count(*) filter (l_returnflag = 'R') as failed, count(*) filter (l_returnflag = 'N') as skipped, count(*) as total from lineitem")
def run_summary(t: Tables) -> DataFrame:
    """A14."""
    return results.run_summary(_outcomes(t))


@query("select event_type as capability from events group by event_type having count(distinct user_id % 7) = (select count(distinct user_id % 7) from events)")
def shared_capabilities(t: Tables) -> DataFrame:
    """What all hosts can do."""
    return results.shared_capabilities(t.events.groupBy((F.col("user_id") % 7).alias("host")).agg(F.collect_set("event_type").alias("capabilities")), ["view"])


@query("""select o_custkey as push, count(*) filter (o_orderstatus = 'O') as applied, count(*) filter (o_orderstatus = 'P') as not_loaded, count(*) filter (o_orderstatus = 'F') as rejected, count(*) filter (o_orderstatus = 'O') > 0 and count(*) filter (o_orderstatus = 'F') = 0 as patched from orders group by o_custkey""")
def push_tally(t: Tables) -> DataFrame:
    """A16, F17."""
    return results.push_tally(t.orders.select(F.col("o_custkey").alias("push"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(9).alias("code")))


@query("select l_orderkey as run, bool_and(l_returnflag <> 'R' or l_linestatus = 'O') as ok from lineitem group by l_orderkey")
def runs_ok(t: Tables) -> DataFrame:
    """A17."""
    return results.run_ok(t.lineitem.select(F.col("l_orderkey").alias("run"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_linestatus") == "O").alias("cancelled")))


@query('select user_id as "group", min(value) >= max(value) as coherent from events group by user_id')
def coherent_hosts(t: Tables) -> DataFrame:
    """W5."""
    return results.coherent(t.events.select(F.col("user_id").alias("group"), F.col("value").alias("generation")))


@query("""select source as project, count(*) as n, max(n_chars) as newest_ms, substr(sha1(string_agg('d' || doc_id, chr(10) order by 'd' || doc_id)), 1, 12) as digest from documents group by source having max(n_chars) < 1000000""")
def folder_stamps(t: Tables) -> DataFrame:
    """Count, newest and digest of a folder's files, if older than the sync."""
    files = t.documents.select(F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id")).alias("file"), F.col("n_chars").alias("modified_ms"))
    return projects.recordable(projects.folder_stamps(files), 1_000_000)


@query("select o_custkey as project, max(o_totalprice) as newest_ms, string_agg(o_orderkey || ':' || o_orderstatus || ':' || o_totalprice::decimal(18,2), '|' order by o_orderkey || ':' || o_orderstatus || ':' || o_totalprice::decimal(18,2)) as token from orders group by o_custkey")
def output_tokens(t: Tables) -> DataFrame:
    """A13."""
    files = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("size"), F.col("o_totalprice").cast("decimal(18,2)").alias("modified_ms"))
    return projects.output_tokens(files).withColumn("newest_ms", F.col("newest_ms").cast("double"))


@query("select l_suppkey as project, arg_min(l_partkey, (-epoch_ms(l_shipdate), l_partkey)) as file from lineitem where l_linenumber <= 4 group by l_suppkey")
def newest_artifacts(t: Tables) -> DataFrame:
    """The newest within a depth."""
    files = t.lineitem.select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("depth"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)").alias("modified_ms"))
    return projects.newest_artifacts(files)


@query("select file, count(*) as n from (select distinct 'p' || l_partkey as file from lineitem where l_returnflag = 'R' union select 'o' || l_orderkey from lineitem where l_returnflag = 'R' union select 'p' || l_suppkey from lineitem where l_returnflag = 'A') group by file")
def change_union(t: Tables) -> DataFrame:
    """All changes with the origins of renames."""
    pair = lambda flag, a, b: t.lineitem.where(F.col("l_returnflag") == flag).select(a.alias("file"), b.alias("origin"))
    p = lambda x, c: F.concat(F.lit(x), F.col(c))
    return selection.change_set(pair("R", p("p", "l_partkey"), p("o", "l_orderkey")), pair("A", p("p", "l_suppkey"), F.lit(None).cast("string"))).groupBy("file").agg(F.count("*").alias("n"))


@query("select o_custkey as file, o_custkey in (select c_custkey from customer where c_acctbal > 0) as tracked from (select distinct o_custkey from orders where o_orderstatus = 'P') where o_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def overlay_restores(t: Tables) -> DataFrame:
    """U7."""
    file = lambda df: df.select(F.col("o_custkey").alias("file"))
    return selection.overlay_restores(file(t.orders.where("o_orderstatus = 'P'")).distinct(), file(t.orders.where("o_orderpriority = '1-URGENT'")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("file")))


@query("select 'N' || coalesce(c_nationkey, 99) as project, o_custkey as class_fqn from (select distinct o_custkey from orders) left join customer on c_custkey = o_custkey and c_acctbal > 0")
def classes_by_project(t: Tables) -> DataFrame:
    """The map's project, else the owner's."""
    rows = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("class_fqn"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("project"))
    ran = t.orders.select(F.col("o_custkey").alias("class_fqn")).distinct()
    return selection.by_project(ran, rows, ran.withColumn("project", F.lit("N99")))


@query("""with recursive e as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey), w(root, node) as (select n_nationkey, n_nationkey from nation union select w.root, e.dst from w join e on e.src = w.node)
    select c_custkey as class_fqn, 'M' || c_mktsegment as method_fqn from customer where c_nationkey in (select root from w join supplier on s_nationkey = node where s_acctbal < -500)""")
def build_skips(t: Tables) -> DataFrame:
    """Methods whose projects reach one that was not built."""
    a, b = t.nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    reach = graph.closure(a.join(b, "n_regionkey").where("dst > src"), t.nation.select(F.col("n_nationkey").alias("root")))
    selected = t.customer.select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("class_fqn"), F.concat(F.lit("M"), F.col("c_mktsegment")).alias("method_fqn"))
    return results.build_skips(selected, reach, t.supplier.where("s_acctbal < -500").select(F.col("s_nationkey").alias("project")))


@query("select event_id, case when user_id < 50 then 'F' || user_id when event_type in ('view', 'click') then 'H' || event_type else 'B' end as owner from events")
def diagnostic_owners(t: Tables) -> DataFrame:
    """The file's project, else the hinted one, else the built one."""
    rows = t.events.select("event_id", F.col("user_id").alias("file"), F.upper("event_type").alias("hint"), F.lit("B").alias("built"))
    owned = t.events.where("user_id < 50").select(F.col("user_id").alias("file"), F.concat(F.lit("F"), F.col("user_id")).alias("project"))
    hinted = t.events.where("event_type in ('view', 'click')").select(F.col("event_type").alias("name"), F.concat(F.lit("H"), F.col("event_type")).alias("project"))
    return results.diagnostic_owners(rows, owned, hinted).select("event_id", "owner")


@query("select o_custkey::varchar as id, o_orderpriority[1:1] || 'M' as status, 'f' || o_orderkey as file, null::varchar as origin from orders")
def status_records(t: Tables) -> DataFrame:
    """NUL-separated records of a working tree, made of all orders of a customer."""
    line = F.concat(F.substr("o_orderpriority", F.lit(1), F.lit(1)), F.lit("M f"), F.col("o_orderkey"))
    raw = t.orders.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.array_join(F.collect_list(line), "\x00").alias("text"))
    return records.status_records(raw)


@query("select o_custkey::varchar as id, case o_orderstatus when 'P' then 'R100' else o_orderstatus end as status, 'f' || o_orderkey as file, case when o_orderstatus = 'P' then 'g' || o_orderkey end as origin from orders")
def name_status_records(t: Tables) -> DataFrame:
    """Renames take two paths."""
    key = F.col("o_orderkey")
    plain = F.concat_ws("\x00", "o_orderstatus", F.concat(F.lit("f"), key))
    moved = F.concat_ws("\x00", F.lit("R100"), F.concat(F.lit("g"), key), F.concat(F.lit("f"), key))
    raw = t.orders.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.array_join(F.collect_list(F.when(F.col("o_orderstatus") == "P", moved).otherwise(plain)), "\x00").alias("text"))
    return records.name_status_records(raw)


@query("select distinct o_custkey::varchar as id, 'Ns.C' || o_orderkey % 50 || '.Test' as test from orders")
def listed_tests(t: Tables) -> DataFrame:
    """Names of a listing."""
    line = F.concat(F.lit("    Ns.C"), F.col("o_orderkey") % 50, F.lit(".Test"))
    raw = t.orders.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.concat(F.lit("Build started\nThe following Tests are available:\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return records.listed_tests(raw)


@query("""select distinct l_orderkey::varchar as id, 'src/p' || l_partkey || '.cs' as file, l_linenumber - 1 as start_line, l_suppkey::int as start_col, case when l_returnflag = 'R' then 'error' else 'warning' end as severity, 'CS' || l_suppkey as code, 'q ' || l_partkey as message from lineitem""")
def build_messages(t: Tables) -> DataFrame:
    """Build output, 1-based places turned into 0-based ones, each message once."""
    line = F.concat(F.lit("  src/p"), F.col("l_partkey"), F.lit(".cs("), F.col("l_linenumber"), F.lit(","), F.col("l_suppkey") + 1, F.lit("): "), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning"), F.lit(" CS"), F.col("l_suppkey"), F.lit(": q "), F.col("l_partkey"), F.lit(" [a/P.csproj]"))
    raw = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_join(F.flatten(F.collect_list(F.array(line, line, F.lit("noise")))), "\n").alias("text"))
    return records.build_messages(raw).select("id", "file", "start_line", "start_col", "severity", "code", "message")


@query("""select l_orderkey::varchar as id, 'Ns.M' || l_partkey as method, 'said ' || l_quantity::int as message from lineitem where l_returnflag = 'R'""")
def run_failures(t: Tables) -> DataFrame:
    """Failures of a console run."""
    part = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("failed Ns.M"), F.col("l_partkey"), F.lit(" (3ms)\n  said "), F.col("l_quantity").cast("int"))).otherwise(F.lit("passed x\n  quiet"))
    raw = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_join(F.collect_list(part), "\n").alias("text"))
    return records.run_output(raw)[0]


@query("""with lines as (select conv_id::varchar || ':' || turn as id, turn, unnest(regexp_split_to_array(text, '\\r?\\n')) as x from conversations) select id, count(*) as n, count(*) filter (regexp_matches(x, '^\\s+\\S')) as indented from lines group by id""")
def text_lines(t: Tables) -> DataFrame:
    """The lines of texts."""
    raw = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return records.text_lines(raw).groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike(r"^\s+\S")).alias("indented"))


@query("select o_custkey::varchar as id, o_custkey % 3 = 0 and bool_or(o_orderkey % 10 = 3) as bare from orders group by o_custkey")
def bare_names(t: Tables) -> DataFrame:
    """Listings, some without a heading, that name something without a class."""
    line = F.when(F.col("o_orderkey") % 10 == 3, F.lit("  Adds(x: 1.5)")).otherwise(F.concat(F.lit("  Ns.C.M"), F.col("o_orderkey"), F.lit("(1.5)")))
    heading = F.when(F.col("o_custkey") % 3 == 0, F.lit("noise\nthe FOLLOWING tests are available:\n")).otherwise(F.lit("noise\n"))
    raw = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\r\n").alias("t")).select(F.col("o_custkey").cast("string").alias("id"), F.concat(heading, "t").alias("text"))
    return records.has_bare_names(raw)


@query("""select p_partkey, p_type || '.B' || p_size as listed, case p_partkey % 3 when 0 then 'Ns.Fix(1.5).In' when 1 then 'a).' || p_type when 2 then 'plain(' || p_type || '.x' end as ran, p_type || '.B' || p_size || '.Run' as plain, p_type || '.C' as method, sha1(lower(p_name))[1:12] as cache_key,
    (p_size * 60000)::double as ms, p_type || '.Inner' as flat, p_name as decoded, 'List' as short, p_type || '.Outer' as top from part""")
def scalar_names(t: Tables) -> DataFrame:
    """Classes of names, entities, durations and keys."""
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    listed = F.concat(kind, F.lit(".B"), size, F.lit(".Run(x: 1.5, y: (2))"))
    ran = F.when(F.col("p_partkey") % 3 == 0, F.lit("Ns.Fix(1.5).In.Run(a.b)")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a)."), kind, F.lit(".M"))).otherwise(F.concat(F.lit("plain("), kind, F.lit(".x")))
    encoded = names.encode_entities(F.concat(F.lit("<&"), "p_name", F.lit("'\">")))
    return t.part.select(
        "p_partkey", names.class_of_listed(listed).alias("listed"), names.class_of_run(ran).alias("ran"), names.strip_args(listed).alias("plain"), names.class_of_method(F.concat(kind, F.lit(".C.Run"))).alias("method"), names.cache_key(F.col("p_name")).alias("cache_key"),
        names.duration_ms(F.concat(F.lit("00:"), size, F.lit(":00.000"))).alias("ms"), names.strip_nesting(F.concat(kind, F.lit(".Outer+Inner"))).alias("flat"), F.regexp_replace(names.decode_entities(encoded), "[<&'\">]", "").alias("decoded"),
        names.short_name(F.concat(kind, F.lit(".Outer+List`1"))).alias("short"), names.top_level(F.concat(kind, F.lit(".Outer+List`1"))).alias("top"),
    )


@query("""with recursive h(k, s, i, v) as (select n_nationkey, n_name, 0, 0::bigint from nation union all select k, s, i + 1, ((v * 31 + ascii(substr(s, i + 1, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 from h where i < length(s)) select k as n_nationkey, v as hash from h where i = length(s)""")
def polynomial_hashes(t: Tables) -> DataFrame:
    """F11."""
    return t.nation.select("n_nationkey", names.polynomial_hash(F.col("n_name")).alias("hash"))


_PATHS = """select page_id, ['src', 'Bin', 'obj', 'a\\Node_Modules', '.git', 'x/.vs', 'Packages', 'binary'][page_id % 8 + 1] || '/p' || page_id || '.' || ['cs', 'CSPROJ', 'props', 'targets', 'config', 'resx', 'json', 'xml', 'razor', 'cshtml', 'sln', 'xaml', 'md'][page_id % 13 + 1] as path from pages"""


@query(f"""with p as ({_PATHS}) select page_id, lower(replace(path, '\\', '/')) as file_key, regexp_matches(path, '(?i)\\.(cs|csproj|props|targets|config|resx|json|xml|razor|cshtml)$') as falls_back,
    regexp_matches(path, '(?i)\\.(cs|razor|cshtml)$') and not regexp_matches(path, '(?i)(^|[/\\\\])(bin|obj|\\.git|node_modules)[/\\\\]') as watched, regexp_matches(path, '(?i)(^|[/\\\\])(bin|obj|node_modules|\\.git|\\.vs|packages)[/\\\\]') as skipped, not regexp_matches(path, '(?i)^(bin|obj)/') as inside from p""")
def path_predicates(t: Tables) -> DataFrame:
    """Keys and predicates of paths."""
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("page_id") % n).cast("int"))
    path = F.concat(pick(["src", "Bin", "obj", "a\\Node_Modules", ".git", "x/.vs", "Packages", "binary"], 8), F.lit("/p"), F.col("page_id"), F.lit("."), pick(["cs", "CSPROJ", "props", "targets", "config", "resx", "json", "xml", "razor", "cshtml", "sln", "xaml", "md"], 13))
    own = t.pages.select("page_id", path.alias("path"))
    path = F.col("path")
    return own.select("page_id", paths.file_key(path).alias("file_key"), paths.fallback_eligible(path).alias("falls_back"), paths.watchable(path).alias("watched"), paths.overlay_skipped(path).alias("skipped"), paths.in_repo_tree(path).alias("inside"))


@query("select project, string_agg(distinct 'Ns.C' || o_orderkey % 9, ',' order by 'Ns.C' || o_orderkey % 9) as classes from (select 'N' || o_custkey % 25 as project, o_orderkey from orders) group by project")
def discovered_classes(t: Tables) -> DataFrame:
    """Methods as sorted classes of a project."""
    rows = t.orders.select(F.concat(F.lit("N"), F.col("o_custkey") % 25).alias("project"), F.concat(F.lit("Ns.C"), F.col("o_orderkey") % 9, F.lit(".M"), F.col("o_orderkey"), F.lit("(1.5)")).alias("method"))
    return results.classes_by_project(rows).select("project", F.array_join("classes", ",").alias("classes"))


@query("select run, n from (select conv_id as run, bool_or(role <> 'user') as done, count(*) filter (role = 'user') as n from conversations group by conv_id) where done")
def finished_runs(t: Tables) -> DataFrame:
    """Runs whose end has come."""
    return batching.finished_runs(t.conversations.select(F.col("conv_id").alias("run"), F.when(F.col("role") == "user", F.array("text")).alias("changes")))


@query("select user_id as project, max(event_id)::varchar as item from (select user_id, arg_max(event_type, event_id) as last, max(event_id) as event_id from events group by user_id) where last <> 'signup' group by user_id")
def latest_diagnostics(t: Tables) -> DataFrame:
    """K4: each project's last set of items."""
    rows = t.events.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "clear").otherwise("set").alias("kind"), F.array(F.col("event_id").cast("string")).alias("items"))
    return batching.latest_diagnostics(rows)


_KNOWN = """with recursive m as (select 'C.' || c_custkey as class_fqn, 'N' || c_nationkey as project, c_nationkey as k, c_acctbal < 3000 as static from customer),
    mf as (select 'C.' || o_custkey as class_fqn, 'src/p' || l_partkey as file from orders join lineitem on o_orderkey = l_orderkey),
    ch as (select 'src/p' || p_partkey as file, null::bigint as k, null::bigint as s from part where p_brand = 'Brand#4' union all select 'n' || s_nationkey || '/x' || s_suppkey || '.cs', s_nationkey, s_suppkey from supplier where s_acctbal < -800),
    bind as (select s_nationkey as k, 'n' || s_nationkey || '/x' || s_suppkey || '.cs' as file, s_suppkey % 2 = 0 as parsed from supplier where s_acctbal < -900),
    learnt as (select m.class_fqn, bind.file, bind.parsed from bind join ch using (file) join m on m.k = bind.k and m.static),
    covered as (select file from learnt group by file having bool_or(parsed)),
    own as (select distinct k from ch where k is not null and file not in (select file from covered)),
    e as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey),
    up(k) as (select k from own union select e.src from up join e on e.dst = up.k),
    fall as (select n_nationkey as k from nation where n_nationkey in (select k from up) and n_regionkey % 2 = 0),
    cls as (select class_fqn from mf join ch using (file) union select class_fqn from learnt)"""


@query(f"""{_KNOWN} select 'class' as kind, class_fqn as name from cls join m using (class_fqn) where k not in (select k from fall) union all select 'project', 'N' || k from fall union all select 'file', file from ch union all select 'file', 'stray.json'""")
def affected_selection(t: Tables) -> DataFrame:
    """The whole selection, with learnt edges, fallback projects and changes."""
    key = F.col("s_nationkey").cast("string")
    file = F.concat(F.lit("n"), key, F.lit("/x"), F.col("s_suppkey"), F.lit(".cs"))
    low = t.supplier.where("s_acctbal < -800")
    changed = _changed(t).union(low.select(file)).union(low.select(F.concat(F.lit("n"), key, F.lit("\\bin\\x.cs")))).union(t.region.limit(1).select(F.lit("./stray.json")))
    rows = _class_map(t).drop("project").join(t.customer.select(F.concat(F.lit("C."), F.col("c_custkey")).alias("class_fqn"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("project"), F.when(F.col("c_acctbal") < 3000, "static").otherwise("coverage").alias("source"), F.array(F.concat(F.lit("A"), F.col("c_nationkey"))).alias("abstract_files")), "class_fqn", "right").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    bindings = t.supplier.where("s_acctbal < -900").select(F.concat(F.lit("a"), key).alias("from_key"), file.alias("to"), F.when(F.col("s_suppkey") % 2 == 0, "parsed").otherwise("mined").alias("source"), F.lit(1).alias("confirms"))
    projects_ = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("project"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dir"), (F.col("n_regionkey") % 2 == 0).alias("is_test"))
    a, b = t.nation.select(F.col("n_nationkey").alias("x"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("y"), "n_regionkey")
    refs = a.join(b, "n_regionkey").where("y > x").select(F.concat(F.lit("N"), "x").alias("src"), F.concat(F.lit("N"), "y").alias("dst"))
    found = selection.affected(changed, stored(rows, "class-map"), bindings, projects_, refs)  # the map is a kept table
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return row(found.classes, "class", "class_fqn").union(row(found.fallback_projects, "project", "project")).union(row(found.changed, "file", "file"))


@query("""with r as (select c_custkey as repo, case when c_custkey % 2 = 0 then 'origin/u' || c_nationkey end as up, case when c_custkey % 3 = 0 then case when c_custkey % 9 = 0 then 'origin/HEAD' else 'origin/h' || c_nationkey end end as head, case when c_custkey % 5 = 0 then 'origin/main' end as main, case when c_custkey % 7 = 0 then 'origin/master' end as master from customer)
    select repo, coalesce(up, case when head <> 'origin/HEAD' then head end, main, master) as base from r where coalesce(up, case when head <> 'origin/HEAD' then head end, main, master) is not null""")
def base_refs(t: Tables) -> DataFrame:
    """What a branch is compared with."""
    k = F.col("c_custkey")
    row = lambda n, name, target: t.customer.where(k % n == 0).select(k.alias("repo"), F.lit(name).alias("name"), target.alias("target"))
    head = F.when(k % 9 == 0, F.lit("origin/HEAD")).otherwise(F.concat(F.lit("origin/h"), F.col("c_nationkey")))
    refs = row(2, "@{upstream}", F.concat(F.lit("origin/u"), F.col("c_nationkey"), F.lit("\n"))).union(row(3, "origin/HEAD", head)).union(row(5, "origin/main", F.lit("c0ffee"))).union(row(7, "origin/master", F.lit("c0ffee"))).union(row(1, "origin/other", F.lit("c0ffee")))
    return selection.base_ref(refs)


@query("""with live as (select 'N' || c_nationkey as project, 'C' || c_custkey as class_fqn from customer where c_acctbal > 5000 union select 'N' || s_nationkey, 'C' || s_suppkey from supplier where s_nationkey % 5 <> 0),
    old as (select 'N' || c_nationkey as project, 'C' || c_custkey as class_fqn from customer) select project, class_fqn from old where case when project in (select project from live) then class_fqn in (select class_fqn from live) else substr(project, 2)::int < 20 end""")
def alive_rows(t: Tables) -> DataFrame:
    """A discovery that found nothing prunes nothing."""
    name = lambda n, c: (F.concat(F.lit("N"), F.col(n)).alias("project"), F.concat(F.lit("C"), F.col(c)))
    project, cls = name("s_nationkey", "s_suppkey")
    found = t.supplier.groupBy(project).agg(F.collect_set(F.when(F.col("s_nationkey") % 5 != 0, cls)).alias("classes"))
    project, cls = name("c_nationkey", "c_custkey")
    live = selection.alive(t.customer.where("c_acctbal > 5000").select(project, cls.alias("class_fqn")), found)
    rows = t.customer.select(project, cls.alias("class_fqn"))
    return selection.pruned(rows, live.select("class_fqn"), t.nation.where("n_nationkey < 20").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("project")), live.select("project"))


@query("select l_orderkey::varchar as id, unnest(['total', 'failed', 'succeeded', 'skipped']) as counter, unnest([count(*), count(*) filter (l_returnflag = 'R'), 0, case when l_orderkey % 2 = 0 then l_orderkey % 5 else 0 end])::bigint as n from lineitem group by l_orderkey having l_orderkey % 4 > 0")
def run_counters(t: Tables) -> DataFrame:
    """Counters of a console run; without a total there are none, and one that is missing is 0."""
    key = F.col("l_orderkey")
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    total = F.when(key % 4 > 0, F.concat(F.lit("  total: "), "n", F.lit("  \n"))).otherwise(F.lit("in total: 7\n"))
    skipped = F.when(key % 2 == 0, F.concat(F.lit("  skipped: "), key % 5, F.lit("\nskipped: 99\n"))).otherwise(F.lit("Skipped: 4\nskipped: 3 of 4\n"))
    raw = n.select(key.cast("string").alias("id"), F.concat(F.lit("Test run summary:\n"), total, F.lit("  failed: "), "bad", F.lit("\n"), skipped).alias("text"))
    return records.run_output(raw)[1]


from . import workspace  # noqa: E402, F401  adds its queries
