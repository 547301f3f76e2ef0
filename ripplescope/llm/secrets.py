"""Secret scan: candidate spans, then how many owners share each value. Native."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, stored

# Fixed values: (kind, pattern, group of the value, least length of that group); the first three are the base.
KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 80),
]
BASE = 3
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, k: int) -> Column:
    """Matches of one kind with their places in code points.

    ``split`` gives what lies between the matches that ``regexp_extract_all`` gives,
    so running lengths give the places.
    """
    _, pattern, group, least = KINDS[k]
    rx = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0))
    values = F.regexp_extract_all(text, rx, F.lit(group)) if group else whole
    step = lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["whole"])).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), F.lit(k).alias("kind"), (a["at"] + F.length(x["gap"]) + F.length(x["whole"])).alias("end"), x["value"].alias("value"))))).otherwise(a["out"]).alias("out"))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))
    long_ones = F.exists(values, lambda v: F.length(v) >= least)
    return F.when(long_ones, F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def _prefiltered(text: Column, k: int) -> Column:
    """A cheap test that a text may hold a match that is long enough."""
    quick = {0: r"[dDtTnNyY][\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", 1: r"AKIA[A-Z0-9]{16}", 2: r"[0-9a-f]{24}", 3: "gh[pousr]_", 4: "xox[abprs]-", 5: r"eyJ", 6: "-----BEGIN "}[k]
    return F.when(F.rlike(text, F.lit(quick)), _spans(text, k)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``spans``: all candidates by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.array_sort(F.concat(*[_prefiltered(text, k) for k in range(len(KINDS))])).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``(vhash, owners, repos)`` for each value in ``found(vhash, owner, repo)``.

    Owners and repositories are made distinct before they are counted, so a value
    that a third of all rows hold shrinks to a row per task and owner at once.
    """
    once = found.groupBy("vhash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = once.groupBy("vhash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("vhash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secret_scan(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), copied_from: int = 3, copies_from: int = 6) -> DataFrame:
    """One row per row of ``docs(doc_id, text, owner, repo...)`` with its secrets.

    Candidates are the matches of ``KINDS``. Values are hashed and counted by
    distinct owners and distinct repositories over the whole corpus. A value is a
    widely copied example that at least ``copied_from`` owners hold, or two owners in
    at least ``copies_from`` repositories together; any other looks live, however
    short or plain, and in however many repositories of one owner. The columns
    ``repo`` together name a repository. Base spans stay whatever the count;
    spans of the other kinds are given where they look live.

    Returns ``doc_id, k, n_assign, n_access, n_hex, spans, live``, ``k`` a key of the
    row's id and text, with ``spans`` and
    ``live`` arrays of ``(start, kind, end, value)``. Null and empty texts give
    empty arrays; null owners count as one owner, nulls in a repository's columns
    as one value; repeated rows give repeated
    results; an empty table gives none; columns other than those named are not
    carried. Only candidates are shuffled, never texts.
    """
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.col(owner).alias("_owner"), F.xxhash64(F.lit(0), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repo]).alias("_repo"), "text")
    found = stored(candidates(keyed, ["doc_id", "k", "_owner", "_repo"]).withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    each = found.where(F.size("spans") > 0).select("_row", "_owner", "_repo", F.explode("spans").alias("s"))
    each = each.select("_row", "_owner", "_repo", "s", F.sha2(F.col("s.value"), 256).alias("vhash"))
    counts = ownership(each.select("vhash", F.col("_owner").alias("owner"), F.col("_repo").alias("repo")))
    judged = each.join(counts, "vhash").select("_row", "s", ((F.col("owners") < copied_from) & ((F.col("owners") < 2) | (F.col("repos") < copies_from))).alias("live"))
    live = judged.where("live").groupBy("_row").agg(F.collect_list("s").alias("live"))
    some = found.where(F.size("spans") > 0).join(live, "_row", "left")
    none = found.where(F.size("spans") == 0).withColumn("live", F.lit(None).cast(SPAN))
    live = F.array_sort(F.coalesce("live", F.array().cast(SPAN)))
    out = some.unionByName(none).withColumn("live", live)
    kept = F.filter("spans", lambda s: (s["kind"] < BASE) | F.array_contains("live", s))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", "k", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), kept.alias("spans"), "live")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each of the sorted ``spans`` replaced; overlapping ones make one gap."""
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = secret_scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))
