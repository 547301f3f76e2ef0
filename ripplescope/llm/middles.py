"""Fill-in-middle: texts cut in three by a keyed hash and rearranged, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a cut can't divide: a run of letters, or one other character.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: The marks of prefix, suffix and middle; a text that holds one stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts so many are rearranged, and of 100 of these so many with the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits each, from the hash of seed and id; a null id counts as an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(docs: DataFrame, seed: int = SEED, cut_share: int = CUT_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, text, n, form, prefix, middle, suffix, output``.

    The text is cut into ``n`` units and, between units, into prefix, middle and
    suffix. ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix,
    middle, each behind its mark) or ``spm`` (suffix first); the parts are null if
    plain. The draws depend on seed and id alone, so that rows with the same id are
    cut by the same draws, wherever and how often they run.

    A null text counts as empty; an empty one, or one that holds a mark, stays plain.
    Repeated rows give equal rows; an empty table gives none; other columns aren't
    carried. A row is worked on by itself: nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    places = F.size("units").cast("long") + 1
    rows = rows.select("doc_id", "text", "units", F.size("units").cast("long").alias("n"), (F.col("h1") % places).alias("c1"), (F.col("h2") % places).alias("c2"), "h3", "h4")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= cut_share), "plain").when(F.col("h4") % 100 < suffix_first_share, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", "n", form.alias("form"), F.least("c1", "c2").cast("int").alias("a"), F.greatest("c1", "c2").cast("int").alias("b"))
    part = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b).alias("middle"), part(b, F.col("n").cast("int")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.select("*", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an arrangement was made of, by its marks: each stands once, as no part holds one and none can form across a border."""
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    last = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), last, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), last, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arranged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
