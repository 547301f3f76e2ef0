"""A corpus, cleaned in five stages; each works on all that the one before kept."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm.common import row_key, stored, unused
from ripplescope.llm.leaks import leaks
from ripplescope.llm.pieces import encode
from ripplescope.llm.secrets import redact, secret_scan
from ripplescope.llm.shingles import jaccard_join
from ripplescope.llm.toxicity import fit, score

#: SQL can't express a trained score, so every stage is tested against a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay.

    Null and empty texts score 0 and stay; repeated rows go or stay together; an empty
    table gives none. Other columns stay as they are.
    """
    model, name = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), unused(docs, "toxicity")
    return score(docs, model, name).where(F.col(name) < 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8, the smallest id stays, and a null id only where the group has no other.

    Null and empty texts, and those without words, stay, each row of them. Of rows
    with the smallest id, that with the smallest key of id and text stays, and of
    repeated rows any one. An empty table gives none.
    """
    rows, key = jaccard_join(docs, words=5, percent=80).where("n_shingles > 0"), unused(docs, "_k")
    one = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("one")).select(F.col("one.k").alias(key))
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = docs.where(worded).withColumn(key, row_key("doc_id", "text")).join(one, key).dropDuplicates([key])
    return kept.select(docs.columns).unionByName(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay.

    Null and empty texts hold none; repeated rows go or stay together; without items
    all stay, and an empty table gives none.
    """
    found, key = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), unused(docs, "_k")
    keys = stored(found.select(F.col("k").alias(key)).distinct(), "pipeline-leaks")
    return docs.withColumn(key, row_key("doc_id", "text")).join(keys, key, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked, and ``n_chars`` counted anew where that was done; all documents stay.

    Null and empty texts stay as they are, repeated rows are masked alike, and an
    empty table gives none.
    """
    key, live = unused(docs, "_k"), unused(docs, "_live")
    found = secret_scan(docs).where(F.size("live") > 0).select(F.col("k").alias(key), F.col("live").alias(live)).dropDuplicates([key])
    joined = docs.withColumn(key, row_key("doc_id", "text")).join(stored(found, "pipeline-secrets"), key, "left")
    made = unused(docs, "_text")
    joined = joined.withColumn(made, F.when(F.col(live).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(live))))
    size = F.when(F.col(live).isNull(), F.col("n_chars")).otherwise(F.length(made).cast("long")).alias("n_chars")
    return joined.select(*[F.col(made).alias("text") if c == "text" else size if c == "n_chars" else F.col(c) for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, in place of its text.

    Null and empty texts have no pieces; equal rows get equal pieces; an empty table
    gives none, and other columns aren't carried.
    """
    return encode(docs).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]


#: Rows of a batch that goes to a worker, in stages whose workers need much memory themselves; none of their rows depends on its batch.
BATCH_ROWS = {"pieces": 1000}


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Batches of at most so many rows for what is run meanwhile; an executor holds each task's in both of its processes, outside of the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    former = spark.conf.get(key, None)
    if rows is not None:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if former is None else spark.conf.set(key, former)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with batches_of(spark, BATCH_ROWS.get(name)):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
