"""Near-duplicate embeddings: p-stable hashing, then exact cosines in each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored

#: Tables, projections of each, and their width for vectors of length one. At a cosine of 0.9, the
#: distance is 0.447, one projection agrees with a chance of 0.82, and one of the tables with 0.98.
TABLES, PROJECTIONS, WIDTH, SEED = 24, 10, 2.0, 11
COSINE = 0.9
#: Buckets beyond so many vectors are compared in blocks of that size.
CHUNK = 768


def _hashes(unit: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    lines = rng.normal(size=(unit.shape[1], TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    h = np.zeros(cells.shape[:2], dtype=np.uint64)
    for k in range(PROJECTIONS):
        h = (h ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of doubles of length one, from a column of packed floats."""
    raw = np.stack([np.frombuffer(v, dtype=np.float64) for v in column.to_pylist()])
    return raw / np.sqrt((raw**2).sum(1, keepdims=True))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.array([len(v) for v in batch.column(1).to_pylist()])
        for d in np.unique(size):  # vectors of another length are in other buckets
            some = np.flatnonzero(size == d)
            h = _hashes(_unit(batch.column(1).take(pa.array(some))))
            ids = np.repeat(batch.column(0).to_numpy()[some], TABLES)
            table = np.tile(np.arange(TABLES, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(table), pa.array(h.ravel() ^ np.int64(d))], names=["rep", "t", "h"])


def _pairs(unit: np.ndarray, part: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs that no earlier table has together; of two blocks, those across."""
    found = []
    two = part.max() > part.min()
    rows = np.flatnonzero(part == part.min()) if two else np.arange(len(unit))
    cols = np.flatnonzero(part == part.max()) if two else rows
    close = unit[rows] @ unit[cols].T >= least
    if not two:
        close = np.triu(close, 1)
    a, b = np.nonzero(close)
    a, b = rows[a], cols[b]
    if not len(a):
        return a, b
    some = np.unique(np.append(a, b))
    hashes = np.zeros((len(unit), TABLES), dtype=np.int64)
    hashes[some] = _hashes(unit[some])
    for lo in range(0, len(a), 100_000):
        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
        new = ~(hashes[x, :table] == hashes[y, :table]).any(1)
        found.append((x[new], y[new]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each position reaches."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            groups = rows.column("g").to_numpy()
            cuts = np.flatnonzero(np.diff(groups)) + 1
            unit_all = None
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(groups)), strict=True):
                if hi - lo < 2:
                    continue
                own = rows.slice(lo, hi - lo)
                unit_all = _unit(own.column("v").combine_chunks())
                a, b = _pairs(unit_all, own.column("c").to_numpy(), int(own.column("t")[0].as_py()), least)
                if not len(a):
                    continue
                reps, many = own.column("rep").to_numpy(), own.column("many").to_numpy().astype(float)
                links = np.bincount(a, many[b], len(reps)) + np.bincount(b, many[a], len(reps))
                root, on = _roots(len(reps), a, b), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(reps[on]), pa.array(links[on].astype(np.int64)), pa.array(reps[root[on]])], names=["rep", "links", "root"])

        for batch in batches:  # sorted by group; a group can end in a later batch
            groups = batch.column(0).to_numpy()
            if not len(groups):
                continue
            last = int(np.searchsorted(groups, groups[-1], "left")) if (np.diff(groups) >= 0).all() else int(np.flatnonzero(groups != groups[-1]).max(initial=-1)) + 1
            if last or (held and held[-1].column(0)[-1].as_py() != groups[0]):
                held.append(batch.slice(0, last))
                yield from settle(pa.Table.from_batches([h for h in held if len(h)] or [batch.slice(0, 0)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Equal vectors are one vector that counts as many. Distinct ones meet where one
    of ``TABLES`` tables of quantised random projections puts them together; each
    pair is judged once, in the first such table, by its exact cosine in doubles.
    Buckets beyond ``CHUNK`` vectors are compared block by block, so none comes to
    one task, and a bucket gives a link count and a root for each of its vectors,
    never its pairs.

    Vectors that are null, empty or zero, hold a null or a component that is not
    finite, or have no id, link with nothing; without an id their component is
    null. Vectors of different lengths don't link. Repeated rows count as other
    vectors; an empty table gives none; other columns are not carried.
    """
    spark = vectors.sparkSession
    numbers = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, numbers).alias("e"))
    same = stored(rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "distinct-vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(1)
            flat, cuts = e.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))))
            top = [np.abs(flat[a:b]).max() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # keeps squares in range
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(flat[a:b] / m).tobytes() for a, b, m in zip(cuts[:-1], cuts[1:], top, strict=True)], pa.binary()), batch.column(2)], names=["rep", "v", "many"])

    packed_rows = same.select("rep", "e", "many").mapInArrow(packed, "rep long, v binary, many long")
    cells = stored(packed_rows.select("rep", "v").mapInArrow(_buckets, "rep long, t int, h long"), "vector-buckets")
    sizes = cells.groupBy("t", "h").agg(F.count("*").alias("m")).where("m > 1")
    met = cells.join(sizes, ["t", "h"]).withColumn("n", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    met = met.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("rep", "t", "c", F.xxhash64("t", "h", F.least("c", "d"), F.greatest("c", "d")).alias("g"))
    full = met.join(packed_rows, "rep").select("g", "rep", "v", "many", "t", "c")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(full.repartition(4 * parts, "g").sortWithinPartitions("g").mapInArrow(_compare(least), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components").withColumnRenamed("node", "rep")
    judged = same.join(links, "rep", "left").join(groups, "rep", "left").select("e", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("e is not null").join(judged, "e").select("vec_id", "n_links", "component_id")
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
