"""Centroid clustering of integer vectors: the nearest centroid by partial distances, all sums exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tidy

#: Centroids, rounds, components of a vector, and what a component is multiplied by before it is floored.
CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Components that are added up before centroids are given up for the first time, and between later times.
STEP = 8
#: Components beyond this would take squared distances out of 64 bits.
MOST = 2**27
#: Vectors that are compared at a time.
BLOCK = 4096


def usable(embedding: Column, size: int = SIZE) -> Column:
    """Whether a vector has ``size`` components, none null or not finite."""
    numbers = embedding.cast("array<double>")
    return F.coalesce((F.size(numbers) == size) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(found) and np.abs(found).max() > MOST:
        raise OverflowError(f"components beyond {MOST / scale:g} have no exact squared distance in 64 bits")
    return found.astype(np.int64).reshape(-1, size)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of ``x`` and its squared distance; of equal ones the smaller number.

    Differences are added up over the components in ``order``. After the first
    ``step`` of them the centroid that looks nearest is finished, and bounds the
    rest: a centroid whose partial sum is strictly above the best distance so far is
    given up, the others finish all components.
    """
    x, c = x[:, order], centroids[:, order]
    rows, size = np.arange(len(x)), x.shape[1]
    first = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    label = first.argmin(1)
    best = first[rows, label] + ((x[:, step:] - c[label, step:]) ** 2).sum(1)
    guess = label.copy()
    for j in range(len(c)):
        on = np.flatnonzero((guess != j) & (first[:, j] <= best))
        partial = first[on, j]
        for lo in range(step, size, step):
            partial = partial + ((x[on, lo : lo + step] - c[j, lo : lo + step]) ** 2).sum(1)
            alive = partial <= best[on]
            on, partial = on[alive], partial[alive]
        better = (partial < best[on]) | (j < label[on])
        on, partial = on[better], partial[better]
        label[on], best[on] = j, partial
    return label, best


def _moments(size: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(size), np.zeros(size)
        for batch in batches:
            x = _integers(batch.column(0), size, scale).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(0), two + (x**2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(one), pa.array(two)], names=["d", "n", "one", "two"])

    return tidy(run)


def _sums(size: int, scale: int, centroids: np.ndarray, order: np.ndarray):
    """Of a task's vectors: how many each centroid gets, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _integers(batch.column(0), size, scale)
            for lo in range(0, len(x), BLOCK):
                label, _ = nearest(x[lo : lo + BLOCK], centroids, order)
                count += np.bincount(label, minlength=len(centroids))
                for j in np.unique(label):
                    total[j] += x[lo : lo + BLOCK][label == j].sum(0)
        k = np.repeat(np.arange(len(centroids), dtype=np.int32), size)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.tile(np.arange(size, dtype=np.int32), len(centroids))), pa.array(np.repeat(count, size)), pa.array(total.ravel())], names=["k", "d", "n", "total"])

    return tidy(run)


def _labels(size: int, scale: int, centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(1), size, scale)
            found = [nearest(x[lo : lo + BLOCK], centroids, order) for lo in range(0, len(x), BLOCK)]
            if found:
                label, distance = (np.concatenate(f) for f in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return tidy(run)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, cluster, distance)`` of the vectors that are kept, and ``(cluster, centroid, n, inertia)`` of the final centroids.

    ``vectors(vec_id, embedding)``; vectors with another number of components, or
    with one that is null or not finite, are left out. Components are floored
    integers; a centroid starts as a kept vector (by the smallest hashes of seed and
    id, a null id as an empty one; of rows with the same id the smaller vector first),
    and becomes the floored mean of its vectors each round. Everything is exact, so
    the result doesn't depend on how rows are dealt. Ties go to the smaller centroid.

    With fewer vectors than ``clusters`` there are as many centroids as vectors;
    without any, both tables are empty. Repeated rows count each; other columns aren't
    carried. A component whose integer is beyond ``MOST`` is an overflow error, as
    no long holds its squared distances.

    A round reads the vectors once; a task gives one sum for each centroid and
    component, however many vectors it has, so nothing depends on the size of a
    cluster, and only these ``clusters * size`` sums come to the driver.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"), size)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), F.transform("e", lambda x: F.floor(x * scale)).alias("x")).orderBy("h", "x").limit(clusters).collect()
    shape = "cluster int, centroid array<long>, n long, inertia long"
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], shape)
    now = np.array([r["x"] for r in first], dtype=np.int64)
    told = kept.select("e").mapInArrow(_moments(size, scale), "d int, n long, one double, two double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    variance = {r["d"]: r["two"] / r["n"] - (r["one"] / r["n"]) ** 2 for r in told}
    order = np.array(sorted(range(size), key=lambda d: (-variance[d], d)))  # only speed depends on it
    for _ in range(rounds):
        sums = kept.select("e").mapInArrow(_sums(size, scale, now, order), "k int, d int, n long, total long").groupBy("k", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        following = now.copy()
        for r in sums.collect():
            following[r["k"], r["d"]] = r["total"] // r["n"]
        now = following
    rows = stored(kept.mapInArrow(_labels(size, scale, now, order), "vec_id long, cluster int, distance long"), "clustered")
    sizes = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}
    final = [(j, [int(v) for v in c], sizes[j]["n"] if j in sizes else 0, sizes[j]["inertia"] if j in sizes else 0) for j, c in enumerate(now)]
    return rows, spark.createDataFrame(final, shape)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, final = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    total = final.agg(F.sum("inertia")).head()[0]
    said = final.select("cluster", F.col("inertia").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), F.sha2(text, 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
