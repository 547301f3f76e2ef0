"""Nearest vectors by multi-index hashing: learned rotated codes, an index over each part of a code, floats last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tidy

#: Bits of a code, and of each part that has an index of its own.
BITS, PART = 256, 16
PARTS = BITS // PART
#: Distinct vectors of each length that the rotations and the radius are learnt from: those with the smallest hashes.
SAMPLE, FIT, STEPS, SEED = 16384, 4096, 20, 13
#: Chance that a code of one of the nearest lies within the radius that is searched.
CHANCE = 0.97
SAMPLE_BYTES = 32 << 20
#: Vectors of a shard, and queries of a chunk: what one task holds at a time, fewer of very long ones.
SHARD, GROUP_BYTES = 4096, 64 << 20
MOST_TASKS = 100_000
#: Pairs of codes, and of vectors, that are compared at a time.
PAIRS, GATHER = 1 << 19, 1 << 14
#: Values with at most so many bits set, by that number.
MASKS = [np.flatnonzero(np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)) <= s).astype(np.uint16) for s in range(PART + 1)]


def rotations(sample: np.ndarray, size: int) -> np.ndarray:
    """``BITS`` directions: rotations of the space that are turned until the signs of the sample's components lie close to the components themselves."""
    rng = np.random.default_rng([SEED, size])
    found: list[np.ndarray] = []
    while len(found) * size < BITS:
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for _ in range(STEPS if len(sample) else 0):
            u, _, v = np.linalg.svd(sample.T @ np.where(sample @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        found.append(turn)
    return np.concatenate(found, axis=1)[:, :BITS]


def coded(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each vector: the sides of all directions on which it lies."""
    return np.packbits(unit @ directions >= 0, axis=1).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first by a power of two, so that no square leaves the range of doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x**2).sum(1, keepdims=True))


class Model:
    """What is learnt from a bounded sample of the vectors of one length."""

    def __init__(self, sample: np.ndarray, nearest: int):
        self.sample, self.nearest = sample, nearest
        self.directions = rotations(sample[:FIT], sample.shape[1])
        self.code = coded(sample, self.directions)
        own = np.arange(min(FIT, len(sample)))
        cosine, at = self._near(sample[own], own)
        other = np.roll(own, 1)
        far = self._off((sample[own] * sample[other]).sum(1), apart(self.code[own], self.code[other]))[own != other]
        near = self._off(cosine, apart(self.code[own, None], self.code[np.maximum(at, 0)]))[at >= 0]
        self.reach = max((float(np.quantile(off, CHANCE)) for off in (near, far) if len(off)), default=0.0)

    @staticmethod
    def _expected(cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of bits in which two vectors of a cosine differ, and the deviation of their number."""
        share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return share, np.sqrt(BITS * share * (1 - share))

    def _off(self, cosine: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """By how many deviations codes are further apart than expected."""
        share, spread = self._expected(cosine)
        return (distance - BITS * share) / np.maximum(spread, 1)

    def _near(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best cosines with the sample, without ``own`` (a row of the sample, or -1), and their rows; -1 where there are no more."""
        cosine, at = np.full((len(unit), self.nearest), -1.0), np.full((len(unit), self.nearest), -1)
        for lo in range(0, len(unit), 256):
            c = unit[lo : lo + 256] @ self.sample.T
            mine = own[lo : lo + 256]
            c[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2
            best = np.argsort(-c, axis=1, kind="stable")[:, : self.nearest]
            value = np.take_along_axis(c, best, 1)
            cosine[lo : lo + 256, : best.shape[1]] = np.maximum(value, -1)
            at[lo : lo + 256, : best.shape[1]] = np.where(value > -2, best, -1)
        return cosine, at

    def radius(self, unit: np.ndarray) -> np.ndarray:
        """For each query a radius that holds the codes of its nearest with ``CHANCE``.

        The last of the nearest in the sample is no nearer than the last of the nearest
        in all vectors. The radius holds these of the sample in any case, so that as
        many are found as are asked for; with too few of them it is the whole code.
        """
        mine = np.full(len(unit), -1)
        for lo in range(0, len(unit), 256):
            same = (unit[lo : lo + 256] @ self.sample.T).argmax(1)
            equal = (self.sample[same] == unit[lo : lo + 256]).all(1)
            mine[lo : lo + 256] = np.where(equal, same, -1)
        cosine, at = self._near(unit, mine)
        share, spread = self._expected(cosine[:, -1])
        found = np.ceil(BITS * share + self.reach * np.maximum(spread, 1)).astype(np.int64)
        found = np.maximum(found, apart(coded(unit, self.directions)[:, None], self.code[np.maximum(at, 0)]).max(1))
        return np.where(at[:, -1] >= 0, np.clip(found, 0, BITS), BITS)


class Shard:
    """An index over each part of the codes of some vectors."""

    def __init__(self, code: np.ndarray):
        self.code, self.parts = code, code.view(np.uint16)
        self.order = np.argsort(self.parts, axis=0, kind="stable")

    def within(self, code: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vector) of all codes within each query's radius, each once.

        Codes that differ in at most ``radius`` bits differ in at most ``radius //
        PARTS`` bits of one of their parts, so only such values of each part are looked
        up. A pair belongs to the first part that tells it.
        """
        asked = code.view(np.uint16)
        spread = np.minimum(radius // PARTS, PART)
        for s in np.unique(spread):
            for i in range(PARTS):
                order = self.order[:, i]
                values, begin, many = np.unique(self.parts[order, i], return_index=True, return_counts=True)
                few = len(MASKS[s]) < len(values)
                place = np.full(1 << PART, -1)
                place[values] = np.arange(len(values))
                on = np.flatnonzero(spread == s)
                step = max(1, PAIRS // max(len(self.code), len(MASKS[s]) if few else len(values)))
                for lo in range(0, len(on), step):
                    q = on[lo : lo + step]
                    if few:
                        hit = place[asked[q, i][:, None] ^ MASKS[s][None, :]]
                        row, column = np.nonzero(hit >= 0)
                        bucket = hit[row, column]
                    else:
                        row, bucket = np.nonzero(np.bitwise_count(asked[q, i][:, None] ^ values[None, :]) <= s)
                    size = many[bucket]
                    a = np.repeat(q[row], size)
                    b = order[np.repeat(begin[bucket] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    near = apart(code[a], self.code[b]) <= radius[a]
                    a, b = a[near], b[near]
                    first = (np.bitwise_count(asked[a, :i] ^ self.parts[b, :i]) > s).all(1)
                    yield a[first], b[first]


def _floats(column, size: int) -> np.ndarray:
    packed = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(-1, size)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; a negative zero is a zero."""
    for batch in batches:
        e = batch.column(1)
        flat = e.flatten().to_numpy(zero_copy_only=False) + 0.0
        cuts = np.concatenate(([0], np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["vec_id", "v"])


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, scaled by a power of two so that no square leaves the range of doubles, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(1))


def _answers(rows: pa.Table, size: int, nearest: int) -> pa.RecordBatch:
    """The nearest vectors of one shard to each query of one chunk. Queries have no ids."""
    side = rows.column("ids").is_null().to_numpy(zero_copy_only=False)
    queries, vectors = rows.filter(pa.array(side)), rows.filter(pa.array(~side))
    words = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
    (q, q_length), (v, v_length) = (_lengths(_floats(t.column("v"), size)) for t in (queries, vectors))
    own, lists = queries.column("query_id").to_numpy(), vectors.column("ids").to_pylist()
    ids, cuts = np.array([i for x in lists for i in x], dtype=np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    at, told, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(q), -2.0)
    for a, b in Shard(words(vectors)).within(words(queries), queries.column("radius").to_numpy()):
        cosine = np.concatenate([np.zeros(0), *[(q[a[lo : lo + GATHER]] * v[b[lo : lo + GATHER]]).sum(1) for lo in range(0, len(a), GATHER)]]) / (q_length[a] * v_length[b])
        some = cosine >= least[a]
        a, b, cosine = a[some], b[some], cosine[some]
        many = cuts[b + 1] - cuts[b]
        a, cosine, place = np.repeat(a, many), np.repeat(cosine, many), np.repeat(cuts[b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        other = ids[place] != own[a]
        at, told, score = np.append(at, a[other]), np.append(told, ids[place][other]), np.append(score, cosine[other])
        order = np.lexsort((told, -score, at))
        at, told, score = at[order], told[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full = rank == nearest - 1
        least[at[full]] = score[full]
        at, told, score = at[rank < nearest], told[rank < nearest], score[rank < nearest]
    return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(queries.column("q").to_numpy()[at]), pa.array(told), pa.array(score)], names=["query_id", "q", "vec_id", "score"])


def _searched(size: int, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            if 0 < rows.column("ids").null_count < len(rows):
                yield _answers(rows, size, nearest)

        for batch in batches:  # sorted by group; a group can end in a later batch
            keys = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != keys[lo]:
                    yield from settle()
                    held.clear()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settle()

    return tidy(run)


def _search(vectors: DataFrame, queries: DataFrame, size: int, n: int, nearest: int) -> DataFrame:
    """``(query_id, q, vec_id, score)``: the nearest in each shard, for vectors of one length."""
    spark = vectors.sparkSession
    most = max(nearest + 1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    sample = _floats([r["v"] for r in vectors.orderBy("rep", "v").limit(most).select("v").collect()], size)
    model = spark.sparkContext.broadcast(Model(_unit(sample), nearest))
    each = max(1, min(SHARD, GROUP_BYTES // (8 * size)))
    shards, chunks = -(-n // each), -(-max(1, queries.count()) // each)

    def codes(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                unit = _unit(_floats(batch.column("v"), size))
                code = pa.array([row.tobytes() for row in coded(unit, model.value.directions)], pa.binary())
                radius = pa.array(model.value.radius(unit) if wanted else np.zeros(len(unit), np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, code, radius], names=[*batch.schema.names, "code", "radius"])

        return tidy(run)

    shape = "p long, query_id long, q long, v binary, ids array<long>, code binary, radius long"
    null = lambda kind: F.lit(None).cast(kind)
    left = vectors.select(F.pmod("rep", F.lit(shards)).alias("p"), null("long").alias("query_id"), null("long").alias("q"), "v", "ids").mapInArrow(codes(False), shape)
    left = left.withColumn("g", F.explode(F.sequence(F.col("p"), F.col("p") + shards * (chunks - 1), F.lit(shards).cast("long"))))
    right = queries.select(F.pmod("q", F.lit(chunks)).alias("p"), "query_id", "q", "v", null("array<long>").alias("ids")).mapInArrow(codes(True), shape)
    right = right.withColumn("g", F.explode(F.sequence(F.col("p") * shards, F.col("p") * shards + shards - 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).select("g", "query_id", "q", "v", "ids", "code", "radius")
    return both.repartition(max(parts, min(shards * chunks, MOST_TASKS)), "g").sortWithinPartitions("g").mapInArrow(_searched(size, nearest), "query_id long, q long, vec_id long, score double")


def nearest_vectors(vectors: DataFrame, every: int = 50, nearest: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``, the ``nearest`` others found by cosine.

    Codes of ``BITS`` bits are signs along learnt rotations. A query's radius comes
    from its nearest vectors in a bounded sample: however many vectors there are, a
    code of one of its nearest lies within it with a chance of about ``CHANCE``. All
    codes within the radius are looked up by the parts of the query's code, and every
    vector found is compared in doubles. Nothing caps candidates.

    Equal vectors are indexed once, with their smallest ids. Vectors are dealt into
    shards and queries into chunks, by hashes and of about ``SHARD`` each, so no group
    grows with the data; a shard gives a chunk ``nearest`` rows for each query.

    Vectors that are null, empty or zero, hold a null or a component that is not
    finite, or have no id, take no part; vectors of different lengths aren't
    compared. Fewer candidates give fewer rows, a query without any gives none; ties
    go to the smaller id. A row with the query's own id is never its answer; an id
    that stands with several vectors asks with each, and each can be found; rows that
    are repeated count once. An empty table gives none; other columns aren't carried.
    """
    spark = vectors.sparkSession
    numbers = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("e")).mapInArrow(_packed, "vec_id long, v binary")
    size = (F.octet_length("v") / 8).cast("int").alias("size")
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= nearest + 1)
    same = few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    same = stored(same.select(F.xxhash64("v").alias("rep"), "v", "ids", size), "ann-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = stored(asked.select("query_id", F.xxhash64("query_id", "v").alias("q"), "v", size), "ann-queries")
    found = None
    for r in same.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect():
        one = F.col("size") == r["size"]
        each = _search(same.where(one), asked.where(one), r["size"], r["n"], nearest)
        found = each if found is None else found.unionByName(each)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
