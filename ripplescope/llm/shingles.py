"""N-gram Jaccard join by a token-group matrix.

Distinct shingle sets are partitioned into groups of similar ones: a set joins the
group of the most central set with which it shares an indexed token. The matrix
tells which groups hold which indexed token, so that only pairs of groups that can
hold a link are looked at; in those, a set whose overlap with the other group's
token union is too small is not compared, and only what is left is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, row_key, stored, tidy
from .vectors import _roots

#: Counters that say roughly how common a token is: 2**21, sent as blocks.
SKETCH_LOG2, SKETCH_BLOCKS = 21, 32
#: A group holds about so many tokens at most, all members together.
GROUP_TOKENS = 1 << 16
#: So many sets are compared with as many others at a time.
SIDE = 1024
_PRIME, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` words.

    A-Z are lower-cased, and words end at ASCII white space. A text with fewer words
    is one shingle; one without words has none.
    """
    import xxhash

    table: dict[bytes, int] = {}
    number = lambda w: table.setdefault(w, len(table))
    lists = [np.fromiter(map(number, (t or b"").lower().split()), np.int64) for t in texts]
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in table), np.uint64, len(table))
    out = []
    for ids in lists:
        w, size = word[ids], min(words, len(ids))
        if not size:
            out.append(w)
            continue
        n = len(w) - size + 1
        h = np.full(n, size, dtype=np.uint64) * _PRIME
        for k in range(size):
            h = _mix(h * _STEP + w[k : k + n])
        out.append(np.unique(h))
    return out


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)


def _profile(words: int):
    """A row for each text, and at a task's end its counters by block."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << SKETCH_LOG2, dtype=np.int64), False
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lo in range(0, len(texts), 1000):
                sets = shingle_sets(texts[lo : lo + 1000].to_pylist(), words)
                n = len(sets)
                if n:
                    counts += np.bincount(_slot(np.concatenate(sets)), minlength=len(counts))
                    some = True
                sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sid), sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "k", "sid", "n", "block", "counts"])
        if some:
            for i, part in enumerate(np.array_split(np.minimum(counts, 65535).astype(np.uint16), SKETCH_BLOCKS)):
                if part.any():
                    null = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["doc_id", "k", "sid", "n", "block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds counters block by block as they come in; memory for the blocks only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, dtype=np.uint16).astype(np.int64)
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])


def _levels(sketch: DataFrame) -> np.ndarray:
    """The counters, 2**21 numbers whatever the input, as levels of 16 bits."""
    rows = sketch.repartition(SKETCH_BLOCKS, "block").mapInArrow(_summed, "block int, counts binary").collect()
    parts = [np.zeros(len(p), dtype=np.int64) for p in np.array_split(np.arange(1 << SKETCH_LOG2), SKETCH_BLOCKS)]
    for r in rows:
        parts[r["block"]] += np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    whole = np.concatenate(parts)
    return np.minimum(whole, 60000 + np.log2(np.maximum(whole, 1)).astype(np.int64)).astype(np.uint16)


def _need(n):
    """Linked sets share at least so many indexed tokens, by the size of the smaller one."""
    return max(1, min(8, n // 4), n // 32)


def _index(levels, words: int, percent: int):
    """The rarest tokens of each set, as many as any linked set must share ``_need`` of."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, told = levels.value, set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for lo in range(0, len(texts), 1000):
                token, sid, size, central = [], [], [], []
                for s in shingle_sets(texts[lo : lo + 1000].to_pylist(), words):
                    if not len(s):
                        continue
                    own = xxhash.xxh3_64_intdigest(s.tobytes())
                    if own in told:  # a copy in the same task
                        continue
                    if len(told) < 1_000_000:
                        told.add(own)
                    level = level_of[_slot(s)]
                    first = s[np.argsort(level, kind="stable")[: len(s) - -(-percent * len(s) // 100) + _need(len(s))]]
                    token.append(first)
                    for out, value in ((sid, own), (size, len(s)), (central, np.log2(level + 1.0).mean())):
                        out.append((value, len(first)))
                if token:
                    spread = lambda x, t: np.repeat(np.array([v for v, _ in x], dtype=t), [c for _, c in x])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(spread(sid, np.uint64).view(np.int64)), pa.array(spread(size, np.int32)), pa.array(spread(central, np.float32))], names=["tok", "sid", "n", "central"])

    return run


def _members(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lo in range(0, len(texts), 1000):
                sets = shingle_sets(texts[lo : lo + 1000].to_pylist(), words)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([s.tobytes() for s in sets], pa.binary())], names=["g", "sid", "tokens"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group, from rows sorted by group."""
    now, sids, sets = None, [], []

    def row() -> pa.RecordBatch:
        sizes = np.array([len(s) // 8 for s in sets], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.array(sids, dtype=np.int64).tobytes()]), pa.array([sizes.tobytes()]), pa.array([b"".join(sets)])], names=["g", "sids", "sizes", "tokens"])

    for batch in batches:
        for g, sid, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if g != now:
                if sids:
                    yield row()
                now, sids, sets = g, [], []
            sids.append(sid)
            sets.append(tokens)
    if sids:
        yield row()


def _open(one: tuple, two: tuple | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions that hold together what is linked in two groups, the second's after the first's, or within one; ``SIDE`` sets of each side at a time."""
    sizes_a, tokens_a = one
    sizes_b, tokens_b = two if two is not None else one
    row_a, row_b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    union_a, col_a = np.unique(tokens_a, return_inverse=True)
    if two is not None:
        at = np.minimum(np.searchsorted(union_a, tokens_b), len(union_a) - 1)
        both = union_a[at] == tokens_b
        row_b, col_b = row_b[both], at[both]
    else:
        col_b = col_a
    shared = np.zeros(len(union_a), dtype=np.int64)
    np.add.at(shared, col_b, 1)
    keep = shared > (0 if two is not None else 1)
    need = lambda n: -(-percent * n // 100)
    inside_a = keep[col_a]
    bound_a = np.bincount(row_a[inside_a], minlength=len(sizes_a)) >= need(sizes_a)  # overlap with the other's token union
    inside_b = keep[col_b]
    bound_b = np.bincount(row_b[inside_b], minlength=len(sizes_b)) >= need(sizes_b)
    if not bound_a.any() or not bound_b.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside_a &= bound_a[row_a]
    inside_b &= bound_b[row_b]
    new = np.cumsum(keep) - 1
    ra, ca, rb, cb = row_a[inside_a], new[col_a[inside_a]], row_b[inside_b], new[col_b[inside_b]]
    line_a, line_b = np.flatnonzero(bound_a), np.flatnonzero(bound_b)
    to_a, to_b = np.cumsum(bound_a) - 1, np.cumsum(bound_b) - 1
    order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = to_a[ra[order_a]], ca[order_a], to_b[rb[order_b]], cb[order_b]
    left, right, wide = [], [], int(keep.sum())
    for x0 in range(0, len(line_a), SIDE):
        own_a = (ra >= x0) & (ra < x0 + SIDE)
        for y0 in range(x0 if two is None else 0, len(line_b), SIDE):
            own_b = (rb >= y0) & (rb < y0 + SIDE)
            o = _overlaps(ra[own_a] - x0, ca[own_a], rb[own_b] - y0, cb[own_b], min(SIDE, len(line_a) - x0), min(SIDE, len(line_b) - y0), wide)
            a, b = line_a[x0 : x0 + SIDE], line_b[y0 : y0 + SIDE]
            i, j = np.nonzero(100 * o >= percent * (sizes_a[a][:, None] + sizes_b[b][None, :] - o))
            i, j = a[i], b[j]
            if two is None:
                i, j = i[i < j], j[i < j]
            if len(i):  # what holds these links together
                n, shift = len(sizes_a) + len(sizes_b) * (two is not None), len(sizes_a) * (two is not None)
                root = _roots(n, i, j + shift)
                on = np.flatnonzero(root != np.arange(n))
                left.append(on)
                right.append(root[on])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _overlaps(ra: np.ndarray, ca: np.ndarray, rb: np.ndarray, cb: np.ndarray, na: int, nb: int, wide: int) -> np.ndarray:
    """Shared tokens of each of ``na`` sets with each of ``nb``, from (row, column) sorted by column."""
    overlap, step = np.zeros((na, nb), dtype=np.float32), 4096
    for lo in range(0, wide, step):
        a0, a1, b0, b1 = *np.searchsorted(ca, (lo, lo + step)), *np.searchsorted(cb, (lo, lo + step))
        if a1 > a0 and b1 > b0:
            size = min(step, wide - lo)
            x, y = np.zeros((na, size), dtype=np.float32), np.zeros((nb, size), dtype=np.float32)
            x[ra[a0:a1], ca[a0:a1] - lo] = 1
            y[rb[b0:b1], cb[b0:b1] - lo] = 1
            overlap += x @ y.T
    return overlap.astype(np.int64)


def _links(percent: int):
    """Edges that hold together what is linked, from rows of two packed groups (the second can be null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda raw: np.frombuffer(raw, dtype=np.int64)
        for batch in batches:
            left, right = [], []
            for row in range(batch.num_rows):  # one by one, as a row holds two groups
                sa, na, ta, sb, nb, tb = (c[row].as_buffer() for c in batch.columns)
                one = (ints(na), np.frombuffer(ta, dtype=np.uint64))
                two = (ints(nb), np.frombuffer(tb, dtype=np.uint64)) if sb is not None else None
                a, b = _open(one, two, percent)
                if len(a):
                    sids = np.concatenate((ints(sa), ints(sb))) if two else ints(sa)
                    left.append(sids[a])
                    right.append(sids[b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, k, n_shingles, component_id, component``.

    Two texts link where 100 times the shingles they share is at least ``percent``
    times the shingles they have together; no link is missed. Equal sets are one
    set. The tokens that are indexed of a set are its rarest ones (by counters of a
    fixed size, which only set the order), so passages that many texts share are not
    what brings groups together. Groups are cut at about ``GROUP_TOKENS`` tokens:
    a very large group of near copies is compared block by block, and a pair of
    blocks gives edges that hold its links together, not its pairs. Only groups of
    two blocks' size come to a task.

    ``k`` is a key of the row's id and text. Null and empty texts, and those without
    words, have no shingles and link with nothing. Repeated rows link with each
    other. A null id is never a component's id, so a component without ids has none, and
    components that share their smallest id share their ``component_id``; ``component``,
    the hash of one of its sets, tells them apart. It is null without shingles. An empty table gives none; other
    columns are not carried.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), "text")
    profile = stored(keyed.mapInArrow(tidy(_profile(words)), "doc_id long, k long, sid long, n long, block int, counts binary"), "shingle-profile")
    levels = spark.sparkContext.broadcast(_levels(profile.where("block is not null").select("block", "counts")))
    rows = profile.where("block is null").select("doc_id", "k", "sid", "n")
    index = stored(docs.select("text").mapInArrow(tidy(_index(levels, words, percent)), "tok long, sid long, n int, central float"), "shingle-index")
    twice = index.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1").select("tok")
    some = stored(index.select("tok", "sid").join(twice, "tok").distinct(), "shingle-twice")
    shared = some.groupBy("tok").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("tok")
    live = some.join(shared, "tok")
    # At least as many indexed tokens as this are shared with a linked set, which can be smaller by 100 - percent in 100.
    need = lambda n: F.expr(f"greatest(1, least(8, ({percent} * {n} div 100) div 4), ({percent} * {n} div 100) div 32)")
    enough = live.groupBy("sid").agg(F.count("*").alias("m"))
    info = index.groupBy("sid").agg(F.first("n").alias("n"), F.first("central").alias("central"))
    info = info.join(enough, "sid").where(F.col("m") >= need("n")).select("sid", "n", "central")
    live = stored(live.join(info, "sid"), "shingle-live")
    lead = live.groupBy("tok").agg(F.max(F.struct("central", "sid")).alias("lead"))
    votes = live.join(lead, "tok").groupBy("sid", "n", "lead").agg(F.count("*").alias("m"))
    sets = votes.groupBy("sid", "n").agg(F.max(F.struct("m", "lead")).alias("best"))
    sets = sets.select("sid", "n", F.when(F.col("best.m") >= need("n"), F.col("best.lead.sid")).otherwise(F.col("sid")).alias("lead"))
    weight = sets.groupBy("lead").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("blocks"))
    groups = stored(sets.join(weight, "lead").select("sid", "n", F.xxhash64("lead", F.pmod(F.xxhash64("sid"), F.col("blocks"))).alias("g")), "shingle-groups")
    matrix = live.select("tok", "sid").join(groups.select("sid", "g"), "sid").select("tok", "g").distinct()
    crossing = matrix.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("tok")
    matrix = stored(matrix.join(crossing, "tok"), "shingle-matrix")
    span = groups.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("m"))
    met = matrix.alias("x").join(matrix.alias("y"), F.expr("x.tok = y.tok and x.g < y.g")).groupBy(F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).agg(F.count("*").alias("m"))
    sized = lambda x, c: span.select(F.col("g").alias(c), F.col("least").alias(f"least_{x}"), F.col("most").alias(f"most_{x}"))
    met = met.join(sized("a", "ga"), "ga").join(sized("b", "gb"), "gb").where(F.expr(f"100 * most_a >= {percent} * least_b and 100 * most_b >= {percent} * least_a")).withColumn("least", F.least("least_a", "least_b")).where(F.col("m") >= need("least")).select("ga", "gb")

    wanted = stored(met, "shingle-pairs")
    needed = wanted.select(F.col("ga").alias("g")).union(wanted.select("gb")).union(span.where("m > 1").select("g")).distinct()
    holders = rows.groupBy("sid").agg(F.min("k").alias("k"))
    members = groups.join(needed, "g", "left_semi").join(holders, "sid").select("k", "g", "sid")
    texts = keyed.select("k", "text").join(members, "k").select("g", "sid", "text").dropDuplicates(["sid"])
    packed = texts.mapInArrow(tidy(_members(words)), "g long, sid long, tokens binary").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(tidy(_packed), "g long, sids binary, sizes binary, tokens binary")
    packed = stored(packed, "shingle-packed")
    side = lambda x: packed.select(F.col("g").alias(f"g{x}"), F.col("sids").alias(f"s{x}"), F.col("sizes").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    columns = ["sa", "na", "ta", "sb", "nb", "tb"]
    across = wanted.join(side("a"), "ga").join(side("b"), "gb").select(columns)
    nothing = F.lit(None).cast("binary")
    alone = side("a").join(span.where("m > 1").select(F.col("g").alias("ga")), "ga", "left_semi").select("sa", "na", "ta", nothing.alias("sb"), nothing.alias("nb"), nothing.alias("tb"))
    edges = across.union(alone).mapInArrow(tidy(_links(percent)), "a long, b long")
    found = components(edges, "shingle-components").withColumnRenamed("node", "sid")

    least = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    joined = least.join(found, "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = joined.join(smallest, "component").select("sid", "component_id", "component")
    out = rows.where("n > 0").join(by_set, "sid").select("doc_id", "k", F.col("n").alias("n_shingles"), "component_id", "component")
    return out.unionByName(rows.where("n = 0").select("doc_id", "k", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
