"""Corpora in blocks, and what blocks ask of the whole corpus.

A block is some megabytes of whole texts in one row. Blocks are written once, dealt
into buckets by their number, so that what comes back to a block meets it there and
the block itself never moves. What a block asks about, the names that it holds, goes
sorted and packed to the parts of the name space; a part answers each block in the
block's own order. A name that all blocks hold is in each of them once, so no part
gets more than its share of names from any block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
ASKED = "part int, block long, kind int, first binary, second binary, third binary, fourth binary"
ANSWERED = "block long, part int, kind int, first binary, second binary"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of ``docs(text)``, counted."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0


def bucket_count(size: int) -> int:
    return max(8, -(-size // BLOCK))


def parts_log2(names: int, each: int = 1 << 20) -> int:
    """Parts, as a power of two, of about ``each`` names."""
    return max(4, (max(1, names) // each).bit_length())


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK) -> Iterator[pa.Table]:
    """Whole rows with about ``most`` bytes of ``column`` at a time; a row counts 16 bytes besides."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        lo = 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = min(len(ends), int(np.searchsorted(ends, before + most - size)) + 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            lo = hi
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbers() -> Iterator[int]:
    """Numbers for the blocks of this task that no other task gives."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def listed(column: pa.ChunkedArray) -> pa.Array:
    """A column as one list."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def laid(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """Writes ``df(block, ...)`` to the shared folder in buckets of its blocks and reads it back.

    Grouping what is read by ``block`` needs no shuffle. The catalogue forgets the
    table at once; its files go when the application ends.
    """
    spark, key = df.sparkSession, uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/{name}-{key}", f"{name.replace('-', '_')}_{key}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and the place of each number among them."""
    order = np.argsort(x)
    s = x[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    where = np.empty(len(x), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return s[new], where


def asks(block: int, kind: int, keys: np.ndarray, bits: int, *more: np.ndarray | None) -> Iterator[tuple]:
    """Rows of ``ASKED``: sorted ``keys``, their part above ``bits`` bits, with up to three columns beside them."""
    if not len(keys):
        return
    part = keys >> np.uint64(bits)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    inside = keys & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        columns = [None if x is None else squeezed(x[a:b]) for x in more] + [None] * (3 - len(more))
        yield int(part[a]), block, kind, squeezed(np.diff(inside[a:b], prepend=np.uint64(0))), *columns


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def asked_keys(asked: pa.Table) -> list[np.ndarray]:
    """The keys within the part, by row."""
    return [np.cumsum(opened(x.as_py(), np.uint64), dtype=np.uint64) for x in asked.column("first")]


def answered(asked: DataFrame, answer: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """``ANSWERED`` rows, from what ``answer`` says to all rows of one part and kind."""

    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([table_of(answer(rows), ANSWERED)])

    return asked.groupBy("part", "kind").applyInArrow(run, ANSWERED)


def told(answers: pa.Table, kind: int, column: str, type_) -> np.ndarray:
    """What all parts told a block about its keys of one kind, in the keys' order."""
    own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
    parts = [opened(x.as_py(), type_) for x in own.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, type_)
