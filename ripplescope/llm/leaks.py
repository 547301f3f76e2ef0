"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words; a document's other words
only make its passages longer. A distributed randomised SVD of the benchmark's
passages gives a basis in which every passage of every document is compared by
cosine with the items; what is near enough is aligned word by word with a longest
common subsequence, and the item's rarest words, which stand for its answer, must
be there if the alignment is loose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, stored, tidy
from .toxicity import KEEP, words_of

RANK, EXTRA = 128, 16
#: Items are taken in blocks of so many, each with a basis of its own, so that the rank suffices; and so many blocks a pass over the documents.
ITEM_BLOCK, PASS = 250, 16
#: Windows start at every so many words; for items shorter than SHORT, twice as often.
STRIDE, SEGMENT, SHORT = 16, 1 << 15, 32
COSINE, TIGHT, LOOSE, ANSWER = 0.3, 0.75, 0.5, 0.8


def _numbered(texts: pa.Array, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """The words of each text by number; words that no item has share the last number."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    clean = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(KEEP) if texts.buffers()[2] else b""
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(clean))
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    get, other = vocabulary.get, len(vocabulary)
    numbers = np.fromiter((get(w, other) if w else -1 for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
    words, size = numbers[coded.indices.to_numpy()], split.value_lengths().to_numpy().astype(np.int64)
    if (words < 0).any():  # at blanks before the first word or after the last
        size = size - np.bincount(np.repeat(np.arange(len(size)), size)[words < 0], minlength=len(size))
        words = words[words >= 0]
    return np.split(words, np.cumsum(size)[:-1])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, dtype=np.float64)
            total[k] = total[k] + x if k in total else x
    for k, x in total.items():
        yield _row(k, x)


def _row(k: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes()])], names=["part", "raw"])


def _sum(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums ``parts(part, raw)`` of an array of fixed size; its blocks are added on the executors."""
    rows = parts.repartition(16, "part").mapInArrow(_added, "part int, raw binary").collect()
    out = {r["part"]: np.frombuffer(bytes(r["raw"]), dtype=np.float64) for r in rows}
    size = int(np.prod(shape))
    cuts = np.array_split(np.arange(size), 16)
    return np.concatenate([out.get(i, np.zeros(len(c))) for i, c in enumerate(cuts)]).reshape(shape)


def _split(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(np.array_split(x.ravel(), 16)):
        if part.any():
            yield _row(i, part)


def _document_counts(shared):
    """In how many documents each word stands; the last number counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        n = np.zeros(len(vocabulary) + 1)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for lo in range(0, len(texts), 500):
                for words in _numbered(texts[lo : lo + 500], vocabulary):
                    n[np.unique(words[words < len(vocabulary)])] += 1
                    n[-1] += 1
        yield from _split(n)

    return run


def _passages(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, weights, passage of each), a passage a text, weights of length one a passage."""
    for batch in batches:
        lists = [x for x in _numbered(batch.column(0), vocabulary) if len(x)]
        if lists:
            words, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            w = idf[words]
            yield words, w / np.sqrt(np.bincount(which, w * w))[which], which


def _by_terms(terms: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    order = np.argsort(terms, kind="stable")
    t = terms[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    out[t[first]] += np.add.reduceat(values[order], first, axis=0)


def fit_basis(passages: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors of ``passages(text)``, by two rounds of a randomised SVD."""
    spark = passages.sparkSession
    size, width = len(vocabulary), min(RANK + EXTRA, len(vocabulary))
    q = np.random.default_rng(3).normal(size=(size, width))
    for _ in range(2):
        shared = spark.sparkContext.broadcast((q, vocabulary, idf))

        def through(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            basis, known, weights = shared.value
            y = np.zeros_like(basis)
            for words, w, which in _passages(batches, known, weights):
                first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
                rows = np.add.reduceat(w[:, None] * basis[words], first, axis=0)
                _by_terms(words, w[:, None] * rows[which], y)
            yield from _split(y)

        q = np.linalg.qr(_sum(passages.mapInArrow(through, "part int, raw binary"), (size, width)))[0]
    shared = spark.sparkContext.broadcast((q, vocabulary, idf))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, known, weights = shared.value
        g = np.zeros((basis.shape[1], basis.shape[1]))
        for words, w, which in _passages(batches, known, weights):
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            rows = np.add.reduceat(w[:, None] * basis[words], first, axis=0)
            g += rows.T @ rows
        yield from _split(g)

    values, turn = np.linalg.eigh(_sum(passages.mapInArrow(squares, "part int, raw binary"), (width, width)))
    return q @ turn[:, values.argsort()[::-1][:RANK]]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a word of ``a``."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        same = row & at.get(w, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


@dataclass
class Items:
    """A block of items as the executors need them."""

    ids: list[int]
    words: list[list[int]]  # of each item, as rows of the table
    vectors: np.ndarray
    stride: np.ndarray  # words from window to window
    reach: np.ndarray  # strides that hold the item
    answers: list[set[int]]
    has: np.ndarray  # by item and row, whether the item has the word
    own: np.ndarray  # by number of a word, its row in the table
    table: np.ndarray  # by row, its latent vector; the last but one is for other words, the last for none
    squares: np.ndarray  # by row, the square of its weight
    shares: list[dict[int, int]]  # how often each item has its words

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], vocabulary: dict[bytes, int], idf: np.ndarray, local: dict[bytes, int], basis: np.ndarray) -> Items:
        rows = [(i, words_of(t)) for i, t in rows]
        rows = [(i, w) for i, w in rows if w]
        own, table = np.full(len(vocabulary) + 1, len(local)), np.zeros((len(local) + 2, basis.shape[1]), dtype=np.float32)
        for w, k in local.items():
            own[vocabulary[w]] = k
        weight = np.array([*(idf[vocabulary[w]] for w in local), idf[-1], 0.0])
        table[:-2] = basis * weight[:-2, None]
        rows = [(i, [local[x] for x in w]) for i, w in rows]
        has = np.zeros((len(rows), len(local) + 2), dtype=bool)
        for k, (_, w) in enumerate(rows):
            has[k, w] = True
        sums = np.array([table[w].sum(0) for _, w in rows], dtype=np.float32).reshape(len(rows), table.shape[1])
        vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        size = np.array([len(w) for _, w in rows], dtype=np.int64)
        stride = np.where(size < SHORT, STRIDE // 2, STRIDE)
        reach = (size + stride // 2 + stride - 1) // stride
        answers = [{w for _, w in sorted({(-weight[x], x) for x in words})[: max(1, len(set(words)) // 4)]} for _, words in rows]
        return cls([i for i, _ in rows], [w for _, w in rows], vectors, stride, reach, answers, has, own, table, weight**2, [Counter(w) for _, w in rows])


def _segments(lists: list[np.ndarray], overlap: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(text, first word, words) of about ``SEGMENT`` words together; long texts overlap by a window."""
    some, held = [], 0
    for i, words in enumerate(lists):
        for lo in range(0, len(words), SEGMENT):
            some.append((i, lo, words[lo : lo + SEGMENT + overlap]))
            held += len(some[-1][2])
            if held >= SEGMENT:
                yield some
                some, held = [], 0
    if some:
        yield some


def _near(segments: list[tuple[int, int, np.ndarray]], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, first word in it, item, cosine) of the windows that are near an item.

    A window is as long as the item, and shorter at a text's end: strides without
    words stand between the segments.
    """
    half = STRIDE // 2
    gap = 2 * int((items.reach * items.stride).max() // STRIDE + 1)
    n = np.array([2 * -(-len(w) // STRIDE) for _, _, w in segments])  # in half strides
    first = np.cumsum(n + gap) - (n + gap)
    sizes, total, none = np.array([len(w) for _, _, w in segments]), int((n + gap).sum()), len(items.table) - 1
    words = np.full(total * half, none)
    words[np.arange(int(sizes.sum())) + np.repeat(first * half - (np.cumsum(sizes) - sizes), sizes)] = items.own[np.concatenate([w for _, _, w in segments])]
    words = words.reshape(total, half)
    vectors = items.table[words[:, 0]]
    for k in range(1, half):
        vectors += items.table[words[:, k]]
    squares, real = items.squares[words].sum(1), words[:, 0] < none
    for stride in np.unique(items.stride):
        if stride == STRIDE:
            vectors, squares, real, first = vectors[::2] + vectors[1::2], squares[::2] + squares[1::2], real[::2] | real[1::2], first // 2
        for r in np.unique(items.reach[items.stride == stride]):
            some = np.flatnonzero((items.reach == r) & (items.stride == stride))
            windows, length = vectors.copy(), squares.copy()
            for k in range(1, int(r)):
                windows[:-k] += vectors[k:]
                length[:-k] += squares[k:]
            windows /= np.sqrt(np.maximum(length, 1e-9))[:, None]
            cos = windows[real] @ items.vectors[some].T
            w, i = np.nonzero(cos >= COSINE)
            found = np.flatnonzero(real)[w]
            segment = np.searchsorted(first, found, "right") - 1
            yield segment, (found - first[segment]) * stride, some[i], cos[w, i]


def _matches(shared):
    names = ["k", "doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, blocks = shared.value
        overlap = max(int((b.reach * b.stride).max()) for b in blocks) if blocks else 0
        for batch in batches:
            found = []
            texts = batch.column(2).cast(pa.binary())
            for lo in range(0, len(texts) if blocks else 0, 400):
                lists = _numbered(texts[lo : lo + 400], vocabulary)
                best: dict[tuple[int, int, int], tuple] = {}
                for segments in _segments(lists, overlap):
                    for number, items in enumerate(blocks):
                        for near in _near(segments, items):
                            for s, w, i, c in zip(*[x.tolist() for x in near], strict=True):
                                at, offset, _ = segments[s]
                                item, start, stride = items.words[i], offset + w, int(items.stride[i])
                                first = max(0, start - stride)
                                passage = items.own[lists[at][first : start + (int(items.reach[i]) + 1) * stride]]
                                passage = passage[items.has[i, passage]].tolist()  # other words align with nothing
                                most = min(len(passage), sum(map(items.shares[i].__getitem__, set(passage))))
                                share = lcs(item, passage) / len(item) if most >= LOOSE * len(item) else 0.0
                                if share >= LOOSE:
                                    answer = len(items.answers[i].intersection(passage)) / len(items.answers[i])
                                    if share >= TIGHT or answer >= ANSWER:
                                        best[at, number, i] = max(best.get((at, number, i), (0.0,)), (share, answer, c, -first))
                for (at, number, i), (share, answer, c, first) in best.items():
                    found.append((batch.column(0)[lo + at].as_py(), batch.column(1)[lo + at].as_py(), blocks[number].ids[i], c, share, answer, -first))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` that hold an item of ``benchmark(item_id, text)``.

    Returns ``k, doc_id, item_id, cosine, lcs_share, answer_share, first_word``, a
    row for each document and item: ``k`` is a key of the row's id and text,
    ``first_word`` where the passage that was aligned begins. Document frequencies
    are counted over all rows; every passage of every whole text is compared, at
    each ``STRIDE`` words and for items shorter than ``SHORT`` twice as often, with
    windows as long as the item. A passage matches that
    has ``TIGHT`` of the item's words in order, or ``LOOSE`` of them and ``ANSWER``
    of the quarter of its words that are rarest.

    Null and empty texts, and items without words, match nothing; repeated rows
    match alike; an empty table on either side gives none. Items are taken in blocks
    of about ``ITEM_BLOCK``, and ``PASS`` blocks in two passes over the documents, one
    to count and one to compare; an item is sent whole.
    """
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null"), "leak-items")
    blocks, out = max(1, -(-items.count() // ITEM_BLOCK)), None
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    keyed = docs.select(row_key("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    for lo in range(0, blocks, PASS):
        rows = sorted(((r["block"], r["item_id"], bytes(r["text"])) for r in items.where(F.col("block").between(lo, lo + PASS - 1)).collect()), key=str)  # about PASS * ITEM_BLOCK items
        vocabulary = {w: i for i, w in enumerate(sorted({w for *_, t in rows for w in words_of(t)}))}
        counts = _sum(docs.select("text").mapInArrow(tidy(_document_counts(spark.sparkContext.broadcast(vocabulary))), "part int, raw binary"), (len(vocabulary) + 1,))
        idf = np.log((counts[-1] + 2) / (counts[:-1] + 1)) + 0.1
        idf = np.append(idf, np.median(idf) if len(idf) else 1.0)  # other words are as rare as the items' are
        some = []
        for block in sorted({b for b, *_ in rows}):
            own = [(i, t) for b, i, t in rows if b == block]
            local = {w: i for i, w in enumerate(sorted({w for _, t in own for w in words_of(t)}))}
            if local:
                basis = fit_basis(items.where(F.col("block") == block).select("text"), local, np.array([*(idf[vocabulary[w]] for w in local), idf[-1]]))
                some.append(Items.of(own, vocabulary, idf, local, basis))
        found = keyed.mapInArrow(tidy(_matches(spark.sparkContext.broadcast((vocabulary, some)))), "k long, doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long")
        out = found if out is None else out.union(found)
    return out


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).drop("k")
