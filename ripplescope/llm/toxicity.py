"""Toxicity: averaged subword embeddings in a linear softmax, over word windows.

Every word is a bag of hashed character n-grams and of itself; a window of words is
the average of their embeddings, which a two-class softmax reads. A document scores
what its worst window scores, so that length does not thin a few words out. The
embeddings and the softmax are trained together in numpy: each round picks the
windows that score highest so far, of toxic and of clean documents, and descends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

#: At most so many training documents of each class, the first by a hash of their id; of these, the fit leaves out texts of more bytes than that.
MAX_TRAIN, MAX_TRAIN_BYTES = 2_500, 40_000
BUCKETS_LOG2 = 17
DIM = 8
WINDOW = 8
CACHE = 200_000

#: By byte, what stands for it in words: A-Z lower-cased, blanks for all of ASCII but letters and digits.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEEP).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of 3 to 5 bytes of ``<word>`` and of the words, and whose they are."""
    joined = np.frombuffer(b"".join(b"<%b>" % w for w in words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(joined))  # bytes up to the word's end
    prime, ids, whose = np.uint64(0x9E3779B97F4A7C15), [], []
    h = joined.copy()
    for n in range(2, 6):
        h = h[:-1] * prime + joined[n - 1 :] if len(h) > 1 else h[:0]
        if n >= 3:
            ok = left[: len(h)] >= n
            ids.append(h[ok] + np.uint64(n))
            whose.append(owner[: len(h)][ok])
    inside = np.arange(len(joined)) - np.repeat(starts, sizes)
    powers = np.power(np.uint64(0xC2B2AE3D27D4EB4F), (inside % 61).astype(np.uint64)) + inside.astype(np.uint64)
    ids.append(np.add.reduceat(joined * powers, starts) if len(words) else joined[:0])
    whose.append(np.arange(len(words)))
    h = np.concatenate(ids)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), np.concatenate(whose)


@dataclass
class Model:
    """What scoring needs: each bucket's embedding times the softmax weights, and the bias."""

    bucket: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, whose = subwords(words)
        return np.bincount(whose, self.bucket[ids], len(words)) / np.bincount(whose, minlength=len(words))


def worst(scores: np.ndarray) -> float:
    """The highest window average; 0 without words."""
    n = len(scores)
    if n <= WINDOW:
        return float(scores.mean()) if n else 0.0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW)


def train(texts: list[bytes], labels: list[int], rounds: int = 8, passes: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits embeddings and softmax together on a bounded set of texts. Without both classes, every score is the share of toxic labels."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int64) for t in texts]
    y = np.array(labels, dtype=np.int64)
    known = [i for i in range(len(docs)) if len(docs[i])]
    if not known or len(set(y[known])) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BUCKETS_LOG2), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    words, parts = list(vocabulary), []
    for lo in range(0, len(words), 20_000):  # a part at a time, so that the driver holds few numbers at once
        ids, whose = subwords(words[lo : lo + 20_000])
        order = np.argsort(whose, kind="stable")
        parts.append((ids[order].astype(np.int32), np.bincount(whose, minlength=min(20_000, len(words) - lo))))
    ids, grams = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del words, parts
    first = np.cumsum(grams) - grams
    emb = rng.uniform(-1, 1, (1 << BUCKETS_LOG2, DIM)) / DIM
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    seen_e, seen_w, seen_b = np.full(1 << BUCKETS_LOG2, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = grams[words]
        flat = ids[np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.add.reduceat(emb[flat], np.cumsum(n) - n, axis=0) / n[:, None], flat, n

    for turn in range(rounds):
        windows: list[tuple[np.ndarray, int]] = []
        if turn:
            scalar = np.add.reduceat((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)[ids], first) / grams
        for i in known:
            d = docs[i]
            if not turn or len(d) <= WINDOW:
                windows.append((d if len(d) < 400 else d[rng.integers(0, len(d) - 399) :][:400], int(y[i])))
                continue
            sums = np.concatenate(([0.0], np.cumsum(scalar[d])))
            means = sums[WINDOW:] - sums[:-WINDOW]
            for _ in range(1 if y[i] else 4):
                at = int(means.argmax())
                windows.append((d[at : at + WINDOW], int(y[i])))
                means[max(0, at - WINDOW + 1) : at + WINDOW] = -np.inf
            if not y[i]:
                at = int(rng.integers(0, len(d) - WINDOW))
                windows.append((d[at : at + WINDOW], 0))
        target = np.array([w[1] for w in windows])
        for _ in range(passes if turn else 2):
            for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 256)):
                sizes = np.array([len(windows[i][0]) for i in part])
                flat_words = np.concatenate([windows[i][0] for i in part])
                uniq, back = np.unique(flat_words, return_inverse=True)
                vec, flat, n = vectors(uniq)
                row = np.repeat(np.arange(len(part)), sizes)
                h = np.add.reduceat(vec[back], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                z = h @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), target[part]] -= 1
                p /= len(part)
                gh, gw, gb = p @ soft.T, h.T @ p, p.sum(0)
                gv = np.zeros_like(vec)
                np.add.at(gv, back, gh[row] / sizes[row][:, None])
                ge = np.zeros((len(flat), DIM))
                ge[:] = np.repeat(gv / n[:, None], n, axis=0)
                touched, slot = np.unique(flat, return_inverse=True)
                total = np.stack([np.bincount(slot, ge[:, k], len(touched)) for k in range(DIM)], axis=1)
                seen_e[touched] += (total**2).mean(1)
                emb[touched] -= rate * total / np.sqrt(seen_e[touched])[:, None]
                seen_w += gw**2
                seen_b += gb**2
                soft -= 0.2 * rate * gw / np.sqrt(seen_w)
                bias -= 0.2 * rate * gb / np.sqrt(seen_b)
    return Model(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Labelled texts to learn from: ``(doc_id, text, toxic)``, bounded per class."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1) and pmod(crc32(cast(_id as string)), 5) <> 0").distinct()
    picked = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])  # at most 2 * most rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).where(F.octet_length("text") <= MAX_TRAIN_BYTES).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """The model of at most ``2 * most`` labelled rows of ``docs(doc_id, text)``; one task of an executor trains it, and only the model comes to the driver.

    Rows beyond the bound, of ids that stand several times, are the last by a hash of
    their content. Without rows the model scores what it scores without both classes.
    """
    rows = training_rows(docs, labels, most).select("doc_id", "toxic", F.col("text").cast("binary").alias("t"))
    rows = rows.orderBy(F.xxhash64("doc_id", "t"), "doc_id", "toxic").limit(2 * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sorted(x for batch in batches for x in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        if some:
            model = train([x[2] for x in some], [x[1] for x in some])
            yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()]), pa.array([model.bias])], names=["bucket", "bias"])

    found = rows.mapInArrow(tidy(run), "bucket binary, bias double").collect()  # one row, the model
    return Model(np.frombuffer(bytes(found[0]["bucket"])), found[0]["bias"]) if found else train([], [])


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """Adds ``name`` (0 to 1) to ``docs(text, ...)``; a former column of that name is replaced.

    Null and empty texts, and those without words, score 0, as nothing in them is
    toxic; an empty table gives none; repeated rows score alike. Texts are read whole, one Arrow batch at a time; nothing is shuffled.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = [words_of(t) for t in part.column(at).cast(pa.binary()).to_pylist()]
                fresh = list(set().union(*lists).difference(cache))
                if len(cache) + len(fresh) > CACHE:
                    cache.clear()
                    fresh = list(set().union(*lists))
                cache.update(zip(fresh, m.word_scores(fresh).tolist(), strict=True))
                z = np.array([worst(np.fromiter(map(cache.__getitem__, ws), float, len(ws))) for ws in lists], dtype=float) + m.bias
                value = np.where([len(ws) > 0 for ws in lists], 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0")
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
