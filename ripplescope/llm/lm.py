"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

The probability of a word is that of its class, given features of what comes before,
times that of the word within its class. The class factor is a softmax over hashed
features: the word before (bigram), the two before (trigram), and the one before
those skipped over (skip); its weights are learnt by distributed gradient updates.
Frequent words are classes of their own, other words share classes by their ending.

The word factor has a feature for every skip, bigram and trigram context of the
corpus with every word after it. Fitted one family after the other under a Dirichlet
prior, the weight of such a feature is ``log((c + m*p) / ((n + m) * p))`` and that of
all words that a context lacks ``log(m / (n + m))``: ``c`` of the context's ``n`` uses
have the word, ``p`` is the probability so far, ``m`` grows with the root of ``n``,
and the products add up to one. This table grows with the corpus; it is dealt over
parts and never in one place.

The corpus is cut into words once, and kept in blocks of word numbers. Blocks ask the
parts of the name space for the counts of their words and features (``blocks``), in
two rounds, and no token is shuffled. Scores are computed a block at a time, sparsely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .blocks import ANSWERED, ASKED, answered, asked_keys, asks, bucket_count, distinct, laid, listed, numbers, opened, parts_log2, portions, squeezed, table_of, text_bytes, told
from .common import stored

ROWS_LOG2, FEATURES = 14, 3
TOP, ENDINGS = 23, 24
CLASSES = TOP + ENDINGS + 1  # the last is the end
RATE, FIRST, BATCH, ROUNDS = 0.15, 1e-3, 8192, 2
#: Tokens that one worker descends over in a round, about.
WORKER = 1 << 23
#: Weight of what came before, by kind of feature: so many times the square root of a context's uses, as
#: the words that follow a context grow more slowly than its uses.
BIGRAM, SKIP, TRIGRAM = 1, 2, 3
PRIOR = {SKIP: 100.0, BIGRAM: 10.0, TRIGRAM: 4.0}
#: Bits of a feature's number within its part.
FEATURE_BITS = 30
_END = 0x5BD1E995C0FFEE11 >> 1
_BEGIN = 0x7F4A7C159E3779B9
_ONES = np.ones(CLASSES, dtype=np.float32)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _endings(words: pa.Array) -> np.ndarray:
    """The classes of words that are none of the most frequent, by their last two bytes and length."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(offsets)
    last = data[offsets[1:] - 1].astype(np.int64)
    second = np.where(size > 1, data[np.maximum(offsets[1:] - 2, 0)], 0).astype(np.int64)
    return (TOP + (last * 131 + second * 31 + np.minimum(size, 12) // 6) % ENDINGS).astype(np.uint8)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the number of each word, and the distinct words, frequent ones first."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    codes, size = coded.indices.to_numpy().astype(np.int64), split.value_lengths().to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # at blanks before the first word or after the last
        real = codes != empty
        size = size - np.bincount(np.repeat(np.arange(len(size)), size)[~real], minlength=len(size))
        codes = codes[real]
    n = np.bincount(codes, minlength=len(coded.dictionary))
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    place = np.empty(len(n), dtype=np.int64)
    place[order] = np.arange(len(order))
    return size, place[codes], coded.dictionary.take(pa.array(order))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as word numbers, with the names and endings of their distinct words."""
    import xxhash

    number = numbers()
    for t in portions(batches, "text"):
        size, codes, words = _words(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        raw = [squeezed(size.astype(np.uint32)), squeezed(names), squeezed(_endings(words)), squeezed(codes.astype(np.uint32))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([next(number)], pa.int64()), pa.array([len(codes) + len(size)], pa.int64()), listed(t.column("doc_id")), listed(t.column("held")), *[pa.array([x], pa.binary()) for x in raw]],
            names=["block", "n", "ids", "held", "sizes", "names", "endings", "codes"],
        )


class Tokens:
    """The tokens of a block: the words of its texts, and an end each."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.held = np.array(row["held"], dtype=bool)
        self.names = np.append(opened(row["names"], np.uint64), np.uint64(_END))
        self.endings = np.append(opened(row["endings"], np.uint8), np.uint8(CLASSES - 1))
        self.sizes = opened(row["sizes"], np.uint32).astype(np.int64) + 1
        self.firsts = np.cumsum(self.sizes) - self.sizes
        word = np.ones(int(self.sizes.sum()), dtype=bool)
        word[self.firsts + self.sizes - 1] = False
        self.ids = np.full(len(word), len(self.names) - 1, dtype=np.int64)
        self.ids[word] = opened(row["codes"], np.uint32)
        self.learnt = np.repeat(~self.held, self.sizes)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token, and the one before that; at a text's start, the number beyond all names."""
        one, two = np.empty_like(self.ids), np.empty_like(self.ids)
        one[1:], two[2:] = self.ids[:-1], self.ids[:-2]
        one[self.firsts] = two[self.firsts] = two[self.firsts[self.sizes > 1] + 1] = len(self.names)
        return one, two

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, a number of 64 bits for what comes before: bigram, skip, trigram."""
        names = np.append(self.names, np.uint64(_BEGIN))
        one, two = self.before()
        a, b = _mix(names * _A)[one], _mix(names * _B + np.uint64(1))[two]
        return a, b, _mix(a + b * _C)

    def rows(self) -> list[np.ndarray]:
        """For each token, its row in the table of each feature of the class softmax."""
        cut = np.uint64(64 - ROWS_LOG2)
        return [(x >> cut).astype(np.uint16) for x in self.contexts()]

    def features(self, log2: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each kind, a number for each token's context and word, ``log2`` bits for its part and ``FEATURE_BITS`` within."""
        word = _mix(self.names * _C + np.uint64(7))[self.ids]
        for kind, context in zip((BIGRAM, SKIP, TRIGRAM), self.contexts(), strict=True):
            yield kind, _mix(context + word) >> np.uint64(64 - FEATURE_BITS - log2)

    def classes(self, top: np.ndarray) -> np.ndarray:
        """The class of each name; ``top`` has the most frequent names in their order."""
        out = self.endings.astype(np.int64)
        if len(top):
            order = np.argsort(top)
            at = np.minimum(np.searchsorted(top[order], self.names), len(top) - 1)
            some = top[order][at] == self.names
            out[some] = order[at[some]]
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tokens({c: batch.column(c)[i].as_py() for c in ("block", "held", "sizes", "names", "endings", "codes")})


SUMS, FREQUENT = -1, -2


def _asked_words(bits: int):
    """The names of a block, with their uses in texts to learn from, how often they end one, and their endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows(batches):
            n = np.bincount(t.ids[t.learnt], minlength=len(t.names))
            some = (t.sizes > 1) & ~t.held
            last = np.bincount(t.ids[(t.firsts + t.sizes - 2)[some]], minlength=len(t.names))
            order = np.argsort(t.names)
            yield table_of(list(asks(t.block, 0, t.names[order], bits, n[order].astype(np.uint32), last[order].astype(np.uint32), t.endings[order])), ASKED)

    return run


def _answered_words(asked: pa.Table, bits: int) -> list[tuple]:
    """Each block's counts over all blocks; and what the part adds to the classes, and its most frequent names."""
    keys = asked_keys(asked)
    uniq, where = distinct(np.concatenate(keys))
    column = lambda c, kind: np.concatenate([opened(x.as_py(), kind) for x in asked.column(c)])
    n, last = (np.bincount(where, column(c, np.uint32), len(uniq)).astype(np.int64) for c in ("second", "third"))
    kind = np.zeros(len(uniq), dtype=np.int64)
    kind[where] = column("fourth", np.uint8)
    out, lo = [], 0
    part = asked.column("part")[0].as_py()
    for block, k in zip(asked.column("block").to_pylist(), keys, strict=True):
        own = where[lo : lo + len(k)]
        out.append((block, part, 0, squeezed(n[own]), squeezed(last[own])))
        lo += len(k)
    used = np.flatnonzero(n)
    sums = np.stack([np.bincount(kind[used], n[used], CLASSES), np.bincount(kind[used], minlength=CLASSES)]).astype(np.int64)
    out.append((None, part, SUMS, squeezed(sums.ravel()), None))
    names = uniq + (np.uint64(part) << np.uint64(bits))
    words = used[kind[used] != CLASSES - 1]
    words = words[np.lexsort((names[words], -n[words]))[:TOP]]
    out.append((None, part, FREQUENT, squeezed(names[words]), squeezed(n[words] * CLASSES + kind[words])))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the classes and the most frequent names of all rows together."""
    sums, names, n = np.zeros(2 * CLASSES, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for kind, first, second in zip(*[batch.column(c).to_pylist() for c in ("kind", "first", "second")], strict=True):
            if kind == SUMS:
                sums += opened(first, np.int64)
            else:
                names, n = np.append(names, opened(first, np.uint64)), np.append(n, opened(second, np.int64))
                best = np.lexsort((names, -(n // CLASSES)))[:TOP]
                names, n = names[best], n[best]
    yield table_of([(None, 0, SUMS, squeezed(sums), None), (None, 0, FREQUENT, squeezed(names), squeezed(n))], ANSWERED)


def _asked_features(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows(batches):
            for kind, x in t.features(log2):
                keys, where = distinct(x)
                uses = np.bincount(where[t.learnt], minlength=len(keys)).astype(np.uint32)
                yield table_of(list(asks(t.block, kind, keys, FEATURE_BITS, uses)), ASKED)

    return run


def _answered_features(asked: pa.Table) -> list[tuple]:
    keys = asked_keys(asked)
    uniq, where = distinct(np.concatenate(keys))
    uses = np.bincount(where, np.concatenate([opened(x.as_py(), np.uint32) for x in asked.column("second")]), len(uniq)).astype(np.int64)
    part, kind = asked.column("part")[0].as_py(), asked.column("kind")[0].as_py()
    cuts = np.cumsum([0, *map(len, keys)])
    return [(block, part, kind, squeezed(uses[where[a:b]]), None) for block, a, b in zip(asked.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True)]


class Weights:
    """Feature tables and bias of the class softmax."""

    def __init__(self, tables: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.tables = tables if tables is not None else np.zeros((FEATURES, 1 << ROWS_LOG2, CLASSES), dtype=np.float32)
        self.bias = bias if bias is not None else np.zeros(CLASSES, dtype=np.float32)

    def _powers(self, rows: list[np.ndarray], lo: int) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits of a batch of tokens, and their sums; logits stay where both are finite."""
        z = np.take(self.tables[0], rows[0][lo : lo + BATCH], axis=0)
        for t, r in zip(self.tables[1:], rows[1:], strict=True):
            z += np.take(t, r[lo : lo + BATCH], axis=0)
        z += self.bias
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        return z, z @ _ONES

    def shares(self, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """The probability of each token's class."""
        out = np.empty(len(classes))
        for lo in range(0, len(classes), BATCH):
            c = classes[lo : lo + BATCH]
            z, sums = self._powers(rows, lo)
            out[lo : lo + BATCH] = z[np.arange(len(c)), c] / sums
        return out

    def descend(self, rows: list[np.ndarray], classes: np.ndarray, seen: np.ndarray, used: np.ndarray) -> None:
        """Gradient updates in mini-batches; a row's step shrinks with the squares it has seen."""
        for lo in range(0, len(classes), BATCH):
            c = classes[lo : lo + BATCH]
            z, sums = self._powers(rows, lo)
            z /= sums[:, None]
            z[np.arange(len(c)), c] -= 1
            self.bias -= RATE * (z.sum(0) / len(c))
            for k in range(FEATURES):
                r = rows[k][lo : lo + BATCH]
                order = np.argsort(r, kind="stable")
                r = r[order]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                row, n = r[first], np.diff(np.append(first, len(r)))
                g = np.add.reduceat(np.take(z, order, axis=0), first, axis=0)
                seen[k, row] += (g * g) @ _ONES
                used[k, row] += n
                g *= (RATE / np.sqrt(seen[k, row]))[:, None]
                self.tables[k][row] -= g


def _descent(weights, top: np.ndarray, turn: int):
    """A worker's change of every feature row, with how often it was used, as blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights.value
        own = Weights(start.tables.copy(), start.bias.copy())
        shape = (FEATURES, 1 << ROWS_LOG2)
        seen, used = np.full(shape, FIRST, dtype=np.float32), np.zeros(shape, dtype=np.float32)
        for t in _rows(batches):
            some = t.learnt & np.repeat(np.arange(len(t.sizes)) % ROUNDS == turn, t.sizes)
            own.descend([r[some] for r in t.rows()], t.classes(top)[t.ids[some]], seen, used)
        if used.any():
            change, size = own.tables - start.tables, 1 << ROWS_LOG2 - 6
            for k in range(FEATURES):
                for b in range(64):
                    part = np.s_[k, b * size : (b + 1) * size]
                    yield _packed(k * 64 + b, used[part], change[part])
            yield _packed(-1, used[:1].sum(1), (own.bias - start.bias)[None])

    return run


def _packed(part: int, used: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """The rows that a worker used: which, how often, and their change in 16 bits."""
    some = np.flatnonzero(used)
    raw = len(some).to_bytes(4, "little") + some.astype(np.uint16).tobytes() + used[some].astype(np.float32).tobytes() + change[some].astype(np.float16).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw])], names=["part", "raw"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses, and changes weighted by them, added as they stream in; memory for the model only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = int.from_bytes(raw[:4], "little")
            rows = np.frombuffer(raw, np.uint16, n, 4)
            used = np.frombuffer(raw, np.float32, n, 4 + 2 * n).astype(np.float64)[:, None]
            sums = total.setdefault(k, np.zeros((1 << ROWS_LOG2 - 6 if k >= 0 else 1, 1 + CLASSES)))
            sums[rows, :1] += used
            sums[rows, 1:] += used * np.frombuffer(raw, np.float16, n * CLASSES, 4 + 6 * n).reshape(n, CLASSES)
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()])], names=["part", "raw"])


def train(cut: DataFrame, tokens: int, top: np.ndarray, uses: np.ndarray) -> Weights:
    """Fits the class softmax to all texts of the blocks ``cut`` that aren't held; the bias begins at the classes' shares.

    A worker takes about ``WORKER`` tokens; which blocks it gets follows from how
    the blocks' files are read, so that averages differ slightly with the layout.
    """
    spark, model = cut.sparkSession, Weights(bias=np.log((uses + 1) / (uses.sum() + CLASSES)).astype(np.float32))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        deltas = cut.drop("ids", "n").coalesce(-(-tokens // WORKER) or 1).mapInArrow(_descent(shared, top, turn), "part int, raw binary")
        sums = deltas.repartition(64, "part").mapInArrow(_added, "part int, raw binary").collect()  # the model's size
        model = Weights(model.tables.copy(), model.bias.copy())
        for r in sums:
            raw = np.frombuffer(bytes(r["raw"]), dtype=np.float32).reshape(-1, 1 + CLASSES)
            change = raw[:, 1:] / np.maximum(1.0, raw[:, :1])
            if r["part"] < 0:
                model.bias += change[0]
            else:
                k, b = divmod(r["part"], 64)
                model.tables[k, b << ROWS_LOG2 - 6 : b + 1 << ROWS_LOG2 - 6] += change
        shared.unpersist()
    return model


def corrected(t: Tokens, shares: np.ndarray, counts: dict[int, np.ndarray], n: np.ndarray, last: np.ndarray, ends: int) -> np.ndarray:
    """The probabilities ``shares`` after the features of all contexts.

    ``counts`` has by kind how often each token's context and word are learnt from
    together; ``n`` and ``last`` how often each name stands, and ends a text. A token
    that is learnt from is left out of its own counts: it is judged by all others.
    """
    one, two = t.before()
    own = t.learnt.astype(np.int64)
    uses, followed = np.append(n, ends), np.append(n - last, 0)
    pair = np.empty(len(t.ids))
    pair[1:], pair[t.firsts] = counts[BIGRAM][:-1], ends
    for kind, total in ((SKIP, followed[two]), (BIGRAM, uses[one]), (TRIGRAM, pair)):
        there = total > 0
        total = np.where(there, total - own, 0)
        weight = PRIOR[kind] * np.sqrt(np.maximum(total, 1))
        shares = ((counts[kind] - own) * there + weight * shares) / (total + weight)
    return shares


def lm_scores(docs: DataFrame, held) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its scores; texts where ``held`` holds are not learnt from.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    gain_per_token``. ``base_score`` adds log10((c+1)/(N+V+1)) over the tokens, with
    counts over all training tokens, ends included; ``score`` is the model's log10
    probability, and the gain what it has over the base, by token. A token that is
    learnt from doesn't count for its own score, so that texts that are learnt from
    and others can be compared. In each class,
    words that training lacks share the probability of one. Words are told apart by
    64-bit hashes, contexts and words together by ``FEATURE_BITS`` bits in a part of
    about a million of them.

    Null and empty texts are an end alone. Repeated rows score alike. A null id is
    scored as any other, with the null text as id in ``held``. Without training
    texts all counts are 0. An empty table gives none; other columns are not carried.
    """
    id_type = docs.schema["doc_id"].dataType
    flagged = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    text = text_bytes(docs)
    bits = 64 - parts_log2(text >> 6)
    schema = StructType([StructField("block", LongType()), StructField("n", LongType()), StructField("ids", ArrayType(id_type)), StructField("held", ArrayType(BooleanType())), *[StructField(c, BinaryType()) for c in ("sizes", "names", "endings", "codes")]])
    cut = laid(flagged.mapInArrow(_cut, schema), bucket_count(text), "lm-blocks")
    columns = cut.select("block", "held", "sizes", "names", "endings", "codes")
    size = cut.agg(F.sum("n")).head()[0] or 0

    words = stored(answered(columns.mapInArrow(_asked_words(bits), ASKED), lambda asked: _answered_words(asked, bits)), "lm-words")
    told_all = words.where("kind < 0").mapInArrow(_merged, ANSWERED).repartition(8).mapInArrow(_merged, ANSWERED).collect()  # sums by class, and TOP names
    merged = next(_merged(iter([table_of([tuple(r) for r in told_all], ANSWERED)]))).to_pydict()
    uses, kinds = opened(merged["first"][0], np.int64).reshape(2, CLASSES)
    top, most = opened(merged["first"][1], np.uint64), opened(merged["second"][1], np.int64)
    tokens, distinct_words, ends = int(uses.sum()), int(kinds.sum()), int(uses[CLASSES - 1])
    uses, mass = uses.astype(float), uses + kinds + 1.0
    for i, (n, c) in enumerate(zip(*divmod(most, CLASSES), strict=True)):
        mass[i], uses[i] = n + 2, n
        mass[c] -= n + 1
        uses[c] -= n
    mass = np.maximum(mass, 1.0)
    model = docs.sparkSession.sparkContext.broadcast(train(cut, size, top, uses))

    log2 = parts_log2(FEATURES * size)
    answers = answered(columns.mapInArrow(_asked_features(log2), ASKED), _answered_features)
    answers = words.where("kind = 0").unionByName(answers)

    def score(blocks: pa.Table, own: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return own_schema.empty_table()
        row = {c: blocks.column(c)[0].as_py() for c in ("block", "held", "sizes", "names", "endings", "codes")}
        t, ids = Tokens(row), blocks.column("ids").combine_chunks().flatten()
        order = np.argsort(t.names)
        n, last = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        n[order], last[order] = told(own, 0, "first", np.int64), told(own, 0, "second", np.int64)
        counts = {}
        for kind, x in t.features(log2):
            counts[kind] = told(own, kind, "first", np.int64)[distinct(x)[1]]
        kind = t.classes(top)
        base = np.log10((n + 1.0) / (tokens + distinct_words + 1.0))
        within = (n[t.ids] + 1.0 - t.learnt) / (mass[kind[t.ids]] - t.learnt)
        shares = model.value.shares(t.rows(), kind[t.ids]) * within
        logs = np.log10(corrected(t, shares, counts, n, last, ends))
        add = lambda x: np.add.reduceat(x, t.firsts)
        base, logs = add(base[t.ids]), add(logs)
        return pa.table([ids, pa.array(t.held), t.sizes, add((n > 0).astype(np.int64)[t.ids]), np.full(len(ids), tokens), base, logs, (logs - base) / t.sizes], schema=own_schema.with_metadata(None))

    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([StructField("doc_id", id_type), StructField("held_out", BooleanType()), *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[StructField(c, DoubleType()) for c in ("base_score", "score", "gain_per_token")]])
    own_schema = to_arrow_schema(out)
    return cut.drop("n").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.expr("pmod(crc32(cast(doc_id as string)), 7) = 2"))
