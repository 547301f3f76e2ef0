"""SentencePiece encoding with keyed merge-dropout, and decoding.

A text becomes a sequence of pieces of a public BPE model. The agenda merges the
best adjacent pair first; every candidate merge is skipped with a given
probability, by a hash keyed with the seed, the document, the segment's place in it
and the candidate's place in the segment. So the same seed gives the same
segmentation anywhere, each place of a word draws its own, and all of them decode to
the text. Segmentations without a skip are shared; the others are made one by one.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: So many draws a segment at most; 0 lets each place draw anew.
VARIANTS = 0
#: Texts are taken together up to so many bytes; longer segments use the heap.
BLOCK, SHORT = 4 << 20, 40
#: Slots of the table of pairs.
SLOTS_LOG2 = 20
_SPACE = "▁"
_SEGMENT = re.compile(rb" *[^ \n]+| +|\n")
_ALL = (1 << 64) - 1
_NONE = np.int64(1) << np.int64(40)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Pieces:
    """The model's tables; built on the driver, sent to the executors once."""

    chars: dict[str, int]
    keys: np.ndarray  # left * size + right of each pair that merges, sorted
    merged: np.ndarray
    rank: np.ndarray  # by piece, the lower the earlier
    raw: list[bytes]  # by piece, what it decodes to
    byte0: int
    pairs: dict[tuple[int, int], int] = field(default_factory=dict)
    by_char: np.ndarray | None = None  # by code point, its symbol
    slots: np.ndarray | None = None  # of a hash table, the place of a key in ``keys`` or -1

    def __post_init__(self) -> None:
        self.by_char = -np.arange(0x110000, dtype=np.int32) - 1
        for c, piece in self.chars.items():
            self.by_char[ord(c)] = piece
        self.by_char[ord(" ")] = self.chars.get(_SPACE, -33)
        self.by_char[ord(_SPACE)] = -ord(_SPACE) - 1
        self.slots = np.full(1 << SLOTS_LOG2, -1, dtype=np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        slot = self._slot(self.keys)
        while len(left):  # each key takes the next free slot
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            go = self.slots[slot] != left
            left, slot = left[go], (slot[go] + 1) & ((1 << SLOTS_LOG2) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        score = np.array([sp.get_score(i) for i in range(size)])
        rank = np.empty(size, dtype=np.int64)
        rank[np.lexsort((np.arange(size), -score))] = np.arange(size)
        keys = np.array([a * size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else sp.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(size)]
        return cls({p: i for p, i in ids.items() if len(p) == 1}, keys[order], np.array(list(pairs.values()), dtype=np.int64)[order], rank, raw, sp.piece_to_id("<0x00>"), pairs)

    def all_symbols(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece for each character, or minus its code point less one, of all segments; and how many each has.

        A literal U+2581 has no piece, so that it isn't decoded as a blank. Bytes that
        are no UTF-8 are characters of their own.
        """
        whole = b"".join(segments)
        try:
            text = whole.decode()
            head = np.frombuffer(whole, np.uint8) & 0xC0 != 0x80
            ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
            sizes = np.diff(np.append(0, np.cumsum(head)[ends - 1])) if len(whole) else np.zeros(len(segments), np.int64)
        except UnicodeDecodeError:
            parts = [x.decode(errors="surrogateescape") for x in segments]
            text, sizes = "".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return self.by_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64), sizes

    def symbols(self, segment: bytes) -> list[int]:
        return self.all_symbols([segment])[0].tolist()

    def spelled(self, symbol: int) -> list[int]:
        return [symbol] if symbol >= 0 else [self.byte0 + b for b in chr(-symbol - 1).encode(errors="surrogateescape")]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        want = np.where((left >= 0) & (right >= 0), left * len(self.rank) + right, -1).ravel()
        slot = self._slot(want)
        at = self.slots[slot]
        out = np.where(self.keys[at] == want, self.merged[at], -1)
        todo = np.flatnonzero((self.keys[at] != want) & (at >= 0) & (want >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS_LOG2) - 1)
            at = self.slots[slot[todo]]
            same = self.keys[at] == want[todo]
            out[todo[same]] = self.merged[at[same]]
            todo = todo[~same & (at >= 0)]
        out[want < 0] = -1
        return out.reshape(left.shape)


def _place(start: np.ndarray, mid: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A hash of the candidate that joins at ``mid`` what begins at ``start``."""
    place = (start.astype(np.uint64) << np.uint64(34)) ^ (mid.astype(np.uint64) << np.uint64(17)) ^ piece.astype(np.uint64)
    return _mix(place + np.uint64(0x632BE59BD9B4E019))


def _drawn(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    return (_mix(key + place) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def _skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins at ``mid`` what begins at ``start`` is skipped."""
    return _drawn(key, _place(start, mid, piece), dropout)


def _mix_one(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


def _skips(key: int, start: int, mid: int, piece: int, dropout: float) -> bool:
    """``_skipped`` of one candidate."""
    place = _mix_one((start << 34 & _ALL ^ mid << 17 ^ piece) + 0x632BE59BD9B4E019 & _ALL)
    return (_mix_one(key + place & _ALL) >> 11) * 2.0**-53 < dropout


def segment_agenda(model: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """One segment by a heap of candidates; time n log n."""
    n = len(symbols)
    sym, after, before, alive = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (piece := model.pairs.get((sym[a], sym[b]))) is not None:
            if not dropout or not _skips(key, a, b, piece, dropout):
                heapq.heappush(agenda, (int(model.rank[piece]), a, b, sym[a], sym[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, a, b, x, y = heapq.heappop(agenda)
        if not (alive[a] and alive[b] and sym[a] == x and sym[b] == y and after[a] == b):
            continue
        sym[a], alive[b], after[a] = model.pairs[x, y], False, after[b]
        if after[a] >= 0:
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [p for i in range(n) if alive[i] for p in model.spelled(sym[i])]


def agenda_block(model: Pieces, symbols: np.ndarray, keys: np.ndarray, dropout: float, seen: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Segments of one length together, a merge in each a round: (rows, pieces) as they end.

    All candidates that come up are added to ``seen`` as (rows, hashes).
    """
    rows, out = np.arange(len(symbols)), []
    sym, start = symbols, np.broadcast_to(np.arange(symbols.shape[1]), symbols.shape).copy()

    def ranked(a: np.ndarray, b: np.ndarray, s: np.ndarray, m: np.ndarray, k: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rank and piece in one number, so that the least is the next to merge."""
        piece = model.find(a, b)
        good = piece >= 0
        if seen is not None:
            seen.append((row[good], _place(s[good], m[good], piece[good])))
        if dropout:
            good[good] = ~_skipped(k[good], s[good], m[good], piece[good], dropout)
        return np.where(good, model.rank[piece] * np.int64(1 << 20) + piece, _NONE)

    wide = lambda k, n: np.broadcast_to(k[:, None], (len(k), n))
    rank = ranked(sym[:, :-1], sym[:, 1:], start[:, :-1], start[:, 1:], wide(keys, sym.shape[1] - 1), wide(rows, sym.shape[1] - 1))
    while sym.shape[1] > 1 and len(rows):
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        done = best == _NONE
        if done.any():
            out.append((rows[done], sym[done]))
            go = ~done
            rows, sym, start, rank, keys, at, best = rows[go], sym[go], start[go], rank[go], keys[go], at[go], best[go]
            if not len(rows):
                return out
        line, n = np.arange(len(rows)), sym.shape[1] - 1
        sym[line, at] = best & np.int64((1 << 20) - 1)
        keep = np.ones(sym.shape, dtype=bool)
        keep[line, at + 1] = False
        sym, start = sym[keep].reshape(len(rows), n), start[keep].reshape(len(rows), n)
        keep = np.ones(rank.shape, dtype=bool)
        keep[line, at] = False
        rank = rank[keep].reshape(len(rows), n - 1)
        for here in (at - 1, at):  # the pairs on both sides of what was merged
            ok = (here >= 0) & (here < n - 1)
            r, c = line[ok], here[ok]
            rank[r, c] = ranked(sym[r, c], sym[r, c + 1], start[r, c], start[r, c + 1], keys[ok], rows[ok])
    if len(rows):
        out.append((rows, sym))
    return out


def encode_block(model: Pieces, texts: list[bytes], doc_keys: np.ndarray, dropout: float, variants: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of the texts, one after the other, and how many each text has."""
    import xxhash

    lists = [_SEGMENT.findall(b" " + t) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    coded = pa.array(itertools.chain.from_iterable(lists), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    del lists
    flat = coded.indices.to_numpy().astype(np.int64)
    if not len(flat):
        return flat, sizes
    segments = coded.dictionary.to_pylist()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = _mix(np.repeat(doc_keys, sizes) ^ _mix(place.astype(np.uint64) + np.uint64(seed * 2 + 1)))
    if variants:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in segments), np.uint64, len(segments))
        keys = _mix(hashes[flat] + _mix(keys % np.uint64(variants)))
    symbols, lengths = model.all_symbols(segments)
    begins = np.cumsum(lengths) - lengths
    counts, first, pool, held = [], [], [], 0

    def solve(owner: np.ndarray, keys: np.ndarray, dropout: float, seen: list | None) -> None:
        """Adds the pieces of the segments ``owner``; those longer than SHORT come to ``seen`` as if skipped and have none."""
        nonlocal held
        own_counts, own_first, size = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), lengths[owner]
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            if n > SHORT:
                if seen is not None:
                    continue
                ends = [(np.array([i]), np.array([segment_agenda(model, symbols[begins[owner[i]] :][:n].tolist(), int(keys[i]), dropout)], dtype=np.int64)) for i in some]
            else:
                matrix, met = symbols[begins[owner[some]][:, None] + np.arange(n)], None if seen is None else []
                ends = [(some[rows], result) for rows, result in (agenda_block(model, matrix, keys[some], dropout, met) if n > 1 else [(np.arange(len(some)), matrix)])]
                if met:
                    seen.extend((some[rows], places) for rows, places in met)
            for rows, result in ends:
                plain = (result >= 0).all(1)
                good = result[plain]
                own_counts[rows[plain]], own_first[rows[plain]] = good.shape[1], held + np.arange(len(good)) * good.shape[1]
                pool.append(good.ravel())
                held += good.size
                for r, line in zip(rows[~plain].tolist(), result[~plain].tolist(), strict=True):
                    spelled = [p for x in line for p in model.spelled(x)]
                    own_counts[r], own_first[r] = len(spelled), held
                    pool.append(np.array(spelled, dtype=np.int64))
                    held += len(spelled)
        counts.append(own_counts)
        first.append(own_first)

    seen: list[tuple[np.ndarray, np.ndarray]] | None = [] if dropout else None
    solve(np.arange(len(segments)), np.zeros(len(segments), np.uint64), 0.0, seen)
    which = flat
    if dropout:
        hit = lengths[flat] > SHORT
        if seen:
            rows, places = (np.concatenate(x) for x in zip(*seen, strict=True))
            places = places[np.argsort(rows, kind="stable")]
            n = np.bincount(rows, minlength=len(segments))
            ends, m = np.cumsum(n), n[flat]
            until = np.cumsum(m)
            at = np.arange(until[-1]) + np.repeat(ends[flat] - until, m)
            hit |= np.bincount(np.repeat(np.arange(len(flat)), m)[_drawn(np.repeat(keys, m), places[at], dropout)], minlength=len(flat)) > 0
        solve(flat[hit], keys[hit], dropout, None)
        which = flat.copy()
        which[hit] = len(segments) + np.arange(int(hit.sum()))
    counts, first = np.concatenate(counts), np.concatenate(first)
    pool = np.concatenate(pool)
    n = counts[which]
    ends = np.cumsum(n)
    pieces = pool[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1])]
    return pieces, np.add.reduceat(np.append(n, 0), np.minimum(np.cumsum(sizes) - sizes, len(n))) * (sizes > 0)


def decode(model: Pieces, ids: np.ndarray) -> bytes:
    """The text of some pieces; the blank that encoding puts first goes."""
    return b"".join(map(model.raw.__getitem__, ids.tolist()))[1:]


def encode(docs: DataFrame, key: str = "doc_id", model_file: str = MODEL, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = 1) -> DataFrame:
    """Adds ``ids array<int>`` and ``lossless boolean`` to ``docs(key, text, ...)``.

    ``lossless`` says that the pieces were decoded and gave the text. Null and empty
    texts have no pieces. Equal rows get equal pieces, whatever the partitioning;
    former columns of those names are replaced; an empty table gives none. Long
    texts are cut at segments only, which no merge crosses. Nothing is shuffled.
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    docs = docs.drop("ids", "lossless")
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType(), False)), StructField("lossless", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_file))
    named = docs.withColumn("_key", F.xxhash64(key))
    at, key_at, names = named.columns.index("text"), named.columns.index("_key"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, keys = batch.column(at).cast(pa.binary()), batch.column(key_at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            size = np.cumsum(np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], dtype=np.int64))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, "right")))
                own = [t or b"" for t in texts[lo:hi].to_pylist()]
                ids, counts = encode_block(model, own, keys[lo:hi], dropout, variants, seed)
                ends = np.concatenate(([0], np.cumsum(counts)))
                same = [decode(model, ids[a:b]) == t for a, b, t in zip(ends[:-1], ends[1:], own, strict=True)]
                arrays = [c.slice(lo, hi - lo) for k, c in enumerate(batch.columns) if k != key_at]
                arrays += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                lo = hi

    return named.mapInArrow(tidy(run), schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document: how many, a digest of their ids, and whether they decode."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "lossless")
