"""Repeated byte strings and passages: prefix doubling over content-chosen positions.

Prefix doubling names the string of a growing length at each position by the pair
of names of its halves, reranks, and goes on with the positions whose name is not
unique. Doing so at every byte would sort nine times as many rows as the corpus has
bytes; here names are fingerprints, so that a round may begin at any length, and the
first rounds run over few positions. With strings of 400 bytes they are:

1. anchors, the positions whose 16 bytes hash lowest among 185: every string has one
   in its first half, the same wherever it stands. An anchor whose next 200 bytes
   are unique is done with;
2. pairs of that name and of all that the strings of one anchor reach. Where a pair
   repeats, all of these strings do; where one name has several pairs, one anchor of
   each goes on;
3. pairs of that name and of all 400 bytes, at every start of these anchors.

Passages of more than 50 words go the same way, an anchor and then all windows of 51
words. Texts are kept in blocks, which ask the parts of the name space whether a name
stands anywhere else (``blocks``); texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .blocks import ANSWERED, ASKED, answered, asked_keys, asks, bucket_count, distinct, laid, listed, numbers, opened, parts_log2, portions, squeezed, table_of, text_bytes, told
from .common import stored

LENGTH, GRAM = 400, 16
#: A passage has so many words at least; its anchors hash lowest, by so many words, among those of its first half.
PASSAGE, WORD_GRAM = 51, 4
#: Texts are taken together up to so many bytes, and longer ones in pieces of so many starts.
PIECE = 1 << 20
#: What a block asks about: names of anchors, pairs of them, starts; and anchors and windows of words.
ANCHORS, PAIRS, STARTS, WORDS, WINDOWS = 1, 2, 3, 4, 5
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Prints:
    """Fingerprints of any run of a sequence of numbers."""

    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Prints._up) < n:
            size = max(n, 2 * PIECE)
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(Prints, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * Prints._up[: n - 1], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * Prints._down[at])

    def grams(self, size: int) -> np.ndarray:
        """Of all runs of ``size``; only the upper half is good."""
        n = max(0, len(self.sums) - size)
        h = (self.sums[size:] - self.sums[:n]) * Prints._down[:n]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    full = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(x)] = x
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(prints: Prints, starts: np.ndarray, sizes: np.ndarray, length: int, half: int, gram: int) -> np.ndarray:
    """(text, anchor, first start, last start) of each anchor; the texts follow each other in the sequence.

    The anchor of a start is the gram that hashes lowest, by 32 bits, the leftmost of
    equals, among those within ``half`` of it.
    """
    count = np.maximum(sizes - length + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros((4, 0), dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(total) + np.repeat(starts - (np.cumsum(count) - count), count)
    grams = prints.grams(gram)
    coded = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_window_min(coded, half - gram + 1)[at] & _LOW).astype(np.int64)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    return np.stack([text[first], chosen[first], at[first], at[last]])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...``, so many of each."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts, compressed."""
    number = numbers()
    for t in portions(batches, "text"):
        texts = pc.fill_null(t.column("text").combine_chunks(), "").cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.uint32)
        raw = pa.Codec("zstd", compression_level=3).compress(b"".join(texts.to_pylist()), asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), listed(t.column("doc_id")), pa.array([squeezed(sizes)]), pa.array([raw])], names=["block", "ids", "sizes", "raw"])


class Texts:
    """A block's texts, and what the rounds name in them."""

    def __init__(self, row: dict, length: int):
        self.block, self.length = row["block"], length
        self.sizes = opened(row["sizes"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        size = int(self.sizes.sum())
        self.raw = pa.decompress(row["raw"], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        self.data = np.frombuffer(self.raw, np.uint8)

    def _groups(self, sizes: np.ndarray, starts: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, starts within, sizes) of texts that are taken together, or of pieces of a long one."""
        lo, n = 0, len(sizes)
        ends = np.cumsum(sizes)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + PIECE, "right")))
            if ends[hi - 1] - ends[lo] + sizes[lo] <= PIECE:
                yield int(starts[lo]), int(starts[lo] + ends[hi - 1] - ends[lo] + sizes[lo]), starts[lo:hi] - starts[lo], sizes[lo:hi]
            else:
                for o in range(0, int(sizes[lo]), PIECE):
                    size = min(int(sizes[lo]) - o, PIECE + overlap)
                    yield int(starts[lo]) + o, int(starts[lo]) + o + size, np.zeros(1, np.int64), np.array([size])
            lo = hi

    def pieces(self) -> Iterator[tuple[int, Prints, np.ndarray]]:
        """(offset, fingerprints, anchors) of the bytes, some texts at a time."""
        half = self.length // 2
        for a, b, starts, sizes in self._groups(self.sizes, self.starts, self.length - 1):
            if sizes.max() >= self.length:
                prints = Prints(_BYTES[self.data[a:b]])
                yield a, prints, anchors(prints, starts, sizes, self.length, half, GRAM)

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """The names of all anchors, and of all that the strings of each reach."""
        names, wholes = [], []
        for _, prints, (_, a, lo, hi) in self.pieces():
            names.append(prints.of(a, self.length // 2))
            wholes.append(prints.of(lo, hi - lo + self.length) ^ ((a - lo).astype(np.uint64) << np.uint64(16)) ^ (hi - lo).astype(np.uint64))
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(names or none), np.concatenate(wholes or none)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of all anchors, in the block."""
        found = [x[2:] + a for a, _, x in self.pieces()]
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def prints_at(self, at: np.ndarray) -> np.ndarray:
        """Names of the strings at some places."""
        out = np.zeros(len(at), np.uint64)
        for a, b, *_ in self._groups(self.sizes, self.starts, self.length - 1):
            some = np.flatnonzero((at >= a) & (at <= b - self.length))
            if len(some):
                out[some] = Prints(_BYTES[self.data[a:b]]).of(at[some] - a, self.length)
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A fingerprint of each word, and how many words each text has."""
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.starts] = edge[-1:] = True
        full = ~_BLANK[self.data]
        begins = np.flatnonzero(full & (edge[:-1] | ~np.append(False, full[:-1])))
        ends = np.flatnonzero(full & (edge[1:] | ~np.append(full[1:], False))) + 1
        count = np.diff(np.searchsorted(begins, np.append(self.starts, len(self.data))))
        out, lo = np.zeros(len(begins), np.uint64), 0
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + PIECE, "right")))
            prints = Prints(_BYTES[self.data[begins[lo] : ends[hi - 1]]])
            out[lo:hi] = prints.of(begins[lo:hi] - begins[lo], ends[lo:hi] - begins[lo:hi])
            lo = hi
        return out, count

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words: each anchor's name, text, first and last window; and the name of every window that could be one.

        The last has a window's name at its first word, and zero where a text ends before.
        """
        words, count = self.words()
        first = np.cumsum(count) - count
        half = PASSAGE // 2
        names, texts, lows, highs, windows = [], [], [], [], np.zeros(len(words), np.uint64)
        owner = np.repeat(np.arange(len(count)), count)
        for a, b, starts, sizes in self._groups(count, first, PASSAGE - 1):
            if sizes.max() < PASSAGE:
                continue
            prints = Prints(words[a:b])
            text, at, lo, hi = anchors(prints, starts, sizes, PASSAGE, half, WORD_GRAM)
            names.append(prints.of(at, PASSAGE - half + WORD_GRAM))
            texts.append(owner[lo + a])
            lows.append(lo + a)
            highs.append(hi + a)
            every = _spread(lo, hi - lo + 1)
            windows[every + a] = prints.of(every, PASSAGE)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return join(names, np.uint64), join(texts, np.int64), join(lows, np.int64), join(highs, np.int64), windows


def _several(where: np.ndarray, n: int, text: np.ndarray) -> np.ndarray:
    """Whether each of n names stands in several texts."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(least, where, text)
    np.maximum.at(most, where, text)
    return (least < most).astype(np.uint8)


def _paired(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by (first, second): where one stands, the place of each among them, and how often it stands."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where, np.bincount(where, minlength=int(new.sum()))


class Rounds:
    """A block's part in the rounds; what earlier rounds were told is replayed."""

    def __init__(self, row: dict, length: int, bits: int, answers: pa.Table | None = None):
        self.texts, self.bits, self.answers = Texts(row, length), bits, answers

    def _told(self, kind: int) -> np.ndarray:
        return told(self.answers, kind, "first", np.uint8)

    def _asks(self, kind: int, keys: np.ndarray, second: np.ndarray | None, several: np.ndarray) -> Iterator[tuple]:
        return asks(self.texts.block, kind, keys, self.bits, second, several.astype(np.uint8))

    def first(self) -> Iterator[tuple]:
        names, _ = self.texts.named()
        keys, where = distinct(names)
        yield from self._asks(ANCHORS, keys, None, np.bincount(where, minlength=len(keys)) > 1)
        names, text, *_ = self.texts.passages()
        keys, where = distinct(names)
        yield from self._asks(WORDS, keys, None, _several(where, len(keys), text))

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names, wholes = self.texts.named()
        live = np.flatnonzero(self._told(ANCHORS)[distinct(names)[1]])
        names, wholes = names[live], wholes[live]
        return live, names, wholes, *_paired(names, wholes)

    def _windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words at which windows of repeated anchors start, their texts, and their distinct names with the place of each."""
        names, text, lo, hi, windows = self.texts.passages()
        live = np.flatnonzero(self._told(WORDS)[distinct(names)[1]])
        count = hi[live] - lo[live] + 1
        at = _spread(lo[live], count)
        return at, np.repeat(text[live], count), *distinct(windows[at])

    def second(self) -> Iterator[tuple]:
        _, names, wholes, one, _, count = self._pairs()
        yield from self._asks(PAIRS, names[one], wholes[one], count > 1)
        _, text, keys, where = self._windows()
        yield from self._asks(WINDOWS, keys, None, _several(where, len(keys), text))

    def _starts(self) -> tuple[np.ndarray, ...]:
        """Strings that surely repeat as (first, last) starts; then the single starts that are still open, and their pairs."""
        live, names, _, one, where, _ = self._pairs()
        said = self._told(PAIRS)
        lo, hi = self.texts.ranges()
        found = live[(said & 1)[where] > 0]
        go = one[(said & 2) > 0]
        count = hi[live[go]] - lo[live[go]] + 1
        at = _spread(lo[live[go]], count)
        names = np.repeat(names[go], count)
        strings = self.texts.prints_at(at)
        return lo[found], hi[found], at, names, strings, *_paired(names, strings)

    def third(self) -> Iterator[tuple]:
        *_, names, strings, one, _, count = self._starts()
        yield from self._asks(STARTS, names[one], strings[one], count > 1)

    def removed(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts of all strings that stand elsewhere too."""
        lo, hi, at, _, _, _, where, _ = self._starts()
        single = at[(self._told(STARTS) & 1)[where] > 0]
        return np.append(lo, single), np.append(hi, single)

    def shared_passages(self) -> np.ndarray:
        """How many maximal passages of each text other texts have too."""
        at, text, _, where = self._windows()
        at, text = (x[self._told(WINDOWS)[where] > 0] for x in (at, text))
        order = np.argsort(at, kind="stable")
        at, text = at[order], text[order]
        new = np.append(True, (at[1:] > at[:-1] + PASSAGE) | (text[1:] != text[:-1]))[: len(at)]
        return np.bincount(text[new], minlength=len(self.texts.sizes))


def _answered(asked: pa.Table) -> list[tuple]:
    """By block and name: 1 if it stands elsewhere, and 2 if it goes on as the first of its kind where a name has several pairs."""
    asked = asked.sort_by("block")
    keys, kind, part = asked_keys(asked), asked.column("kind")[0].as_py(), asked.column("part")[0].as_py()
    first = np.concatenate(keys)
    again = np.concatenate([opened(x.as_py(), np.uint8) for x in asked.column("third")])
    if kind in (PAIRS, STARTS):
        one, where, count = _paired(first, np.concatenate([opened(x.as_py(), np.uint64) for x in asked.column("second")]))
    else:
        uniq, where = distinct(first)
        count = np.bincount(where, minlength=len(uniq))
    bits = ((count + np.bincount(where, again, len(count))) > 1).astype(np.uint8)[where]
    if kind == PAIRS:
        names = first[one]  # sorted
        same = names[1:] == names[:-1]
        several = np.append(False, same) | np.append(same, False)
        lead = np.full(len(one), len(first))
        np.minimum.at(lead, where, np.arange(len(first)))
        bits[lead[several]] |= 2
    cuts = np.cumsum([0, *map(len, keys)])
    return [(block, part, kind, squeezed(bits[a:b]), None) for block, a, b in zip(asked.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True)]


def _row(blocks: pa.Table) -> dict:
    return {c: blocks.column(c)[0].as_py() for c in ("block", "sizes", "raw")}


def suffix_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages``, and ``kept``.

    Each byte goes that a string of ``length`` bytes covers which also starts at any
    other place, in the same text or another; all strings are judged on the input,
    and ``kept`` (binary, left out without ``texts``) is what stays. ``length`` is 64
    at least. ``n_passages`` counts, and removes nothing, the maximal runs of words
    whose windows of ``PASSAGE`` words all stand in another row too, whatever blanks
    are between them. Names are fingerprints of 64 bits; two, of different extents,
    have to agree before a byte goes.

    Null and empty texts, and those shorter than ``length``, stay whole; repeated
    rows are copies of each other and go. An empty table gives none; other columns
    are not carried. A name is asked about once a block, however often it stands.
    """
    if length < 64:
        raise ValueError("length is 64 at least")
    size, id_type = text_bytes(docs), docs.schema["doc_id"].dataType
    bits = 64 - parts_log2(size >> 5)
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), StructField("sizes", BinaryType()), StructField("raw", BinaryType())])
    kept = laid(docs.select("doc_id", "text").mapInArrow(_keep, schema), bucket_count(size), "suffix-blocks")
    light = kept.select("block", "sizes", "raw")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield table_of(list(Rounds(_row(pa.Table.from_batches([batch.slice(i, 1)])), length, bits).first()), ASKED)

    def later(name: str):
        def run(blocks: pa.Table, own: pa.Table) -> pa.Table:
            rows = list(getattr(Rounds(_row(blocks), length, bits, own), name)()) if blocks.num_rows and own.num_rows else []
            return pa.Table.from_batches([table_of(rows, ASKED)])

        return run

    def settle(blocks: pa.Table, own: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return own_schema.empty_table()
        rounds = Rounds(_row(blocks), length, bits, own)
        t, (lo, hi), passages = rounds.texts, rounds.removed(), rounds.shared_passages()
        order = np.lexsort((hi, lo))
        lo, ends = lo[order], np.maximum.accumulate(hi[order] + length) if len(hi) else hi
        text = np.searchsorted(t.starts, lo, "right") - 1  # an empty text has none
        new = np.append(True, (lo[1:] > ends[:-1]) | (text[1:] != text[:-1]))[: len(lo)]
        runs, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))[: int(new.sum())]
        a, b, owner = lo[runs], ends[last], text[runs]
        n, gone = len(t.sizes), b - a
        removed, spans = np.bincount(owner, gone, n).astype(np.int64), np.bincount(owner, minlength=n)
        cuts, rest = np.searchsorted(owner, np.arange(n + 1)), []
        for i, (s, m) in enumerate(zip(t.starts.tolist(), t.sizes.tolist(), strict=True)):
            c = slice(cuts[i], cuts[i + 1])
            edges = zip([s, *b[c].tolist()], [*a[c].tolist(), s + m], strict=True)
            rest.append(b"".join(t.raw[x:y] for x, y in edges))
        digest = [hashlib.sha256(x).hexdigest() for x in rest]
        columns = [blocks.column("ids").combine_chunks().flatten(), t.sizes, removed, spans, pa.array(digest), passages.astype(np.int64)]
        return pa.table([*columns, pa.array(rest, pa.binary())][: len(own_schema)], schema=own_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([StructField("doc_id", id_type), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType()), StructField("n_passages", LongType()), *[StructField("kept", BinaryType())] * texts])
    own_schema = to_arrow_schema(out)
    met = lambda answers, run, schema, columns=light: columns.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
    one = stored(answered(light.mapInArrow(first, ASKED), _answered), "suffix-first")
    two = one.union(stored(answered(met(one, later("second"), ASKED), _answered), "suffix-second"))
    three = two.union(answered(met(two, later("third"), ASKED), _answered))
    return met(three, settle, out, kept)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, texts=False)
