"""Operator 3: exact removal of repeated strings, by prefix doubling over content-thinned positions.

Wanted: every byte covered by a string of `length` bytes that also starts anywhere else. Prefix doubling
over every byte would rank a pair for each byte and round; here positions are thinned by content first,
which loses nothing:

1. Each start p belongs to the smallest k-gram within its first `WINDOW` bytes, its anchor. Equal
   strings have equal anchors at equal distances, so starts with one anchor form a block and blocks
   are compared by anchor. About two blocks remain for a window's length of text.
2. Doubling. Anchors are ranked by their first bytes; those of unique rank are dropped. What is left is
   ranked by the pair of that rank and the rank at an offset, which makes a string twice as long, and so
   on, until the strings reach the `length` - WINDOW + 1 bytes that any start of a block shares from its
   anchor on.
3. The last rank is paired with the rank of the block's whole extent, from its first start to the
   end of the last one's string. If the pair repeats, all starts of the block repeat.
4. What is undecided, the starts at the edges of repeats, is told apart singly, at the full length: each
   start of an undecided block, and of one member of every other class with its anchor.

Texts are kept in units of some `UNIT` bytes, compressed, in the shared folder. In each round a unit tells
each bucket (the first bits of a rank) its distinct ranks, the bucket sorts what all units told it and
answers with a byte for each. A string that a third of all documents share is told once by a unit, so no
rank is a hot key, and a text of one letter tells one rank. Ranks are fingerprints: of 32 bits and the
bucket's where they only drop (a collision keeps too many), of 128 bits where they decide.

Defined results: null text is empty; texts shorter than `length` keep all; repeated rows are
documents that repeat each other, so all of theirs goes; overlapping repeats within a text count; an
empty table gives no rows; rows without doc_id are documents like others; other columns are left out.
Very long texts are read in segments."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, mix64, shelve, sweep, table, text_batches

LENGTH = 200
WINDOW = 80
GRAM = 24
SEGMENT = 1 << 19
#: Bytes of text in a unit, and for each bucket.
UNIT = 2_000_000
BUCKET = 16_000_000
#: Texts whose fingerprints are kept while a unit is read, in segments.
_KEPT = 8
_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
_CODES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(c)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_BASES = [0x5851F42D4C957F2D, 0xDA942042E4DD58B5]
_STEP = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
    return power(_BASES[which]), power(pow(_BASES[which], -1, 1 << 64))


class Prints:
    """Fingerprints of any stretch of a buffer."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        n = len(raw) + 1
        self.power, self.inverse = _powers(max(1 << 21, 1 << (n - 1).bit_length()), which)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_CODES[which][raw] * self.power[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, have, m = len(x) - width + 1, 1, x
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n]) if have < width else m[:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, have, m = len(x) - width + 1, 1, x
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n]) if have < width else m[:n]


def blocks(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, anchor's distance) of the blocks of texts that lie end to end in a buffer."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none
    prints, n = Prints(raw), len(raw)
    gram_at = np.arange(n - GRAM + 1)
    lead = (prints(gram_at, gram_at + GRAM) >> _BITS << _BITS) | gram_at.astype(np.uint64)
    anchor = (_sliding_min(lead, WINDOW)[: n - length + 1] & _PLACE).astype(np.int64)
    p = np.arange(n - length + 1)
    text = np.searchsorted(ends, p, side="right")
    ok = p + length <= ends[np.minimum(text, len(ends) - 1)]
    p, text, anchor = p[ok], text[ok], anchor[ok]
    if not len(p):
        return none, none, none
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    lo, hi = p[new], p[np.r_[new[1:], len(p)] - 1]
    return lo, hi - lo + 1, anchor[new] - lo


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, offset, bytes) in groups of bounded size; a long text gives overlapping segments."""
    which, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[s : s + SEGMENT + length - 1]
            if size + len(part) > 2 * SEGMENT:
                yield which, offsets, parts
                which, offsets, parts, size = [], [], [], 0
            which.append(i)
            offsets.append(s)
            parts.append(part)
            size += len(part)
    if parts:
        yield which, offsets, parts


def find_blocks(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a unit's texts, first starts counted from the unit's beginning."""
    begins = np.cumsum([0] + [len(t) for t in texts])
    found = [(np.zeros(0, np.int64),) * 3]
    for which, offsets, parts in _segments(texts, length):
        ends = np.cumsum([len(p) for p in parts])
        lo, n, off = blocks(np.frombuffer(b"".join(parts), np.uint8), ends, length)
        at = np.searchsorted(ends, lo, side="right")
        found.append((lo - np.r_[0, ends][at] + np.asarray(offsets)[at] + begins[np.asarray(which)[at]], n, off))
    lo, n, off = (np.concatenate(c) for c in zip(*found, strict=True))
    return lo, n, off


def offsets_of(length: int) -> list[int]:
    """The lengths of the strings that anchors are ranked by, each at most twice the one before."""
    reach = length - WINDOW + 1
    out = [max(1, reach // 4)]
    while out[-1] < reach:
        out.append(min(reach, 2 * out[-1]))
    return out


_ROW = pa.struct([("doc_id", pa.int64()), ("packed", pa.binary())])
_UNITS = "unit long, bytes long, rows array<struct<doc_id:long,packed:binary>>, places binary"


def _to_units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    unit = TaskContext.get().partitionId() << 32
    for batch, texts in text_batches(batches, "text", UNIT):
        lo, n, off = find_blocks(texts, length)
        rows = pa.StructArray.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], fields=list(_ROW))
        places = press.compress(np.diff(lo, prepend=0).astype(np.int32).tobytes() + n.astype(np.uint8).tobytes() + off.astype(np.uint8).tobytes())
        columns = [pa.array([unit], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows), pa.array([places], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "bytes", "rows", "places"])
        unit += 1


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the first item of each distinct pair, in the order of pairs; how often each stands; each item's pair)."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    pair = np.empty(len(a), np.int64)
    pair[order] = group
    return order[new], np.bincount(group), pair


class Unit:
    """A unit's texts end to end, its blocks, and what the buckets answered so far."""

    def __init__(self, row: dict, length: int):
        unpack = zstandard.ZstdDecompressor()
        self.id, self.length, self.offsets = row["unit"], length, offsets_of(length)
        self.docs = [r["doc_id"] for r in row["rows"]]
        self.texts = [unpack.decompress(r["packed"]) for r in row["rows"]]
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        places = unpack.decompress(row["places"])
        k = len(places) // 6
        self.lo = np.cumsum(np.frombuffer(places, np.int32, k), dtype=np.int64)
        self.n = np.frombuffer(places, np.uint8, k, 4 * k).astype(np.int64)
        self.anchor = self.lo + np.frombuffer(places, np.uint8, k, 5 * k)
        answers = sorted(row.get("answers") or [], key=lambda x: (x["round"], x["bucket"]))
        self.answers = {r: np.frombuffer(b"".join(unpack.decompress(x["flags"]) for x in answers if x["round"] == r), np.uint8) for r in {x["round"] for x in answers}}
        self.prints: dict[tuple[int, int], Prints] = {}

    def names(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprints of stretches in ascending order, read segment by segment."""
        out = np.zeros(len(start), np.uint64)
        if not len(start):
            return out
        for s in range(int(start[0]) // SEGMENT, int(start[-1]) // SEGMENT + 1):
            lo, hi = np.searchsorted(start, [s * SEGMENT, (s + 1) * SEGMENT])
            if lo == hi:
                continue
            if (s, which) not in self.prints:
                if len(self.prints) >= _KEPT:
                    self.prints.clear()
                self.prints[s, which] = Prints(self.raw[s * SEGMENT : (s + 1) * SEGMENT + 2 * WINDOW + 2 * self.length], which)
            out[lo:hi] = self.prints[s, which](start[lo:hi] - s * SEGMENT, end[lo:hi] - s * SEGMENT)
        return out

    def ranks(self, k: int, alive: np.ndarray) -> np.ndarray:
        """The ranks of anchors in round k: at first of their bytes, then pairs of ranks at an offset."""
        a, m = self.anchor[alive], self.offsets[k]
        if k == 0:
            return self.names(a, a + m)
        h = self.offsets[k - 1]
        return mix64(self.names(a, a + h) * _STEP + self.names(a + (m - h), a + m))

    def flags(self, number: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The answers of a round to each item, and whether it is the one that was told of its like."""
        first, _, pair = _distinct(a, b)
        told = np.zeros(len(a), bool)
        told[first] = True
        return self.answers.get(number, np.zeros(0, np.uint8))[pair], told

    def items(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """What the unit tells in a round: pairs of 64 bits. Sets what earlier rounds decided: `whole` blocks,
        `starts` that are told apart singly."""
        alive = np.arange(len(self.lo))
        for k in range(len(self.offsets)):
            a = self.ranks(k, alive)
            b = np.zeros(len(a), np.uint64)
            if k == number:
                return a, b
            alive = alive[self.flags(k, a, b)[0] > 0]
        a = self.ranks(len(self.offsets) - 1, alive)
        lo, n, off = self.lo[alive], self.n[alive], self.anchor[alive] - self.lo[alive]
        b = mix64(self.names(lo, lo + n - 1 + self.length, 1) + (off * 256 + n).astype(np.uint64))
        k = len(self.offsets)
        if k == number:
            return a, b
        flags, told = self.flags(k, a, b)
        self.whole = alive[flags & 1 > 0]
        lo, n = lo[told & (flags & 2 > 0)], n[told & (flags & 2 > 0)]
        self.starts = np.unique(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return self.names(self.starts, self.starts + self.length), self.names(self.starts, self.starts + self.length, 1)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs (start, end) that the repeating strings cover, within the unit."""
        a, b = self.items(len(self.offsets) + 1)
        single = self.starts[self.flags(len(self.offsets) + 1, a, b)[0] > 0]
        lo = np.concatenate([self.lo[self.whole], single])
        hi = np.concatenate([self.lo[self.whole] + self.n[self.whole] - 1, single]) + self.length
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        if not len(lo):
            return lo, hi
        # runs of two texts that meet at their border stay two
        text = np.searchsorted(np.cumsum([len(t) for t in self.texts]), lo, side="right")
        hi = np.maximum.accumulate(hi)
        new = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (text[1:] != text[:-1])])
        return lo[new], hi[np.r_[new[1:], len(lo)] - 1]


_TOLD = "bucket int, unit long, a binary, b binary, counts binary"


def _read_units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Unit]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Unit(batch.slice(i, 1).to_pylist()[0], length)
    give_back()


def _tell(batches: Iterator[pa.RecordBatch], number: int, length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that a unit has distinct items for: the items in order, and whether one item of
    the unit stands there or more. Rounds that only drop tell four bytes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    dropping = number < len(offsets_of(length))
    for unit in _read_units(batches, length):
        a, b = unit.items(number)
        first, counts, _ = _distinct(a, b)
        a, b = a[first], b[first]
        at = np.r_[0, np.searchsorted(a, edges), len(a)]
        some = pa.array(np.flatnonzero(np.diff(at)), pa.int32())
        if dropping:
            a, b = a.astype(np.uint32), b[:0]
        cells = [(a.itemsize, a), (0 if dropping else 8, b), (1, np.minimum(counts, 2).astype(np.uint8))]
        parts = [pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer((at * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]).take(some) for w, x in cells]
        yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), unit.id), pa.int64()), *parts], names=["bucket", "unit", "a", "b", "counts"])


def _answer(t: pa.Table, number: int, length: int) -> pa.Table:
    """A bucket's flags for each unit's items. Rounds that drop, and the last: 1 if the item stands twice or
    more. Extents: 1 if rank and extent do, 2 if some extent of the rank stands once and this is the first
    of its own."""
    press = zstandard.ZstdCompressor(level=1)
    rounds = len(offsets_of(length))
    read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(c)]
    told = read("a", np.uint32 if number < rounds else np.uint64)
    a = np.concatenate(told)
    b = np.concatenate(read("b", np.uint64)) if number >= rounds else np.zeros(len(a), np.uint64)
    first, _, pair = _distinct(a, b)
    twice = np.bincount(pair, np.concatenate(read("counts", np.uint8))) > 1
    flags = twice[pair].astype(np.uint8)
    if number == rounds:
        _, _, rank = _distinct(a, np.zeros(len(a), np.uint64))
        open_ = np.zeros(rank.max() + 1, bool)
        open_[rank[~twice[pair]]] = True
        flags[first] |= 2 * open_[rank[first]].astype(np.uint8)
    ends = np.cumsum([len(x) for x in told])
    cells = [press.compress(flags[e - len(x) : e].tobytes()) for e, x in zip(ends, told, strict=True)]
    return pa.table({"round": pa.array([number] * len(cells), pa.int32()), "unit": t.column("unit"), "bucket": t.column("bucket"), "flags": pa.array(cells, pa.binary())})


def _answering(number: int, length: int) -> Callable[[pa.Table], pa.Table]:
    def answer(t: pa.Table) -> pa.Table:
        return _answer(t, number, length)

    return answer


_ANSWERS = "round int, unit long, bucket int, flags binary"


def _results(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "n_bytes", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
    for unit in _read_units(batches, length):
        lo, hi = unit.repeats()
        rows, begin = [], 0
        for doc, text in zip(unit.docs, unit.texts, strict=True):
            i, j = np.searchsorted(lo, [begin, begin + len(text)])
            runs = np.stack([lo[i:j], hi[i:j]], 1) - begin
            edges = [0, *runs.ravel().tolist(), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            begin += len(text)
            if digest:
                rows.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            else:
                rows.append((doc, len(text), [{"start": s, "length": e - s} for s, e in runs.tolist()], kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _dedup(docs: DataFrame, length: int, digest: bool) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units, _ = shelve(texts.mapInArrow(functools.partial(_to_units, length=length), _UNITS))
    bits = min(17, max(4, ((units.agg(F.sum("bytes")).first()[0] or 0) // BUCKET).bit_length()))
    answers: DataFrame | None = None
    drops: list[Callable[[], object]] = []

    def known() -> DataFrame:
        if answers is None:
            return units
        per = answers.groupBy("unit").agg(F.collect_list(F.struct("round", "bucket", "flags")).alias("answers"))  # rounds times buckets
        return units.join(per, "unit", "left")

    for number in range(len(offsets_of(length)) + 2):
        told = known().mapInArrow(functools.partial(_tell, number=number, length=length, bits=bits), _TOLD)
        now, drop = shelve(told.groupBy("bucket").applyInArrow(_answering(number, length), _ANSWERS))
        answers = now if answers is None else answers.unionByName(now)
        drops.append(drop)
        sweep(docs.sparkSession)  # what was told goes before the next round
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
    return known().mapInArrow(functools.partial(_results, length=length, digest=digest), schema)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (the removed runs, in bytes) and kept (the rest) of every row."""
    return _dedup(docs, length, False)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(table(spark, sf_dir, "documents"), LENGTH, True)
