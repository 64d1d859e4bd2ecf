"""Operator 4: progressive JPEG columns.

A payload of bytes is stored without loss as the format's own unit, the quantised coefficient: byte b
is coefficient b - 128, 64 to a block, 192 bytes to three blocks, two such units to a 4:2:0 MCU
(the last one filled up with zero blocks). The quantisation table is all ones and a comment segment
keeps the payload's length. The image is written progressively: DC and AC bands (spectral selection)
with their low bit left for refinement scans (successive approximation), Huffman coded, in restart
intervals.

Reading parses any such file, accumulates its scans into coefficient arrays, and from those gets the
payload back, or pixels: dequantised, inverse-transformed in numpy, chroma upsampled to full
resolution, converted to an RGB tensor. Entropy coding is serial within a restart interval, so both
directions work on all intervals of a batch of files at once, one symbol of each at a time.

Defined results: null text is empty; an empty text is padded like any other; repeated rows give equal
values; an empty table gives no rows; other columns are left out. Batches are bounded by bytes, a
text longer than a batch is a batch of its own."""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shelve, table, text_batches

UNIT = 192
RESTART = 8
BATCH_BYTES = 3_000_000
#: Parts of the documents that `digests` stores one after the other.
PARTS = 4
#: Fixed values of the format: coefficients in zigzag order, row by row.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: (components, first coefficient, last, high bit, low bit) of the scans written.
SCRIPT = ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 1, 0)
DC_SYMBOLS = list(range(12))
AC_SHORT = [0x00, *range(0x01, 0x08)]
AC_LONG = [x for x in range(256) if x & 15 <= 8 and x not in AC_SHORT]
SAMPLING = ((2, 2), (1, 1), (1, 1))


def _huffman(lengths: dict[int, list[int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(DHT body, code by symbol, length by symbol) of the canonical code."""
    codes, sizes, code = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0
    for n in range(1, 17):
        for s in lengths.get(n, ()):
            codes[s], sizes[s] = code, n
            code += 1
        code <<= 1
    return bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in lengths.get(n, ())), codes, sizes


DC_BODY, DC_CODE, DC_SIZE = _huffman({4: DC_SYMBOLS})
AC_BODY, AC_CODE, AC_SIZE = _huffman({4: AC_SHORT, 9: AC_LONG})
_AC_CODE32, _AC_SIZE8 = AC_CODE.astype(np.uint32), AC_SIZE.astype(np.uint8)


# ------------------------------------------------------------------ writing


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float32))[1].astype(np.int64)


def _with_bits(code: np.ndarray, size: np.ndarray, value: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code followed by the format's form of a signed value in so many bits."""
    low = np.where(value >= 0, value, value + (1 << bits) - 1).astype(np.uint64)
    return (code << bits.astype(np.uint64)) | low, size + bits


#: By value + 256: bits of its magnitude, and the form those bits take.
_VALUE = np.arange(-256, 256)
_BITS = _bit_length(np.abs(_VALUE)).astype(np.uint8)
_LOW = np.where(_VALUE >= 0, _VALUE, _VALUE + (1 << _BITS.astype(np.int64)) - 1).astype(np.uint32)


def _ac_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths, a column for each coefficient and one for the end of block."""
    n, width = c.shape
    at = np.arange(width, dtype=np.int8)
    there = c != 0
    before = np.maximum.accumulate(np.where(there, at, np.int8(-1)), axis=1)
    run = np.empty((n, width), np.int8)
    run[:, 0] = 0
    np.subtract(at[1:] - np.int8(1), before[:, :-1], out=run[:, 1:])
    index = c + np.int16(256)
    bits = _BITS[index]
    symbol = ((run.view(np.uint8) & np.uint8(15)) << np.uint8(4)) | bits
    code = np.zeros((n, width + 1), np.uint64)
    size = np.zeros((n, width + 1), np.uint8)
    code[:, :-1] = (_AC_CODE32[symbol] << bits) | _LOW[index]
    size[:, :-1] = (_AC_SIZE8[symbol] + bits) * there
    for times in range(1, 4):
        long = there & (run >= 16 * times)
        if not long.any():
            break
        r, k = np.nonzero(long)
        code[r, k] |= AC_CODE[0xF0] << size[r, k].astype(np.uint64)
        size[r, k] += _AC_SIZE8[0xF0]
    open_ = before[:, -1] < width - 1
    code[:, -1] = AC_CODE[0]
    size[:, -1] = np.where(open_, _AC_SIZE8[0], 0)
    return code, size


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last bit of coefficients. A symbol opens each stretch up to and with a coefficient that
    becomes nonzero; the old ones' bits follow it in place."""
    n, width = c.shape
    at = np.arange(width)
    mag = np.abs(c)
    old, new = mag >= 2, mag == 1
    zero = ~old & ~new
    zeros = np.cumsum(zero, axis=1)
    opens = np.concatenate([np.ones((n, 1), bool), new[:, :-1]], axis=1)
    ends = np.minimum.accumulate(np.where(new, at, width)[:, ::-1], axis=1)[:, ::-1]
    to = np.minimum(ends, width - 1)
    run = np.take_along_axis(zeros, to, axis=1) - zeros + zero
    sign = np.take_along_axis(c > 0, to, axis=1)
    closing = ends == width
    many = opens & ~closing & (run > 15)
    symbol = np.where(closing, 0, (np.minimum(run, 15) << 4) | 1)
    code = np.where(closing, AC_CODE[symbol], (AC_CODE[symbol] << np.uint64(1)) | sign.astype(np.uint64))
    size = AC_SIZE[symbol] + ~closing
    code, size = np.where(opens, code, 0).astype(np.uint64), np.where(opens, size, 0)
    code = np.where(old, (code << np.uint64(1)) | (mag & 1).astype(np.uint64), code)
    size = size + old
    if many.any():  # runs that need more symbols, rare: written block by block
        for b in np.flatnonzero(many.any(axis=1)):
            code[b], size[b] = _refine_block(c[b])
    return code, size


def _refine_block(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _ac_refine for one block, with symbols for 16 zeros where a run is longer."""
    width = len(c)
    code, size = np.zeros(width, np.uint64), np.zeros(width, np.int64)
    start = 0
    while start < width:
        zeros, stop, symbol, sign = 0, width, 0x00, None
        for k in range(start, width):
            if abs(c[k]) == 1:
                stop, symbol, sign = k + 1, zeros << 4 | 1, int(c[k] > 0)
                break
            if c[k] == 0:
                zeros += 1
                if zeros == 16 and (np.abs(c[k + 1 :]) == 1).any():
                    stop, symbol = k + 1, 0xF0
                    break
        code[start], size[start] = AC_CODE[symbol], AC_SIZE[symbol]
        if sign is not None:
            code[start], size[start] = code[start] << np.uint64(1) | np.uint64(sign), size[start] + 1
        for k in range(start, stop):
            if abs(c[k]) >= 2:
                code[k], size[k] = code[k] << np.uint64(1) | np.uint64(abs(int(c[k])) & 1), size[k] + 1
        start = stop
    return code, size


def _pack(code: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of codes, and where each interval begins; `first`: the rows that begin one.
    Each interval is filled up with ones to whole bytes."""
    per_row = size.sum(axis=1, dtype=np.int64)
    fill = -np.add.reduceat(per_row, first) % 8
    last = np.r_[first[1:], len(size)] - 1
    begins = np.r_[0, np.cumsum(np.add.reduceat(per_row, first) + fill)]
    some = size.ravel() > 0
    if some.all():
        flat, n = code.ravel(), size.ravel().astype(np.int64)
    else:
        flat, n = code.ravel()[some], size.ravel()[some].astype(np.int64)
    if not len(n):
        return np.zeros(0, np.uint8), begins[:-1] // 8
    # the fill is part of an interval's last code
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(size)])), np.count_nonzero(size, axis=1)).astype(np.int64)) - 1
    flat[ends] = (flat[ends] << fill.astype(np.uint64)) | ((1 << fill) - 1).astype(np.uint64)
    n[ends] += fill
    end = np.cumsum(n)
    at = end - n
    word, room = at >> 6, 64 - (at & 63) - n
    k = np.flatnonzero(room < 0)
    here = flat << np.maximum(room, 0).astype(np.uint64)
    here[k] = flat[k] >> (-room[k]).astype(np.uint64)
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] = np.bitwise_or.reduceat(here, starts)
    out[word[k] + 1] |= flat[k] << (64 + room[k]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[: int(end[-1]) // 8], begins[:-1] // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 192 bytes)."""
    units = np.array([len(p) // UNIT for p in payloads])
    mcus = -(-units // 2)
    cols = np.maximum(1, np.ceil(np.sqrt(mcus)).astype(np.int64))
    rows = -(-mcus // cols)
    total = cols * rows
    at = np.r_[0, np.cumsum(total)]
    c = np.zeros((int(at[-1]), 6, 64), np.int16)
    for i, p in enumerate(payloads):
        c[at[i] : at[i + 1]].reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
    within = np.arange(at[-1]) - np.repeat(at[:-1], total)
    # luma blocks go from MCU order to rows of blocks
    col, row = within % np.repeat(cols, total), within // np.repeat(cols, total)
    wide = np.repeat(2 * cols, total)
    place = 4 * np.repeat(at[:-1], total)[:, None] + (2 * row[:, None] + np.array([0, 0, 1, 1])) * wide[:, None] + 2 * col[:, None] + np.array([0, 1, 0, 1])
    luma = np.empty((4 * int(at[-1]), 64), np.int16)
    luma[place.ravel()] = c[:, :4].reshape(-1, 64)
    planes = (luma, c[:, 4], c[:, 5])
    scans: list[list[bytes]] = [[] for _ in payloads]
    for comps, ss, se, ah, al in SCRIPT:
        per = total if len(comps) > 1 else total * (4 if comps[0] == 0 else 1)
        begin = np.r_[0, np.cumsum(per)]
        nth = np.arange(begin[-1]) - np.repeat(begin[:-1], per)
        first = np.flatnonzero(nth % RESTART == 0)
        if ss == 0 and ah == 0:
            v = (c[:, :, 0] >> al).astype(np.int64)
            prev = np.zeros_like(v)
            prev[:, 1:4] = v[:, :3]
            prev[1:, 0], prev[1:, 4], prev[1:, 5] = v[:-1, 3], v[:-1, 4], v[:-1, 5]
            prev[np.ix_(first, [0, 4, 5])] = 0
            d = v - prev
            bits = _bit_length(np.abs(d))
            code, size = _with_bits(DC_CODE[bits], DC_SIZE[bits], d, bits)
        elif ss == 0:
            code = ((c[:, :, 0] >> al) & 1).astype(np.uint64)
            size = np.ones(code.shape, np.int64)
        else:
            x = planes[comps[0]][:, ss : se + 1]
            code, size = _ac_first(np.sign(x) * (np.abs(x) >> al)) if ah == 0 else _ac_refine(x)
        data, starts = _pack(code, size, first)
        del code, size
        # stuffing after each 0xFF, a restart marker between the intervals of a file
        opens = nth[first] == 0
        stuffed = np.flatnonzero(data == 0xFF) + 1
        inner = np.flatnonzero(~opens)
        marks = 0xD0 + (nth[first[inner]] // RESTART - 1) % 8
        where = np.concatenate([stuffed, np.repeat(starts[inner], 2)])
        what = np.concatenate([np.zeros(len(stuffed), np.uint8), np.stack([np.full(len(inner), 0xFF), marks], 1).ravel().astype(np.uint8)])
        order = np.argsort(where, kind="stable")
        where, what = where[order], what[order]
        file_at = starts[np.flatnonzero(opens)]
        # what stands at a file's first byte belongs to the file before
        file_at = file_at + np.searchsorted(where, file_at, side="right")
        data = np.insert(data, where, what).tobytes()
        tables = [_segment(0xC4, bytes([0x10 * (ss > 0)]) + (AC_BODY if ss else DC_BODY))] if not (ss == 0 and ah) else []
        head = b"".join(tables) + _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([k + 1, 0]) for k in comps) + bytes([ss, se, ah << 4 | al]))
        for i, (s, e) in enumerate(zip(file_at.tolist(), [*file_at[1:].tolist(), len(data)], strict=True)):
            scans[i] += (head, data[s:e])
    fixed = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xDD, struct.pack(">H", RESTART))
    frame = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(SAMPLING))
    out = []
    for i, p in enumerate(payloads):
        sof = _segment(0xC2, struct.pack(">BHHB", 8, 16 * int(rows[i]), 16 * int(cols[i]), 3) + frame)
        out.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + fixed + sof + b"".join(scans[i]) + b"\xff\xd9")
    return out


# ------------------------------------------------------------------ reading


def parse(data: bytes) -> dict:
    """Frame, tables and scans of a progressive file: a scan is its parameters, tables and bytes."""
    out: dict = {"scans": [], "payload": None, "quant": {}}
    tables: dict[int, bytes] = {}
    restart, at = 0, 2
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marks = ff[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))].tolist()
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            return out
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE and body.startswith(b"payload "):
            out["payload"] = int(body[8:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + size :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]] = body[1:size]
                body = body[size:]
        elif marker == 0xC2:
            _, out["height"], out["width"], k = struct.unpack_from(">BHHB", body)
            out["components"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            ids = {c[0]: i for i, c in enumerate(out["components"])}
            comps = tuple(ids[body[1 + 2 * i]] for i in range(body[0]))
            which = [body[2 + 2 * i] for i in range(body[0])]
            ss, se, bits = body[-3:]
            used = tuple(tables.get(w >> 4 if ss == 0 else 0x10 | w & 15, b"") if not (ss == 0 and bits >> 4) else b"" for w in which)
            nth = bisect.bisect_left(marks, at)
            end = marks[nth] if nth < len(marks) else len(data)
            out["scans"].append(((comps, ss, se, bits >> 4, bits & 15, used, restart), data[at:end]))
            at = end
    return out


@functools.lru_cache(maxsize=64)
def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each 16 bits that may come."""
    symbol, size, at, code = np.zeros(65536, np.int64), np.full(65536, 16, np.int64), 16, 0
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lo = code << (16 - n)
            symbol[lo : lo + (1 << (16 - n))], size[lo : lo + (1 << (16 - n))] = body[at], n
            at, code = at + 1, code + 1
        code <<= 1
    return symbol, size


class _Lanes:
    """The restart intervals of one scan of many files, read side by side."""

    def __init__(self, datas: list[bytes], units: np.ndarray, restart: int):
        raw = np.frombuffer(b"".join(datas) + b"\0" * 16, np.uint8)
        begins = np.r_[0, np.cumsum([len(d) for d in datas])[:-1]].astype(np.int64)
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        keep = np.ones(len(raw), bool)
        keep[ff[after == 0] + 1] = False
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep[marks] = keep[marks + 1] = False
        kept = np.r_[0, np.cumsum(keep)]
        starts = np.sort(np.concatenate([begins, marks + 2]))
        self.file = np.searchsorted(begins, starts, side="right") - 1
        nth = np.arange(len(starts)) - np.searchsorted(self.file, self.file)
        self.first = nth * restart
        left = units[self.file] - self.first
        self.count = np.minimum(left, restart) if restart else left
        buf = np.concatenate([raw[keep], np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(buf) - 8
        w = np.zeros(n, np.uint64)
        for i in range(8):
            w |= buf[i : n + i] << np.uint64(56 - 8 * i)
        self.words, self.pos = w, kept[starts].astype(np.int64) * 8

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 57 bits and more, at the top."""
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)


def _top(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits."""
    return ((x >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _signed(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n) >> 1, bits - (1 << n) + 1, bits)


def _read_dc(lanes: _Lanes, coef: np.ndarray, blocks, pattern: list[int], tables: tuple, ah: int, al: int) -> None:
    """blocks(lane's MCU number, index in the MCU) names the block; pattern: the component of each index."""
    pred = np.zeros((len(set(pattern)), len(lanes.pos)), np.int64)
    order = {c: i for i, c in enumerate(dict.fromkeys(pattern))}
    pos = lanes.pos
    for m in range(int(lanes.count.max(initial=0))):
        live = np.flatnonzero(lanes.count > m)
        for j, comp in enumerate(pattern):
            p = pos[live]
            x = lanes.peek(p)
            at = blocks(live, lanes.first[live] + m, j)
            if ah:
                coef[at, 0] |= ((x >> np.uint64(63)).astype(np.int64) << al).astype(np.int16)
                pos[live] = p + 1
                continue
            symbol, size = _lookup(tables[order[comp]])
            key = (x >> np.uint64(48)).astype(np.int64)
            s, n = symbol[key], size[key]
            d = np.where(s > 0, _signed(_top(x << n.astype(np.uint64), s), s), 0)
            pred[order[comp], live] += d
            coef[at, 0] = (pred[order[comp], live] << al).astype(np.int16)
            pos[live] = p + n + s


@functools.lru_cache(maxsize=64)
def _whole(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each 16 bits that may come: bits of symbol and value together (0 if they may be more than
    16), the value, the coefficients passed, and the blocks ended."""
    symbol, size = _lookup(body)
    s, r = symbol & 15, symbol >> 4
    ends = (s == 0) & (r < 15)
    more = np.where(ends, r, s)
    left = np.maximum(16 - size - more, 0)
    bits = (np.arange(65536) >> left) & ((1 << more) - 1)
    fits = size + more <= 16
    value = np.where(s > 0, _signed(bits, s), 0)
    return np.where(fits, size + more, 0).astype(np.int32), value.astype(np.int16), (r + 1).astype(np.int32), np.where(ends, (1 << r) + bits, 0).astype(np.int32)


def _read_ac_first(lanes: _Lanes, coef: np.ndarray, blocks, body: bytes, ss: int, se: int, al: int) -> None:
    bits, value, passed, ended = _whole(body)
    symbol, size = _lookup(body)
    flat = coef.reshape(-1)
    lane = np.flatnonzero(lanes.count > 0)
    pos, first, left = lanes.pos[lane].astype(np.int32), lanes.first[lane].copy(), lanes.count[lane].copy()
    at = (blocks(lane, first) * 64).astype(np.int32)
    k = np.full(len(lane), ss, np.int32)
    while len(lane):
        x = lanes.peek(pos)
        key = (x >> np.uint64(48)).astype(np.int32)
        n, v, go, end = bits[key], value[key], passed[key], ended[key]
        if not n.all():
            for i in np.flatnonzero(n == 0):
                m, s, r = int(size[key[i]]), int(symbol[key[i]]) & 15, int(symbol[key[i]]) >> 4
                more = s or r
                raw = (int(x[i]) << m & 0xFFFFFFFFFFFFFFFF) >> (64 - more)
                n[i], v[i], end[i] = m + more, (raw if raw >> (s - 1) else raw - (1 << s) + 1) if s else 0, 0 if s else (1 << r) + raw
        to = at + k + (go - 1)
        if v.all():
            flat[to] = v << al if al else v
        else:
            put = np.flatnonzero(v)
            flat[to[put]] = v[put] << al
        pos += n
        k += go
        over = (k > se) | (end > 0)
        if over.any():
            o = np.flatnonzero(over)
            by = np.maximum(end[o], 1)
            left[o] -= by
            first[o] += by
            k[o] = ss
            if (left[o] <= 0).any():
                stay = left > 0
                lane, pos, first, left, at, k, over = (a[stay] for a in (lane, pos, first, left, at, k, over))
                o = np.flatnonzero(over)
            at[o] = blocks(lane[o], first[o]) * 64


def _read_ac_refine(lanes: _Lanes, coef: np.ndarray, blocks, body: bytes, ss: int, se: int, al: int) -> None:
    symbol, size = _lookup(body)
    flat = coef.reshape(-1)
    lane = np.flatnonzero(lanes.count > 0)
    pos, first, left = lanes.pos[lane], lanes.first[lane].copy(), lanes.count[lane].copy()
    at = blocks(lane, first) * 64
    k, skip = np.full(len(lane), ss), np.zeros(len(lane), np.int64)
    # zeros still to pass, the value to place, whether a symbol is due
    run, value, due = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.ones(len(lane), bool)
    bit = 1 << al
    while len(lane):
        x = lanes.peek(pos)
        ask = due & (skip == 0)
        key = (x >> np.uint64(48)).astype(np.int64)
        n = np.where(ask, size[key], 0)
        sym = symbol[key]
        s, r = sym & 15, sym >> 4
        ends = ask & (s == 0) & (r < 15)
        more = np.where(ends, r, np.where(ask & (s > 0), 1, 0))
        y = x << n.astype(np.uint64)
        bits = _top(y, more)
        skip = np.where(ends, (1 << np.where(ends, r, 0)) + bits, skip)
        run = np.where(ask, r, run)
        value = np.where(ask, np.where(s > 0, np.where(bits > 0, bit, -bit), 0), value)
        due = due & ~ask
        y = y << more.astype(np.uint64)
        here = flat[at + k]
        old = here != 0
        fix = (y >> np.uint64(63)).astype(np.int64)
        pos = pos + n + more + old
        idle = skip > 0
        place = ~old & ~idle & (run == 0)
        change = np.where(old, fix * np.where(here > 0, bit, -bit), np.where(place, value, 0))
        flat[at + k] = here + change.astype(np.int16)
        run = np.where(~old & ~idle & ~place, run - 1, run)
        due = due | place
        k = k + 1
        over = k > se
        skip = np.where(over & idle, skip - 1, skip)
        due = due | over
        if over.any():
            left = left - over
            k = np.where(over, ss, k)
            first = first + over
            stay = left > 0
            if not stay.all():
                lane, pos, first, left, at, k, skip, run, value, due, over = (a[stay] for a in (lane, pos, first, left, at, k, skip, run, value, due, over))
            o = np.flatnonzero(over)
            at[o] = blocks(lane[o], first[o]) * 64


class Image:
    """Coefficients of one file by component, rows of blocks in zigzag order, and what else it says."""

    def __init__(self, head: dict, planes: list[np.ndarray]):
        self.head, self.planes = head, planes

    def payload(self) -> bytes:
        """The bytes stored by `encode`."""
        luma, cb, cr = self.planes
        rows, cols = cb.shape[:2]
        y = luma.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows * cols, 4, 64)
        c = np.concatenate([y, cb.reshape(-1, 1, 64), cr.reshape(-1, 1, 64)], axis=1)
        return (c.reshape(-1)[: self.head["payload"]] + 128).astype(np.uint8).tobytes()

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor, height by width by 3."""
        return tensors_of([self])[0]


def tensors_of(images: list[Image]) -> list[np.ndarray]:
    """Full-resolution RGB tensors; the blocks of all images are inverse-transformed at once.

    The transform has integer factors (1,024ths), and its sums stay where floating point holds integers
    exactly, so a tensor does not depend on the batch, the processor or the order of its sums."""
    blocks = [p.reshape(-1, 64) * m.head["quant"][q].astype(np.int16) if (m.head["quant"][q] != 1).any() else p.reshape(-1, 64) for m in images for (_, _, _, q), p in zip(m.head["components"], m.planes, strict=True)]
    if blocks:
        coef = np.concatenate(blocks)
        kind = np.float32 if int(np.abs(coef).max(initial=0)) * _GAIN < 1 << 24 else np.float64
        pixels = (np.clip(coef.astype(kind) @ _INVERSE.astype(kind), -(1 << 24), (1 << 24) - 1).astype(np.int32) + 512) >> 10
    else:
        pixels = np.zeros((0, 64), np.int32)
    out, at = [], 0
    for m in images:
        head, full = m.head, []
        h_max, v_max = max(c[1] for c in head["components"]), max(c[2] for c in head["components"])
        for (_, h, v, _), plane in zip(head["components"], m.planes, strict=True):
            rows, cols = plane.shape[:2]
            x = pixels[at : at + rows * cols].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            at += rows * cols
            full.append((x, v_max // v, h_max // h))
        up = lambda x, v, h: np.broadcast_to(x[:, None, :, None], (x.shape[0], v, x.shape[1], h)).reshape(x.shape[0] * v, x.shape[1] * h)
        y, *chroma = full
        y = up(*y) if y[1:] != (1, 1) else y[0]
        rgb = np.empty((*y.shape, 3), np.int32)
        y = y + 128
        if chroma:
            # what chroma adds is worked out before it is upsampled: 1.402, 0.344136, 0.714136 and 1.772, in 65,536ths
            (cb, *f), (cr, *g) = chroma
            share = lambda x: (x + 32768) >> 16
            rgb[:, :, 0] = y + up(share(91881 * cr), *g)
            rgb[:, :, 1] = y - up(share(22553 * cb + 46802 * cr), *f) if f == g else y - up(share(22553 * cb), *f) - up(share(46802 * cr), *g)
            rgb[:, :, 2] = y + up(share(116130 * cb), *f)
        else:
            rgb[:] = y[:, :, None]
        np.clip(rgb, 0, 255, out=rgb)
        out.append(rgb.astype(np.uint8)[: head["height"], : head["width"]])
    return out


def _inverse() -> np.ndarray:
    """Coefficients in zigzag order times this are pixels, times 1,024."""
    x = np.arange(8)
    a = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    return np.round(1024 * np.einsum("xu,yv->uvxy", a, a).reshape(64, 64)[ZIGZAG])


_INVERSE = _inverse()
#: A pixel's sum is at most the largest coefficient times this.
_GAIN = int(np.abs(_INVERSE).sum(0).max())


def decode(files: list[bytes]) -> list[Image]:
    """Reads files; those with the same frame and scan layout are read side by side."""
    heads = [parse(f) for f in files]
    alike = defaultdict(list)
    for i, h in enumerate(heads):
        alike[(tuple(h["components"]), tuple(s[0] for s in h["scans"]))].append(i)
    out: list[Image | None] = [None] * len(files)
    for (components, scans), members in alike.items():
        own = [heads[i] for i in members]
        h_max, v_max = max(c[1] for c in components), max(c[2] for c in components)
        width, height = np.array([h["width"] for h in own]), np.array([h["height"] for h in own])
        across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
        wide = [across * c[1] for c in components]
        sizes = np.array([w * down * c[2] for w, c in zip(wide, components, strict=True)])
        base = (np.cumsum(sizes.T.ravel()) - sizes.T.ravel()).reshape(len(own), len(components)).T
        coef = np.zeros((int(sizes.sum()), 64), np.int16)
        for number, (comps, ss, se, ah, al, tables, restart) in enumerate(scans):
            datas = [h["scans"][number][1] for h in own]
            if len(comps) > 1:
                lanes = _Lanes(datas, across * down, restart)
                pattern = [(c, y, x) for c in comps for y in range(components[c][2]) for x in range(components[c][1])]

                def blocks(lane, mcu, j, lanes=lanes, pattern=pattern):
                    c, y, x = pattern[j]
                    f = lanes.file[lane]
                    return base[c][f] + (mcu // across[f] * components[c][2] + y) * wide[c][f] + mcu % across[f] * components[c][1] + x

                _read_dc(lanes, coef, blocks, [c for c, _, _ in pattern], tables, ah, al)
                continue
            c = comps[0]
            # alone, a component has no blocks beyond the image's own edge
            cols = -(-(-(-width * components[c][1] // h_max)) // 8)
            rows = -(-(-(-height * components[c][2] // v_max)) // 8)
            lanes = _Lanes(datas, cols * rows, restart)

            def one(lane, n, j=0, lanes=lanes, c=c, cols=cols):
                f = lanes.file[lane]
                return base[c][f] + n // cols[f] * wide[c][f] + n % cols[f]

            if ss == 0:
                _read_dc(lanes, coef, one, [c], tables, ah, al)
            else:
                (_read_ac_refine if ah else _read_ac_first)(lanes, coef, one, tables[0], ss, se, al)
        for k, i in enumerate(members):
            planes = [coef[base[c][k] : base[c][k] + sizes[c][k]].reshape(-1, wide[c][k], 64) for c in range(len(components))]
            out[i] = Image(heads[i], planes)
    return out


# ------------------------------------------------------------------ columns


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, "text", BATCH_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a progressive JPEG."""
    return docs.select("doc_id", "text").mapInArrow(_to_media, "doc_id long, n_bytes long, media binary")


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and checksum of a tensor."""
    means = rgb.reshape(-1, 3).astype(np.int64).sum(0) * 1000 // (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3 mean/1000 {','.join(map(str, means.tolist()))} crc {zlib.crc32(rgb.tobytes())}"


_TENSORS = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary"


def _to_tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, files in text_batches(batches, "media", BATCH_BYTES):
        images = decode(files)
        tensors = tensors_of(images)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([m.payload() for m in images], pa.binary()), pa.array([t.shape[0] for t in tensors], pa.int32()), pa.array([t.shape[1] for t in tensors], pa.int32()), pa.array([t.tobytes() for t in tensors], pa.binary())],
            names=["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"],
        )


def tensors(media: DataFrame) -> DataFrame:
    """Adds payload, height, width and the full-resolution RGB tensor (row by row) to (doc_id, n_bytes, media)."""
    return media.mapInArrow(_to_tensors, _TENSORS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch, files in text_batches(batches, "media", BATCH_BYTES):
        images = decode(files)
        p = [m.payload() for m in images]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(x) for x in p], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in p]), pa.array([zlib.crc32(x[-16:]) for x in p], pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([feature(t) for t in tensors_of(images)])],
            names=names,
        )


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """Digests of what `store` wrote to the shared folder and `decode` reads back from there. Media take up
    more room than their compressed texts, so a part of the documents at a time is written, read and
    dropped; what is left are the digests."""
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts))
    out = None
    for k in range(parts):
        written, drop = shelve(store(docs.where(part == k)))
        read, _ = shelve(written.mapInArrow(_digest, _DIGESTS))
        drop()
        out = read if out is None else out.unionByName(read)
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
