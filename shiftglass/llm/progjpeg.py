"""Media columns: progressive JPEG, decoded scan by scan into coefficient arrays.

The decoder reads any progressive (SOF2) 8-bit JPEG of one or three components: spectral
selection and successive approximation accumulate in coefficients, which are dequantised,
inverse-transformed in numpy, upsampled and turned into full-resolution RGB. Many images
are decoded at once: every restart interval is a lane, and all lanes of like scans advance
one symbol a step in array operations.

A payload of bytes is stored losslessly as coefficients, 64 bytes a block in zigzag order,
in a 4:2:0 image with unit quantisers.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ranges, slices, widened

RESTART = 8
MARK = b"payload "


def _zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


ZIGZAG = _zigzag()
UNZIGZAG = np.argsort(ZIGZAG)
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)

#: Symbols of the one Huffman table used for writing. Halved letters have six bits, blanks and digits five, so that
#: these get 1 and 2 bits, some others 6 and the rest 11: bytes of plain text then take little more than 8 bits.
FREQUENT = [0x06, 0x05, 0x00, 0x07, 0x04, 0x03, 0x02, 0x01, 0x16, 0x15]
SYMBOLS = FREQUENT + [x for x in range(256) if x not in FREQUENT and (x & 15) <= 10]
LENGTHS = [1, 2] + [6] * 8 + [11] * (len(SYMBOLS) - len(FREQUENT))


def huffman(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code by symbol, length by symbol, symbol << 8 | length by leading 16 bits)."""
    codes, lens, look, code, last = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16), 0, lengths[0] if lengths else 0
    for n, s in zip(lengths, symbols):
        code <<= n - last
        last = n
        codes[s], lens[s] = code, n
        look[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
        code += 1
    return codes, lens, look


CODE, CODE_BITS, _ = huffman(LENGTHS, SYMBOLS)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1]


# --------------------------------------------------------------------------- writing
def pack_bits(values: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> list[bytes]:
    """The bytes of each lane: its values' bits one after another, filled up with ones, FF stuffed."""
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = -(-total // 8)
    start = np.cumsum(size) - size
    # the filling ones follow a lane's last value
    ends = np.searchsorted(lane, np.arange(lanes), side="right")
    fill = 8 * size - total
    values, bits, lane = np.insert(values, ends, (1 << fill) - 1), np.insert(bits, ends, fill), np.insert(lane, ends, np.arange(lanes))
    at = np.cumsum(bits) - bits
    word, shift = at >> 5, (64 - (at & 31) - bits).astype(np.uint64)
    wide = np.where(bits > 0, values.astype(np.uint64) << np.minimum(shift, np.uint64(63)), np.uint64(0))
    out = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    raw = out.astype(">u4").view(np.uint8)[: int(size.sum())]
    full = np.flatnonzero(raw == 255)
    raw = np.insert(raw, full + 1, 0)
    edge = np.append(start, size.sum())
    edge = edge + np.searchsorted(full, edge)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and extra bits of signed values."""
    s = bit_length(v)
    return s, np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)


def write_dc(c: np.ndarray, lane: np.ndarray, high: int, low: int) -> tuple:
    v = c[:, 0] >> low
    if high:
        return (v & 1).astype(np.uint64), np.ones(len(v), np.int64), lane
    before = np.concatenate([[0], v[:-1]])
    before[np.flatnonzero(np.diff(lane, prepend=-1))] = 0
    s, extra = magnitude(v - before)
    return CODE[s] << s.astype(np.uint64) | extra, CODE_BITS[s] + s, lane


def write_ac_first(c: np.ndarray, lane: np.ndarray, first: int, last: int, low: int) -> tuple:
    part = c[:, first : last + 1]
    v = np.sign(part) * (np.abs(part) >> low)
    block, k = np.nonzero(v)
    v = v[block, k]
    new = np.diff(block, prepend=-1) > 0
    run = k - np.where(new, 0, np.concatenate([[0], k[:-1] + 1]))
    skips = run >> 4
    ends = np.full(len(c), -1)
    ends[block] = k  # of repeated indices the last one stays
    eob = ends < last - first
    before = np.concatenate([[0], np.cumsum(eob)])
    at = np.arange(len(block)) + np.cumsum(skips) + before[block]
    n = int(len(block) + skips.sum() + eob.sum())
    values, bits, owner = np.full(n, CODE[0xF0]), np.full(n, CODE_BITS[0xF0]), np.zeros(n, np.int64)
    s, extra = magnitude(v)
    symbol = (run & 15) << 4 | s
    values[at], bits[at] = CODE[symbol] << s.astype(np.uint64) | extra, CODE_BITS[symbol] + s
    per = np.bincount(block, skips + 1, len(c)).astype(np.int64) + eob
    at = (np.cumsum(per) - 1)[eob]
    values[at], bits[at] = CODE[0], CODE_BITS[0]
    return values, bits, np.repeat(lane, per)


def _refine_block(c: list[int], first: int, last: int, low: int) -> list[tuple[int, int]]:
    """Symbols of a block in which coefficients become non-zero in this scan."""
    out, held, run = [], [], 0
    late = [k for k in range(first, last + 1) if abs(c[k]) >> low == 1]
    for k in range(first, last + 1):
        a = abs(c[k]) >> low
        if not a:
            run += 1
            continue
        while run > 15 and late and k <= late[-1]:
            out += [(int(CODE[0xF0]), int(CODE_BITS[0xF0])), *held]
            held, run = [], run - 16
        if a > 1:
            held.append((a & 1, 1))
            continue
        out += [(int(CODE[run << 4 | 1]), int(CODE_BITS[run << 4 | 1])), (int(c[k] > 0), 1), *held]
        held, run = [], 0
    return out + [(int(CODE[0]), int(CODE_BITS[0])), *held] if run or held else out


def write_ac_refine(c: np.ndarray, lane: np.ndarray, first: int, last: int, low: int) -> tuple:
    a = np.abs(c[:, first : last + 1]) >> low
    known = a > 1
    odd = {i: _refine_block(c[i].tolist(), first, last, low) for i in np.flatnonzero((a == 1).any(1)).tolist()}
    per = np.full(len(c), 3)
    for i, x in odd.items():
        per[i] = len(x)
    at = np.cumsum(per) - per
    values, bits = np.zeros(int(per.sum()), np.uint64), np.zeros(int(per.sum()), np.int64)
    plain = np.ones(len(c), bool)
    plain[list(odd)] = False
    values[at[plain]], bits[at[plain]] = CODE[0], CODE_BITS[0]
    for j, cols in enumerate((slice(0, 32), slice(32, 64))):
        h, b = known[plain][:, cols], (a[plain][:, cols] & 1).astype(np.uint64)
        n = h.sum(1)
        left = (n[:, None] - np.cumsum(h, axis=1)).astype(np.uint64)
        values[at[plain] + 1 + j] = np.where(h, b << np.where(h, left, np.uint64(0)), np.uint64(0)).sum(1, dtype=np.uint64)
        bits[at[plain] + 1 + j] = n
    for i, x in odd.items():
        values[at[i] : at[i] + len(x)], bits[at[i] : at[i] + len(x)] = zip(*x) if x else ((), ())
    return values, bits, np.repeat(lane, per)


#: First and last coefficient, high and low bit of the scans of each component.
SCANS = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode(images: list[tuple[int, int, list[np.ndarray]]], notes: list[bytes]) -> list[bytes]:
    """Progressive 4:2:0 JPEGs of (width, height in units of 16, coefficients of Y, Cb and Cr in zigzag order)."""
    sizes = np.array([[len(c) for c in x[2]] for x in images], np.int64).reshape(-1)
    c = np.concatenate([p for x in images for p in x[2]]).astype(np.int64)
    lanes = -(-sizes // RESTART)
    lane = np.repeat(np.cumsum(lanes) - lanes, sizes) + ranges(sizes) // RESTART
    streams = []
    for first, last, high, low in SCANS:
        got = write_dc(c, lane, high, low) if first == 0 else (write_ac_refine if high else write_ac_first)(c, lane, first, last, low)
        streams.append(pack_bits(*got, int(lanes.sum())))
    counts = [LENGTHS.count(n) for n in range(1, 17)]
    tables = b"".join(segment(0xC4, bytes([kind << 4, *counts, *SYMBOLS])) for kind in (0, 1))
    quantisers = segment(0xDB, bytes([0, *[1] * 64]))
    edge = np.concatenate([[0], np.cumsum(lanes)])
    restarts = [bytes([255, 0xD0 + i]) for i in range(8)] * (int(lanes.max()) // 8 + 1)
    out = []
    for i, (w, h, _) in enumerate(images):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", segment(0xFE, notes[i]), quantisers, segment(0xC2, frame), tables, segment(0xDD, struct.pack(">H", RESTART))]
        for (first, last, high, low), stream in zip(SCANS, streams):
            for j in range(3):
                parts.append(segment(0xDA, bytes([1, j + 1, 0, first, last, high << 4 | low])))
                a, b = int(edge[3 * i + j]), int(edge[3 * i + j + 1])
                own = [b""] * (2 * (b - a) - 1)
                own[::2], own[1::2] = stream[a:b], restarts[: b - a - 1]
                parts += own
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --------------------------------------------------------------------------- reading
@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row and column, with and without filling
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    base: int = 0  # first block among all coefficients


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    quantisers: dict = field(default_factory=dict)
    note: bytes = b""


def parse(data: bytes) -> Image:
    """Headers and the scans' restart intervals as (start, end) in the data."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0))
    plain = np.flatnonzero((raw[marks + 1] & 0xF8) != 0xD0)  # markers that end a scan
    image, at, restart, tables = Image(), 2, 0, {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            image.note = body
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 << (body[0] >> 4)
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = body[: 17 + n], body[17 + n :]
        elif kind == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for i in range(n):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                image.components[c] = Component(hv >> 4, hv & 15, q)
            top_h, top_v = (max(getattr(c, x) for c in image.components.values()) for x in "hv")
            for c in image.components.values():
                c.wide, c.high = -(-image.width // (8 * top_h)) * c.h, -(-image.height // (8 * top_v)) * c.v
                c.own_wide, c.own_high = -(-image.width * c.h // (8 * top_h)), -(-image.height * c.v // (8 * top_v))
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif kind == 0xDA:
            n = body[0]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            i = int(np.searchsorted(marks, at))
            j = int(plain[np.searchsorted(plain, i)])
            starts, ends = [at, *(marks[i:j] + 2).tolist()], marks[i : j + 1].tolist()
            at = ends[-1]
            used = tuple(tables.get((0x10 if first else 0) | (x >> 4 if not first else x & 15)) for x in body[2 : 2 + 2 * n : 2])
            image.scans.append((tuple(body[1 : 1 + 2 * n : 2]), first, last, bits >> 4, bits & 15, restart, used, starts, ends))
    return image


def scan_blocks(image: Image, ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Blocks of a scan in order, each one's component (by place in the scan, None for one only) and blocks per MCU."""
    if len(ids) == 1:
        c = image.components[ids[0]]
        if c.own_wide == c.wide:
            return np.arange(c.base, c.base + c.own_high * c.wide), None, 1
        b = np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)
        return c.base + b.reshape(-1), None, 1
    blocks, owner = [], []
    for j, i in enumerate(ids):
        c = image.components[i]
        b = (c.base + np.arange(c.high * c.wide)).reshape(c.high // c.v, c.v, c.wide // c.h, c.h).transpose(0, 2, 1, 3)
        blocks.append(b.reshape(-1, c.v * c.h))
        owner += [j] * (c.v * c.h)
    b = np.concatenate(blocks, axis=1)
    return b.reshape(-1), np.tile(owner, len(b)), b.shape[1]


class Lanes:
    """Restart intervals of like scans, read side by side."""

    def __init__(self, spans: list[bytes], blocks: list[np.ndarray], steps: list[int]):
        size = np.array([len(x) for x in spans])
        raw = np.frombuffer(b"".join(spans), np.uint8)
        start = np.zeros(len(raw) + 1, bool)
        start[np.cumsum(size) - size] = True
        stuffed = np.zeros(len(raw), bool)
        stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255) & ~start[1 : len(raw)]
        gone = np.concatenate([[0], np.cumsum(stuffed)])
        first = np.cumsum(size) - size
        self.raw = np.concatenate([raw[~stuffed], np.full(8, 255, np.uint8)])
        r = self.raw.astype(np.int64)
        self.window = r[:-4] << 32 | r[1:-3] << 24 | r[2:-2] << 16 | r[3:-1] << 8 | r[4:]
        self.at = (first - gone[first]) * 8
        total, steps = np.array([len(b) for b in blocks]), np.array(steps)
        lanes = -(-total // steps)
        n = np.repeat(steps, lanes)
        n[np.cumsum(lanes) - 1] = total - (lanes - 1) * steps
        self.blocks, self.next, self.end = np.concatenate(blocks), np.cumsum(n) - n, np.cumsum(n)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        at = np.minimum(at, 8 * (len(self.window) - 1))
        return (self.window[at >> 3] >> (40 - (at & 7) - n)) & ((1 << np.asarray(n, np.int64)) - 1)


def signed(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)


def read_dc(x: Lanes, c: np.ndarray, owner: np.ndarray | None, looks: list[np.ndarray], high: int, low: int) -> None:
    at, nxt, last = x.at.copy(), x.next.copy(), np.zeros((len(x.at), len(looks)), np.int64)
    live = np.flatnonzero(nxt < x.end)
    while len(live):
        p, b = at[live], nxt[live]
        j = owner[b] if owner is not None else 0
        if high:
            c[x.blocks[b], 0] |= (x.peek(p, 1) << low).astype(c.dtype)
            at[live] = p + 1
        else:
            look = x.peek(p, 16)
            found = looks[0][look] if len(looks) == 1 else np.stack([t[look] for t in looks])[j, np.arange(len(j))]
            p, s = p + (found & 255), (found >> 8).astype(np.int64)
            last[live, j] += signed(x.peek(p, s), s)
            c[x.blocks[b], 0] = last[live, j] << low
            at[live] = p + s
        nxt[live] = b + 1
        live = live[b + 1 < x.end[live]]


def read_ac_first(x: Lanes, c: np.ndarray, look: np.ndarray, first: int, last: int, low: int) -> None:
    # all that a leading code tells, by its bits: its length with the extra bits', their number, the zeros before
    wide = max(1, int((look & 255).max()))
    found = look[:: 1 << (16 - wide)].astype(np.int64)
    zeros, size = found >> 12, (found >> 8) & 15
    ends = (size == 0) & (zeros < 15)
    extra = np.where(ends, zeros, size)
    total, mask, half = (found & 255) + extra, (1 << extra) - 1, np.where(size > 0, (1 << size) >> 1, 0)
    skip = np.where(ends, 0, zeros)
    flat, spare = c.reshape(-1), c.size - 1
    live = np.flatnonzero(x.next < x.end)
    at, nxt, end, k = x.at[live], x.next[live], x.end[live], np.full(len(live), first)
    base, top, limit = x.blocks[nxt] * 64, (1 << wide) - 1, 8 * (len(x.window) - 1)
    while len(at):
        w = x.window[at >> 3] << (at & 7)
        code = (w >> (40 - wide)) & top
        n, m = total[code], mask[code]
        v = (w >> (40 - n)) & m
        h = half[code]
        v = v - m * (v < h)
        at = at + n
        k = k + skip[code]
        none = np.flatnonzero(h == 0)
        if len(none):
            cell = base + np.minimum(k, 63)
            cell[none] = spare
            flat[cell] = v << low
        else:
            flat[base + k] = v << low
        k += 1
        turn = np.flatnonzero(ends[code] | (k > last)) if len(none) else np.flatnonzero(k > last)
        if len(turn):
            t = code[turn]
            nxt[turn] += np.where(ends[t], (1 << zeros[t]) + (w[turn] >> (40 - n[turn]) & m[turn]), 1)
            k[turn] = first
            if (nxt[turn] >= end[turn]).any():
                on = np.flatnonzero(nxt < end)
                at, nxt, end, k = at[on], nxt[on], end[on], k[on]
                base = x.blocks[nxt] * 64
            else:
                base[turn] = x.blocks[nxt[turn]] * 64
            at = np.minimum(at, limit)


def read_ac_refine(x: Lanes, c: np.ndarray, look: np.ndarray, first: int, last: int, low: int) -> None:
    live = np.flatnonzero(x.next < x.end)
    at, nxt, end, k, runs = x.at[live], x.next[live], x.end[live], np.full(len(live), first), np.zeros(len(live), np.int64)
    place = np.arange(last + 1)
    while len(at):
        found = np.where(runs > 0, 0, look[x.peek(at, 16)].astype(np.int64))
        at = at + (found & 255)
        r, s = found >> 12, (found >> 8) & 15
        eob = (s == 0) & (r < 15)
        new = eob & (runs == 0)
        n = np.where(new, r, np.where(s > 0, 1, 0))
        v = x.peek(at, n)
        at = at + n
        runs = np.where(new, (1 << r) + v, runs)
        block = x.blocks[nxt]
        part = c[block, : last + 1]
        ahead = place >= k[:, None]
        known = (part != 0) & ahead
        # the coefficient after r more zeros, or the end of the band
        zeros = np.cumsum(~known & ahead, axis=1)
        stop = np.where(eob, last + 1, (zeros <= r[:, None]).sum(1))
        fix = known & (place < stop[:, None])
        rank = np.cumsum(fix, axis=1)
        row, col = np.nonzero(fix)
        bit = at[row] + rank[row, col] - 1
        ones = (x.raw[np.minimum(bit >> 3, len(x.raw) - 1)] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        hit = ones > 0
        row, col = row[hit], col[hit]
        old = part[row, col]
        c[block[row], col] = old + (np.sign(old) << low)
        at = at + rank[:, -1]
        put = (s > 0) & (stop <= last)
        c[block[put], stop[put]] = np.where(v[put] > 0, 1 << low, -1 << low)
        k = stop + 1
        runs = np.where(eob, runs - 1, runs)
        over = k > last
        nxt = nxt + over
        k = np.where(over, first, k)
        if (nxt >= end).any():
            on = nxt < end
            at, nxt, end, k, runs = at[on], nxt[on], end[on], k[on], runs[on]


def coefficients(data: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers of all images, and their blocks' coefficients in zigzag order, component by component."""
    images, base = [parse(x) for x in data], 0
    for image in images:
        for comp in image.components.values():
            comp.base = base
            base += comp.wide * comp.high
    c = np.zeros((base + 1, 64), np.int32)  # the last block takes what is of no block
    for i in range(max((len(x.scans) for x in images), default=0)):
        like: dict = {}
        for image, raw in zip(images, data):
            if i < len(image.scans):
                ids, first, last, high, low, restart, used, starts, ends = image.scans[i]
                lanes = like.setdefault((first, last, high, low, used), ([], [], [], []))
                blocks, owner, per = scan_blocks(image, ids)
                lanes[0].extend([raw[a:b] for a, b in zip(starts, ends)])
                lanes[1].append(blocks)
                lanes[2].append(owner)
                lanes[3].append(restart * per or len(blocks))
        for (first, last, high, low, used), (spans, blocks, owner, steps) in like.items():
            looks = [huffman(*table(t))[2] if t else None for t in used]
            x = Lanes(spans, blocks, steps)
            if first == 0:
                read_dc(x, c, np.concatenate(owner) if len(used) > 1 else None, looks, high, low)
            else:
                (read_ac_refine if high else read_ac_first)(x, c, looks[0], first, last, low)
    return images, c[:-1]


def table(raw: bytes) -> tuple[list[int], list[int]]:
    return [n + 1 for n, k in enumerate(raw[1:17]) for _ in range(k)], list(raw[17:])


def samples(images: list[Image], c: np.ndarray) -> np.ndarray:
    """8 x 8 samples of all blocks, level-shifted and clipped."""
    q = np.ones((len(c), 64), np.float32) if any((v != 1).any() for x in images for v in x.quantisers.values()) else None
    if q is not None:
        for image in images:
            for comp in image.components.values():
                q[comp.base : comp.base + comp.wide * comp.high] = image.quantisers[comp.table]
    x = c.astype(np.float32) if q is None else c * q
    x = x[:, UNZIGZAG].reshape(-1, 8) @ COSINES
    x = x.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES
    x = x.reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.rint(x + np.float32(128)), 0, 255).astype(np.uint8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """height x width x 3: planes put together, chroma repeated to full resolution, turned into RGB."""
    top_h, top_v, planes = max(c.h for c in image.components.values()), max(c.v for c in image.components.values()), []
    for c in image.components.values():
        p = blocks[c.base : c.base + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)
        p = p.repeat(top_v // c.v, axis=0).repeat(top_h // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in planes)
    cb, cr = cb - 128, cr - 128
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(data: list[bytes]) -> list[np.ndarray]:
    """Full-resolution RGB tensors of progressive JPEGs."""
    images, c = coefficients(data)
    blocks = samples(images, c)
    return [rgb(x, blocks) for x in images]


# --------------------------------------------------------------------------- payloads
def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs whose coefficients are the payloads' bytes (lengths positive multiples of 64)."""
    images, notes = [], []
    for p in payloads:
        n = -(-len(p) // 384)
        w = int(np.ceil(np.sqrt(n)))
        h = -(-n // w)
        c = np.zeros((6 * w * h, 64), np.int8)
        c.reshape(-1)[: len(p)] = np.frombuffer(p, np.int8)
        images.append((w, h, np.split(c, [4 * w * h, 5 * w * h])))
        notes.append(MARK + struct.pack(">Q", len(p)))
    return encode(images, notes)


def payloads(images: list[Image], c: np.ndarray) -> list[bytes]:
    """The payloads back from decoded coefficients."""
    out = []
    for image in images:
        base = min(x.base for x in image.components.values())
        size = struct.unpack(">Q", image.note.removeprefix(MARK))[0]
        out.append(c[base : base + -(-size // 64)].astype(np.int8).tobytes()[:size])
    return out


def write_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and media: every text's UTF-8 bytes, zeros added up to a positive multiple of 64, as a JPEG. Null counts as empty."""
    picked = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    schema = widened(picked.drop("__text"), "n_bytes long", "media binary")

    def run(batches):
        for b in slices(batches, "__text", 1 << 20):
            raw = b.column("__text").to_pylist()
            media = store([x + bytes(-len(x) % 64 or 64 * (not x)) for x in raw])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return picked.mapInArrow(run, schema)


def read_media(stored: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """All columns, payload (read back from the coefficients), height, width, feature and, if asked, rgb.

    ``feature`` holds the size, mean red, green and blue and CRC-32 of the RGB tensor.
    """
    schema = widened(stored, "payload binary", "height int", "width int", "feature string", *["rgb binary"] * tensors)

    def run(batches):
        for b in slices(batches, media, 2 << 20):
            images, c = coefficients(b.column(media).to_pylist())
            blocks = samples(images, c)
            pixels = [rgb(x, blocks) for x in images]
            means = [p.reshape(-1, 3).mean(0, dtype=np.float64) for p in pixels]
            words = [f"{x.height}x{x.width} rgb {m[0]:.4f} {m[1]:.4f} {m[2]:.4f} crc {zlib.crc32(p.tobytes()):08x}" for x, p, m in zip(images, pixels, means)]
            out = [pa.array(payloads(images, c), pa.binary()), pa.array([x.height for x in images], pa.int32()), pa.array([x.width for x in images], pa.int32()), pa.array(words)]
            yield pa.RecordBatch.from_arrays([*b.columns, *out, *([pa.array([p.tobytes() for p in pixels], pa.binary())] if tensors else [])], names=schema.names)

    return stored.mapInArrow(run, schema)
