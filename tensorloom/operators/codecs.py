"""Plane codecs and sequential transforms on byte strings, each with its inverse; `evaluate` runs a menu over planes.

A codec says by what is known of a plane whether it takes it (role, element, rows), and by a look at its bytes whether it is
worth a try.  Huffman, tANS and sparse payloads have the sizes of functions.sizes; the others are our own: static and
adaptive models are coded over many lanes that step together (operators.lanes), whose states are part of the payload.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import fitting, lanes

TOTAL_BITS = 11
TOTAL = 1 << TOTAL_BITS
#: The step in which tANS spreads symbols over its table.
SPREAD = (TOTAL >> 1) + (TOTAL >> 3) + 3
GROUP = 32


@dataclass(frozen=True)
class Info:
    """What is known of a plane besides its bytes: the role that its chain or its tensor's class gives it, bytes of an
    element, whether elements are nibbles, bytes of a row, element type, and a state that is kept elsewhere."""

    role: str = "raw"
    width: int = 1
    nibble: bool = False
    row_len: int | None = None
    dtype: str = "uint8"
    state: bytes | None = field(default=None, repr=False)


SCALE_ROLES = ("SCALE_BLOCK", "SCALE_GLOBAL")


def identity(b: bytes) -> bytes:
    return b


def zstd_encode(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def zstd_decode(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31)


def zstd_dict_encode(b: bytes, info: Info) -> bytes:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(info.state or b"")).compress(b)


def zstd_dict_decode(b: bytes, info: Info) -> bytes:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(info.state or b"")).decompress(b, max_output_size=1 << 31)


def code_lengths(freq: np.ndarray, most: int = TOTAL_BITS) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; a single symbol takes one bit.  Where lengths were cut to `most`, the
    shortest codes are made longer, the first of equals, until all fit."""
    out = np.zeros(len(freq), np.int64)
    used = np.flatnonzero(freq)
    if len(used) <= 1:
        out[used] = 1
        return out
    heap = [(int(freq[s]), i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    n = len(heap)
    parent = [0] * (2 * n - 1)
    for new in range(n, 2 * n - 1):
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = new
        heapq.heappush(heap, (fa + fb, new))
    depth = [0] * (2 * n - 1)
    for x in range(2 * n - 3, -1, -1):
        depth[x] = depth[parent[x]] + 1
    out[used] = np.minimum(depth[:n], most)
    while most < 63 and int((1 << (most - out[used])).sum()) > 1 << most:
        short = used[out[used] < most]
        out[short[np.argmin(out[short])]] += 1
    return out


def _canonical(lengths: np.ndarray) -> np.ndarray:
    code, out, last = 0, np.zeros(len(lengths), np.int64), 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        out[s], last = code, int(lengths[s])
        code += 1
    return out


def quarters(n: int) -> list[tuple[int, int]]:
    """Four parts of n bytes, the first ones a byte longer where they can't be equal."""
    size = [n // 4 + (i < n % 4) for i in range(4)]
    at = np.concatenate(([0], np.cumsum(size)))
    return [(int(at[i]), int(at[i + 1])) for i in range(4)]


def _bits_of(x: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    ln = lengths[x]
    start = np.cumsum(ln) - ln
    bits = np.zeros(int(ln.sum()), np.uint8)
    for j in range(int(ln.max()) if len(ln) else 0):
        on = ln > j
        bits[start[on] + j] = (codes[x[on]] >> (ln[on] - 1 - j)) & 1
    return bits


def huffman_encode(b: bytes) -> bytes:
    """A tag, the length, highest symbol, lengths as nibbles, and four streams; a tag and the bytes where that isn't less."""
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return b"\x00"
    freq = np.bincount(x)
    lengths = code_lengths(freq)
    codes = _canonical(lengths)
    n = len(freq)
    nibbles = np.append(lengths, np.zeros(n % 2, np.int64)).astype(np.uint8)
    streams = [np.packbits(_bits_of(x[lo:hi], lengths, codes)).tobytes() for lo, hi in quarters(len(x))]
    head = bytes([n]) if n <= 127 else bytes([0x80 | (n >> 8), n & 255])
    body = head + ((nibbles[0::2] << 4) | nibbles[1::2]).tobytes() + struct.pack("<4I", *map(len, streams)) + b"".join(streams)
    return b"\x01" + struct.pack("<I", len(b)) + body if len(body) < len(b) else b"\x00" + b


def huffman_decode(b: bytes) -> bytes:
    if b[:1] == b"\x00":
        return b[1:]
    n, at = struct.unpack_from("<I", b, 1)[0], 5
    count = b[at]
    at += 1
    if count & 0x80:
        count = (count & 0x7F) << 8 | b[at]
        at += 1
    packed = np.frombuffer(b, np.uint8, (count + 1) // 2, at)
    at += len(packed)
    lengths = np.empty(2 * len(packed), np.int64)
    lengths[0::2], lengths[1::2] = packed >> 4, packed & 15
    codes = _canonical(lengths)
    symbol, size = np.zeros(TOTAL, np.int64), np.ones(TOTAL, np.int64)
    for s in np.flatnonzero(lengths):
        lo = codes[s] << (TOTAL_BITS - lengths[s])
        symbol[lo : lo + (1 << (TOTAL_BITS - lengths[s]))], size[lo : lo + (1 << (TOTAL_BITS - lengths[s]))] = s, lengths[s]
    sizes = struct.unpack_from("<4I", b, at)
    at += 16
    out, k = bytearray(n), 0
    for (lo, hi), m in zip(quarters(n), sizes, strict=True):
        bits = np.append(np.unpackbits(np.frombuffer(b, np.uint8, m, at)), np.zeros(16, np.uint8)).astype(np.int64)
        at += m
        window = sum(bits[i : len(bits) - TOTAL_BITS + 1 + i] << (TOTAL_BITS - 1 - i) for i in range(TOTAL_BITS))
        step, sym, pos = size[window].tolist(), symbol[window].tolist(), 0
        for k in range(lo, hi):
            out[k] = sym[pos]
            pos += step[pos]
    return bytes(out)


def normalised(freq: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Frequencies of sum `total`, one at least for each that occurs; the commonest takes up the rest."""
    out = np.where(freq > 0, np.maximum(freq * total // max(int(freq.sum()), 1), 1), 0)
    out[int(np.argmax(out))] += total - int(out.sum())
    return out


def _static_encode(x: np.ndarray, f: np.ndarray, bits: int) -> bytes:
    n, per = lanes.lanes_of(len(x))
    cum, steps = np.cumsum(f) - f, lanes.by_step(x, n, per, 0)
    return lanes.encode_steps(lambda t: (f[steps[t]], cum[steps[t]]), len(x), bits, n, per)


def _static_decode(b: bytes, n: int, f: np.ndarray, bits: int) -> np.ndarray:
    count, per = lanes.lanes_of(n)
    cum, owner = np.cumsum(f) - f, np.repeat(np.arange(len(f)), f)
    return lanes.decode(b, n, bits, count, per, lambda t, before, slot: (owner[slot], f[owner[slot]], cum[owner[slot]]))


def _tabled(bits: int):
    """Static order-0 coding with totals of 2**bits; a table of the symbols up to the highest."""

    def encode(b: bytes) -> bytes:
        x = np.frombuffer(b, np.uint8)
        if not len(x):
            return b"\x00"
        f = normalised(np.bincount(x).astype(np.int64), 1 << bits)
        if f[x].min() < 1:
            return b"\x00" + b
        table = np.minimum(f, 65535).astype("<u2").tobytes()  # a lone symbol of 65,536 is told by its being alone
        out = b"\x01" + struct.pack("<IB", len(b), len(f) - 1) + table + _static_encode(x, f, bits)
        return out if len(out) < len(b) + 1 else b"\x00" + b

    def decode(b: bytes) -> bytes:
        if b[:1] == b"\x00":
            return b[1:]
        n, last = struct.unpack_from("<IB", b, 1)
        f = np.frombuffer(b, "<u2", last + 1, 6).astype(np.int64)
        if np.count_nonzero(f) == 1:
            f[np.flatnonzero(f)] = 1 << bits
        return _static_decode(b[6 + 2 * len(f) :], n, f, bits).astype(np.uint8).tobytes()

    return encode, decode


rans_encode, rans_decode = _tabled(TOTAL_BITS)
arithmetic0_encode, arithmetic0_decode = _tabled(16)


def tans_table(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised counts (the surplus off the largest, a lack to the most frequent), and the symbol of each state."""
    f = np.where(freq > 0, np.maximum(freq * TOTAL // max(int(freq.sum()), 1), 1), 0)
    while (over := int(f.sum()) - TOTAL) > 0:
        f[int(np.argmax(f))] -= 1
    f[int(np.argmax(freq))] += -over
    table = np.empty(TOTAL, np.int64)
    table[(np.arange(TOTAL) * SPREAD) % TOTAL] = np.repeat(np.arange(len(f)), f)
    return f, table


def tans_encode(b: bytes) -> bytes:
    """States over a table of 2,048, one a lane: three bytes a symbol that occurs, the states, then bits; the bytes where
    that isn't less."""
    x = np.frombuffer(b, np.uint8)
    raw = b"\x00" + b
    freq = np.bincount(x, minlength=1).astype(np.int64)
    if np.count_nonzero(freq) < 2:
        return raw
    f, table = tans_table(freq)
    order = np.argsort(table, kind="stable")  # states by symbol, in order of place
    first = np.cumsum(f) - f
    width = np.array([max(TOTAL_BITS - int(k).bit_length() + 1, 0) for k in f])
    count, per = lanes.lanes_of(len(x))
    steps = lanes.by_step(x.astype(np.int64), count, per, int(x[0]))
    short = len(x) - (count - 1) * per
    state = np.full(count, TOTAL, np.int64)
    bits, sizes = np.zeros((per, count), np.int64), np.zeros((per, count), np.int64)
    for t in range(per - 1, -1, -1):
        s = steps[t]
        own, k = f[s], width[s]
        v = state >> k
        k = k + (v >= 2 * own) - (v < own)
        new = TOTAL + order[first[s] + (state >> k) - own]
        if t >= short:
            k[-1], new[-1] = 0, state[-1]
        bits[t], sizes[t], state = state & ((1 << k) - 1), k, new
    v, w = bits.T.ravel(), sizes.T.ravel()
    start = np.cumsum(w) - w
    out = np.zeros(int(w.sum()), np.uint8)
    for j in range(int(w.max()) if len(w) else 0):
        on = np.flatnonzero(w > j)
        out[start[on] + j] = (v[on] >> (w[on] - 1 - j)) & 1
    used = np.flatnonzero(f)
    head = struct.pack("<I", len(b)) + (state - TOTAL).astype("<u2").tobytes() + (sizes.sum(axis=0).astype("<u4").tobytes() if count > 1 else bytes(2))
    got = b"\x01" + struct.pack("<H", len(used)) + b"".join(struct.pack("<BH", s, int(f[s])) for s in used) + head + np.packbits(out).tobytes()
    return got if len(got) < len(b) else raw


def tans_decode(b: bytes) -> bytes:
    if b[:1] == b"\x00":
        return b[1:]
    m = struct.unpack_from("<H", b, 1)[0]
    f = np.zeros(256, np.int64)
    for s, n in struct.iter_unpack("<BH", b[3 : 3 + 3 * m]):
        f[s] = n
    at = 3 + 3 * m
    n = struct.unpack_from("<I", b, at)[0]
    count, per = lanes.lanes_of(n)
    state = np.frombuffer(b, "<u2", count, at + 4).astype(np.int64)
    at += 4 + 2 * count
    size = np.frombuffer(b, "<u4", count, at).astype(np.int64) if count > 1 else np.zeros(1, np.int64)
    at += 4 * count if count > 1 else 2
    table = np.empty(TOTAL, np.int64)
    table[(np.arange(TOTAL) * SPREAD) % TOTAL] = np.repeat(np.arange(256), f)
    order = np.argsort(table, kind="stable")
    rank = np.empty(TOTAL, np.int64)
    rank[order] = np.arange(TOTAL) - (np.cumsum(f) - f)[table[order]]
    before = f[table] + rank  # the state before, without its low bits
    width = TOTAL_BITS - np.floor(np.log2(before)).astype(np.int64)
    stream = np.frombuffer(b, np.uint8, -1, at)
    # 48 bits from each byte on
    padded = np.append(stream, np.zeros(8, np.uint8)).astype(np.int64)
    word = sum(padded[i : i + len(stream) + 1] << (40 - 8 * i) for i in range(6))
    pos, out = np.cumsum(size) - size, np.empty((per, count), np.uint8)
    for t in range(per):
        out[t] = table[state]
        w = width[state]
        got = (word[np.minimum(pos >> 3, len(word) - 1)] >> (48 - (pos & 7) - w)) & ((1 << w) - 1)
        state = (before[state] << w | got) - TOTAL
        pos += w
    return out.T.tobytes()[:n]


def sparse_encode(b: bytes) -> bytes:
    """A nibble an element (zero or not) and the non-zero bytes: for residuals."""
    x = np.frombuffer(b, np.uint8)
    flags = np.append(x != 0, np.zeros(len(x) % 2, bool)).astype(np.uint8)
    return b"\x01" + struct.pack("<I", len(b)) + ((flags[0::2] << 4) | flags[1::2]).tobytes() + x[x != 0].tobytes()


def sparse_decode(b: bytes) -> bytes:
    n = struct.unpack_from("<I", b, 1)[0]
    m = (n + 1) // 2
    packed = np.frombuffer(b, np.uint8, m, 5)
    flags = np.empty(2 * m, np.uint8)
    flags[0::2], flags[1::2] = packed >> 4, packed & 15
    out = np.zeros(n, np.uint8)
    out[flags[:n] > 0] = np.frombuffer(b, np.uint8, -1, 5 + m)
    return out.tobytes()


def group_codebook_encode(b: bytes, info: Info) -> bytes:
    """Nibbles in groups of 32: a codebook of 16 tables, the table of each group, and the nibbles under it."""
    x = np.frombuffer(b, np.uint8)
    if len(x) % GROUP or (len(x) and int(x.max()) > 15):
        raise ValueError("nibbles in whole groups only")
    g = len(x) // GROUP
    hist = np.stack([(x.reshape(g, GROUP) == s).sum(axis=1) for s in range(16)], axis=1)
    if info.state:
        book = np.frombuffer(info.state, np.uint8).reshape(16, 16).astype(np.int64)
        book[book == 0] = 256  # a table of one symbol can't be: every entry is 1 at least, so 256 isn't either
        of = np.argmin(-(hist @ np.log2(book / 256.0).T), axis=1)
    else:
        centres, of = fitting.fit_codebook(hist, (0,))
        book = np.array([fitting.quantize_centroid(c) for c in centres])
    cum = np.cumsum(book, axis=1) - book
    n, per = lanes.lanes_of(len(x))
    steps, groups = lanes.by_step(x, n, per, 0), lanes.by_step(np.repeat(of.astype(np.uint8), GROUP), n, per, 0)
    tables = np.append(of, np.zeros(g % 2, np.int64)).astype(np.uint8)
    own = b"" if info.state else book.astype(np.uint8).tobytes()
    return own + struct.pack("<I", g) + ((tables[0::2] << 4) | tables[1::2]).tobytes() + lanes.encode_steps(lambda t: (book[groups[t], steps[t]], cum[groups[t], steps[t]]), len(x), 8, n, per)


def group_codebook_decode(b: bytes, info: Info) -> bytes:
    state, b = (info.state, b) if info.state else (b[:256], b[256:])
    book = np.frombuffer(state, np.uint8).reshape(16, 16).astype(np.int64)
    g = struct.unpack_from("<I", b)[0]
    packed = np.frombuffer(b, np.uint8, (g + 1) // 2, 4)
    of = np.empty(2 * len(packed), np.int64)
    of[0::2], of[1::2] = packed >> 4, packed & 15
    n, per = lanes.lanes_of(g * GROUP)
    cum = np.cumsum(book, axis=1) - book
    owner = np.array([np.repeat(np.arange(16), r) for r in book])
    groups = lanes.by_step(np.repeat(of[:g].astype(np.uint8), GROUP), n, per, 0)

    def model(t, before, slot):
        k = groups[t]
        s = owner[k, slot]
        return s, book[k, s], cum[k, s]

    return lanes.decode(b[4 + len(packed) :], g * GROUP, 8, n, per, model).astype(np.uint8).tobytes()


def _context_lanes(n: int, row_len: int | None) -> tuple[int, int]:
    return lanes.lanes_of(n, row_len if row_len and row_len <= 1 << 16 else 1)


def _order1(x: np.ndarray, model: fitting.Order1, row_len: int | None) -> bytes:
    n, per = _context_lanes(len(x), row_len)
    table = np.vstack((model.table(), model.marginal[None]))
    prev = np.full(len(x), 256, np.int64)
    prev[1:] = x[:-1]
    prev[:: row_len or max(len(x), 1)] = 256
    prev[:: per or 1] = 256  # a lane's decoder doesn't know what comes before it
    cum = np.cumsum(table, axis=1) - table
    return lanes.encode(table[prev, x], cum[prev, x], 12, n, per)


def _unorder1(b: bytes, size: int, model: fitting.Order1, row_len: int | None) -> bytes:
    n, per = _context_lanes(size, row_len)
    table = np.vstack((model.table(), model.marginal[None]))
    cum = np.cumsum(table, axis=1) - table
    owner = np.array([np.repeat(np.arange(256), r) for r in table]).astype(np.uint8)

    def step(t, before, slot):
        at = t + per * np.arange(n)
        k = np.where((at % row_len == 0) if row_len else (at == 0) | (t == 0), 256, before) if t else np.full(n, 256)
        s = owner[k, slot].astype(np.int64)
        return s, table[k, s], cum[k, s]

    return lanes.decode(b, size, 12, n, per, step).astype(np.uint8).tobytes()


def order1_scale_encode(b: bytes, info: Info) -> bytes:
    """Static order-1 within rows, under a table of the plane's own or a shared one."""
    x = np.frombuffer(b, np.uint8)
    model = fitting.unpack_order1(info.state) if info.state else fitting.fit_order1(*fitting.order1_counts(x, info.row_len))
    own = b"" if info.state else zstd_encode(fitting.pack_order1(model))
    return struct.pack("<II", len(b), len(own)) + own + _order1(x, model, info.row_len)


def order1_scale_decode(b: bytes, info: Info) -> bytes:
    n, m = struct.unpack_from("<II", b)
    model = fitting.unpack_order1(info.state if info.state else zstd_decode(b[8 : 8 + m]))
    return _unorder1(b[8 + m :], n, model, info.row_len)


def order1_encode(b: bytes) -> bytes:
    """Static order-1 over the whole plane; the marginal counts every byte."""
    x = np.frombuffer(b, np.uint8)
    joint, _ = fitting.order1_counts(x, None)
    model = fitting.fit_order1(joint, np.bincount(x, minlength=256))
    own = zstd_encode(fitting.pack_order1(model))
    return struct.pack("<II", len(b), len(own)) + own + _order1(x, model, None)


def order1_decode(b: bytes) -> bytes:
    return order1_scale_decode(b, Info())


def huff_llm_encode(b: bytes) -> bytes:
    """16-bit words as a sign and three fields, of 5, 5 and 5 or 4, 4 and 7 bits, whichever is less (the former, if equal):
    signs as bits, fields each with Huffman codes."""
    v = np.frombuffer(b, "<u2").astype(np.int64)
    best = None
    for tag, widths in enumerate(((5, 5, 5), (4, 4, 7))):
        at, parts = 15, []
        for w in widths:
            at -= w
            parts.append(huffman_encode(((v >> at) & ((1 << w) - 1)).astype(np.uint8).tobytes()))
        got = bytes([tag]) + struct.pack("<4I", len(v), *map(len, parts)) + np.packbits((v >> 15).astype(np.uint8)).tobytes() + b"".join(parts)
        if best is None or len(got) < len(best):
            best = got
    return best


def huff_llm_decode(b: bytes) -> bytes:
    n, *sizes = struct.unpack_from("<4I", b, 1)
    at = 17 + (n + 7) // 8
    v = np.unpackbits(np.frombuffer(b, np.uint8, (n + 7) // 8, 17))[:n].astype(np.int64) << 15
    shift = 15
    for w, m in zip(((5, 5, 5), (4, 4, 7))[b[0]], sizes, strict=True):
        shift -= w
        v |= np.frombuffer(huffman_decode(b[at : at + m]), np.uint8).astype(np.int64) << shift
        at += m
    return v.astype("<u2").tobytes()


class _Adaptive:
    """Adaptive frequencies of 256 symbols in one or 256 contexts: 1 at first, 24 more a sighting, halved at 2**16; all
    lanes of a step see the model as it was before it.  Coded with totals of 2**16."""

    def __init__(self, order: int, n: int, count: int, per: int):
        self.order, self.n, self.count, self.per = order, n, count, per
        self.f = np.ones((256 if order else 1, 256), np.int64)

    def rows(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = before if self.order else np.zeros(1, np.int64)
        f = self.f[k]
        q = 1 + f * (65536 - 256) // f.sum(axis=1, keepdims=True)
        q[:, 255] += 65536 - q.sum(axis=1)
        return q, np.cumsum(q, axis=1) - q

    def add(self, t: int, before: np.ndarray, s: np.ndarray) -> None:
        live = np.arange(self.count) * self.per + t < self.n
        k = before if self.order else np.zeros(self.count, np.int64)
        np.add.at(self.f, (k[live], s[live]), 24)
        while len(full := np.flatnonzero(self.f.sum(axis=1) >= 1 << 16)):
            self.f[full] = (self.f[full] + 1) >> 1


def adaptive_encode(b: bytes, order: int) -> bytes:
    x = np.frombuffer(b, np.uint8).astype(np.int64)
    n, per = lanes.lanes_of(len(x))
    m, steps = _Adaptive(order, len(x), n, per), lanes.by_step(x, n, per, 0)
    f, c, before = np.empty((per, n), np.int64), np.empty((per, n), np.int64), np.zeros(n, np.int64)
    for t in range(per):
        q, cum = m.rows(before)
        k = np.arange(n) if order else 0
        f[t], c[t] = q[k, steps[t]], cum[k, steps[t]]
        m.add(t, before, steps[t])
        before = steps[t]
    return struct.pack("<I", len(b)) + lanes.encode(f.T.ravel()[: len(x)], c.T.ravel()[: len(x)], 16, n, per)


def adaptive_decode(b: bytes, order: int) -> bytes:
    size = struct.unpack_from("<I", b)[0]
    n, per = lanes.lanes_of(size)
    m = _Adaptive(order, size, n, per)

    def step(t, before, slot):
        q, cum = m.rows(before)
        k = np.arange(n) if order else np.zeros(n, np.int64)
        s = (cum[k] <= slot[:, None]).sum(axis=1) - 1
        live = np.arange(n) * per + t < size
        s = np.where(live, s, 0)
        m.add(t, before, s)
        return s, q[k, s], cum[k, s]

    return lanes.decode(b[4:], size, 16, n, per, step).astype(np.uint8).tobytes()


class _Mixing:
    """Bit by bit: counters under hashes of the last 0 to 3 bytes and the bits before, mixed by weights that learn."""

    RATE = 5

    def __init__(self, count: int):
        self.p = np.full((4, 1 << 16), 0.5)
        self.w = np.full(4, 0.3)
        self.lanes = np.arange(count)

    def begin(self, past: np.ndarray) -> None:
        self.context = [np.zeros(len(self.lanes), np.int64), past[0], past[0] * 0x2F0B + past[1] * 0x6A09, past[0] * 0x2F0B + past[1] * 0x6A09 + past[2] * 0x1B87]

    def predict(self, node: np.ndarray) -> np.ndarray:
        self.at = [(c * 0x9E37 + node * 0x3D4D + (c >> 3)) & 0xFFFF for c in self.context]
        p = np.clip(np.stack([self.p[o, a] for o, a in enumerate(self.at)]), 1e-4, 1 - 1e-4)
        self.st = np.log(p / (1 - p))
        self.out = 1 / (1 + np.exp(-np.clip(self.w @ self.st, -9, 9)))
        return self.out

    def learn(self, bit: np.ndarray, live: np.ndarray) -> None:
        for o, a in enumerate(self.at):
            k = a[live]
            self.p[o, k] += (bit[live] - self.p[o, k]) / (1 << self.RATE)
        self.w += 0.02 * (self.st[:, live] * (bit - self.out)[live]).mean(axis=1) if live.any() else 0


class _Neural:
    """Bit by bit: a small network over the bits of the last two bytes and the bits before, learning as it goes."""

    HIDDEN = 16

    def __init__(self, count: int):
        rng = np.random.Generator(np.random.PCG64(1))
        self.a, self.b = rng.normal(0, 0.3, (self.HIDDEN, 25)), np.zeros(self.HIDDEN + 1)
        self.count = count

    def begin(self, past: np.ndarray) -> None:
        bits = [(past[i] >> k) & 1 for i in range(2) for k in range(8)]
        self.x = np.vstack([*(2.0 * v - 1 for v in bits), np.zeros((8, self.count)), np.ones((1, self.count))])

    def predict(self, node: np.ndarray) -> np.ndarray:
        depth = int(np.floor(np.log2(node[0])))
        for k in range(depth):
            self.x[16 + k] = 2.0 * ((node >> (depth - 1 - k)) & 1) - 1
        self.x[16 + depth : 24] = 0
        self.h = np.vstack((np.tanh(self.a @ self.x), np.ones((1, self.count))))
        self.out = 1 / (1 + np.exp(-np.clip(self.b @ self.h, -9, 9)))
        return self.out

    def learn(self, bit: np.ndarray, live: np.ndarray) -> None:
        if live.any():
            e = np.where(live, bit - self.out, 0.0)
            back = (self.b[:-1, None] * e) * (1 - self.h[:-1] ** 2)
            self.b += 0.1 * (self.h @ e) / live.sum()
            self.a += 0.1 * (back @ self.x.T) / live.sum()


def _bitwise_encode(b: bytes, kind) -> bytes:
    x = np.frombuffer(b, np.uint8)
    n, per = lanes.lanes_of(len(x))
    m, steps = kind(n), lanes.by_step(x, n, per, 0)
    ones, past = np.empty((8 * per, n), np.uint16), np.zeros((3, n), np.int64)  # two bytes a bit: of a 1 the frequency
    for t in range(per):
        now, live, node = steps[t].astype(np.int64), np.arange(n) * per + t < len(x), np.ones(n, np.int64)
        m.begin(past)
        for k in range(8):
            ones[8 * t + k] = np.clip((m.predict(node) * 65536).astype(np.int64), 32, 65536 - 32)
            bit = (now >> (7 - k)) & 1
            m.learn(bit, live)
            node = node * 2 + bit
        past = np.vstack((now[None], past[:-1]))

    def model(t):
        one, bit = ones[t].astype(np.int64), (steps[t // 8] >> (7 - t % 8)) & 1
        return np.where(bit, one, 65536 - one), np.where(bit, 0, one)

    return struct.pack("<I", len(b)) + lanes.encode_steps(model, 8 * len(x), 16, n, 8 * per)


def _bitwise_decode(b: bytes, kind) -> bytes:
    size = struct.unpack_from("<I", b)[0]
    n, per = lanes.lanes_of(size)
    m = kind(n)
    state = {"past": np.zeros((3, n), np.int64), "node": np.ones(n, np.int64)}

    def step(t, before, slot):
        live, k = np.arange(n) * per + t // 8 < size, t % 8
        if k == 0:
            state["node"] = np.ones(n, np.int64)
            m.begin(state["past"])
        one = np.clip((m.predict(state["node"]) * 65536).astype(np.int64), 32, 65536 - 32)
        bit = np.where(live, (slot < one).astype(np.int64), 0)
        f, c = np.where(bit, one, 65536 - one), np.where(bit, 0, one)
        m.learn(bit, live)
        state["node"] = state["node"] * 2 + bit
        if k == 7:
            state["past"] = np.vstack(((state["node"] & 255)[None], state["past"][:-1]))
        return bit, np.where(live, f, 65536), np.where(live, c, 0)

    bits = lanes.decode(b[4:], 8 * n * per, 16, n, 8 * per, step)
    return np.packbits(bits.astype(np.uint8)).tobytes()[:size]


def bwt(b: bytes) -> tuple[int, bytes]:
    """Last column of the sorted rotations, and the row of the text itself."""
    x = np.frombuffer(b, np.uint8)
    n = len(x)
    if not n:
        return 0, b""
    rank, h = x.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2) + np.roll(rank, -h)
        u, rank = np.unique(key, return_inverse=True)
        if len(u) == n or h >= n:
            break
        h *= 2
    sa = np.argsort(rank, kind="stable")
    return int(np.flatnonzero(sa == 0)[0]), x[sa - 1].tobytes()


def unbwt(row: int, last: bytes) -> bytes:
    x = np.frombuffer(last, np.uint8)
    if not len(x):
        return b""
    nxt = np.argsort(x, kind="stable").tolist()
    out, at = bytearray(len(x)), row
    for i in range(len(x)):
        at = nxt[at]
        out[i] = x[at]
    return bytes(out)


BWT_BLOCK = 1 << 18


def move_to_front(b: bytes) -> bytes:
    order, out = bytearray(range(256)), bytearray(len(b))
    for k, c in enumerate(b):
        if i := order.index(c):
            out[k] = i
            del order[i]
            order.insert(0, c)
    return bytes(out)


def unmove(b: bytes) -> bytes:
    order, out = list(range(256)), bytearray()
    for i in b:
        c = order.pop(i)
        out.append(c)
        order.insert(0, c)
    return bytes(out)


def predict(b: bytes) -> bytes:
    """operators.cells.predictor_xor on one plane: hashes depend on earlier bytes alone, so that the byte seen last under a
    hash is found by a stable sort."""
    x = np.frombuffer(b, np.uint8).astype(np.int64)
    back = [np.concatenate((np.zeros(i, np.int64), x))[: len(x)] for i in (1, 2, 3)]
    h = (back[0] ^ back[1] << 6 ^ back[2] << 12) & 0xFFFF
    o = np.argsort(h, kind="stable")
    last = np.zeros(len(x), np.int64)
    same = h[o][1:] == h[o][:-1]
    last[o[1:][same]] = x[o[:-1][same]]
    return (x ^ last).astype(np.uint8).tobytes()


def predict_inverse(r: bytes) -> bytes:
    """Undo operators.cells.predictor_xor on one plane."""
    table, h, out = {}, 0, bytearray()
    for c in r:
        v = c ^ table.get(h, 0)
        out.append(v)
        table[h] = v
        h = ((h << 6) ^ v) & 0xFFFF
    return bytes(out)


def pack_indices(b: bytes, width: int) -> bytes:
    x = np.frombuffer(b, np.uint8)
    if len(x) and int(x.max()) >> width:
        raise ValueError(f"values of more than {width} bits")
    return np.packbits(((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()


def unpack_indices(b: bytes, width: int, n: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(b, np.uint8))[: n * width].reshape(n, width)
    return (bits << np.arange(width - 1, -1, -1)).sum(axis=1).astype(np.uint8).tobytes()


def crc(b: bytes) -> int:
    return zlib.crc32(b)


def xxh64(b: bytes) -> int:
    """With seed 0 (Spark's own has seed 42), as an unsigned number."""
    return xxhash.xxh64_intdigest(b, seed=0)


def _wide(f: Callable[[bytes], bytes]) -> Callable[[bytes, Info], bytes]:
    return lambda b, info: f(b)


def _always(info: Info, n: int) -> bool:
    return True


def _entropy_under(limit: float, look: int = 8192) -> Callable[[bytes], bool]:
    def worth(b: bytes) -> bool:
        x = np.bincount(np.frombuffer(b[:look], np.uint8))
        p = x[x > 0] / max(min(len(b), look), 1)
        return float(-(p * np.log2(p)).sum()) < limit

    return worth


def _at_least(n: int) -> Callable[[bytes], bool]:
    return lambda b: len(b) >= n


@dataclass(frozen=True)
class Codec:
    """encode and decode with what is known of the plane; accepts: does it take such planes; worth: is it worth a try on
    these bytes; opt_in: only tried where a menu names it."""

    name: str
    encode: Callable[[bytes, Info], bytes]
    decode: Callable[[bytes, Info], bytes]
    accepts: Callable[[Info, int], bool] = _always
    worth: Callable[[bytes], bool] = lambda b: True
    priority: int = 0
    opt_in: bool = False


def _scales(info: Info, n: int) -> bool:
    return info.role in SCALE_ROLES and info.width == 1 and bool(info.row_len) and info.dtype in ("float8_e4m3fn", "float8_e5m2", "uint8")


def _nibbles(info: Info, n: int) -> bool:
    return info.nibble and info.role in ("value", "high", "low", "PACKED_VALUES") and n % GROUP == 0


CODECS: dict[str, Codec] = {}


def register(codec: Codec) -> Codec:
    if codec.name in CODECS:
        raise ValueError(f"there is a codec {codec.name} already")
    CODECS[codec.name] = codec
    return codec


for _c in (
    Codec("identity", _wide(identity), _wide(identity)),
    Codec("huffman", _wide(huffman_encode), _wide(huffman_decode)),
    Codec("rans", _wide(rans_encode), _wide(rans_decode)),
    Codec("zstd", _wide(zstd_encode), _wide(zstd_decode)),
    Codec("sparse", _wide(sparse_encode), _wide(sparse_decode), lambda i, n: i.width == 1),
    Codec("tans", _wide(tans_encode), _wide(tans_decode)),
    Codec("group_codebook", group_codebook_encode, group_codebook_decode, _nibbles, priority=10),
    Codec("order1_scale", order1_scale_encode, order1_scale_decode, _scales, _entropy_under(7.5), priority=10),
    Codec("huff_llm", _wide(huff_llm_encode), _wide(huff_llm_decode), lambda i, n: i.role == "raw" and i.width == 2 and n % 2 == 0, _at_least(256)),
    Codec("zstd_dict", zstd_dict_encode, zstd_dict_decode, lambda i, n: i.state is not None, opt_in=True),
    Codec("arithmetic0", _wide(arithmetic0_encode), _wide(arithmetic0_decode), opt_in=True),
    Codec("adaptive0", lambda b, i: adaptive_encode(b, 0), lambda b, i: adaptive_decode(b, 0), opt_in=True),
    Codec("adaptive1", lambda b, i: adaptive_encode(b, 1), lambda b, i: adaptive_decode(b, 1), worth=_at_least(4096), opt_in=True),
    Codec("order1", _wide(order1_encode), _wide(order1_decode), lambda i, n: i.role == "exponent", _at_least(4096), priority=10, opt_in=True),
    Codec("context_mixing", lambda b, i: _bitwise_encode(b, _Mixing), lambda b, i: _bitwise_decode(b, _Mixing), worth=_at_least(4096), opt_in=True),
    Codec("neural", lambda b, i: _bitwise_encode(b, _Neural), lambda b, i: _bitwise_decode(b, _Neural), worth=_at_least(4096), opt_in=True),
):
    register(_c)
DEFAULT_MENU = tuple(c.name for c in CODECS.values() if not c.opt_in)


def menu_for(info: Info, n: int, allowed: tuple[str, ...] | None = None) -> list[Codec]:
    """The codecs to try on a plane, by priority, then in order of registration: those that take it of the default ones, or
    of an allow-list, which may name opt-in codecs.  An allow-list that leaves none is an error."""
    if allowed is not None and (unknown := [a for a in allowed if a not in CODECS]):
        raise ValueError(f"no codec {unknown[0]}")
    got = [c for c in CODECS.values() if (c.name in allowed if allowed is not None else not c.opt_in) and c.accepts(info, n)]
    if not got:
        raise ValueError("the allow-list leaves no codec for a plane")
    return sorted(got, key=lambda c: -c.priority)


#: What a codec may raise on a plane that it can't take; the others of the menu go on.
FAILURES = (ValueError, IndexError, ZeroDivisionError, struct.error, zstandard.ZstdError)


def trials_of(b: bytes, info: Info, allowed: tuple[str, ...] | None = None):
    """(codec, place in the menu, payload or None, error) of each try."""
    for i, c in enumerate(menu_for(info, len(b), allowed)):
        if not c.worth(b):
            continue
        try:
            yield c.name, i, c.encode(b, info), None
        except FAILURES as x:
            yield c.name, i, None, str(x)


_INFO = {"role": "raw", "width": 1, "nibble": False, "row_len": None, "dtype": "uint8", "state": None}


def info_of(row: dict) -> Info:
    return Info(**{k: row.get(k) if row.get(k) is not None else d for k, d in _INFO.items()})


def evaluate(planes: DataFrame, menu: tuple[str, ...] | None = DEFAULT_MENU) -> DataFrame:
    """Trials: a row for each plane (tensor_id, chain_id, plane, bytes, and what Info knows, if there) and codec, with
    payload and size.  A codec that fails on a plane gives an error instead of a size, and the others go on."""
    schema = "tensor_id long, chain_id int, plane int, codec string, menu_pos int, payload binary, size long, error string"
    types = pa.schema([("tensor_id", pa.int64()), ("chain_id", pa.int32()), ("plane", pa.int32()), ("codec", pa.string()), ("menu_pos", pa.int32()), ("payload", pa.binary()), ("size", pa.int64()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                rows = [
                    {"tensor_id": r["tensor_id"], "chain_id": r["chain_id"], "plane": r["plane"], "codec": name, "menu_pos": at, "payload": payload, "size": None if payload is None else len(payload), "error": error}
                    for name, at, payload, error in trials_of(r["bytes"], info_of(r), menu)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return planes.select("tensor_id", "chain_id", "plane", "bytes", *(c for c in _INFO if c in planes.columns)).mapInArrow(run, schema)


def decode(chosen: DataFrame) -> DataFrame:
    """(tensor_id, chain_id, plane, bytes) of chosen trials."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one plane at a time
                row = b.slice(i, 1)
                r = row.to_pylist()[0]
                out = CODECS[r["codec"]].decode(r["payload"], info_of(r))
                yield pa.RecordBatch.from_arrays([row.column("tensor_id"), row.column("chain_id"), row.column("plane"), pa.array([out], pa.binary())], names=["tensor_id", "chain_id", "plane", "bytes"])

    return chosen.select("tensor_id", "chain_id", "plane", "codec", "payload", *(c for c in _INFO if c in chosen.columns)).mapInArrow(run, "tensor_id long, chain_id int, plane int, bytes binary")
