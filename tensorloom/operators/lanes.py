"""Range asymmetric numeral systems over many lanes that step together in numpy, for static models of any order.

A plane is cut into lanes of equal length; step t codes symbol t of every lane.  A lane's state is a 64-bit word that gives
or takes 32 bits at a time, and all lanes share one stream of such words, in the order in which the decoder wants them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LOW = np.uint64(1 << 31)
LANE_SYMBOLS = 1024


def lanes_of(n: int, multiple: int = 1) -> tuple[int, int]:
    """(lanes, symbols of a lane): about LANE_SYMBOLS each, a whole multiple."""
    if not n:
        return 1, 0
    per = -(-max(min(n, LANE_SYMBOLS), -(-n // 4096)) // multiple) * multiple
    return -(-n // per), per


def by_step(x: np.ndarray, lanes: int, per: int, fill) -> np.ndarray:
    """A row a step, a column a lane."""
    out = np.full(lanes * per, fill, x.dtype)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(lanes, per).T)


def encode(freq: np.ndarray, cum: np.ndarray, bits: int, lanes: int, per: int) -> bytes:
    """States and words of symbols with frequencies of total 2**bits; what fills up the last lane costs nothing."""
    f, c = by_step(freq.astype(np.uint32), lanes, per, 1 << bits), by_step(cum.astype(np.uint32), lanes, per, 0)
    return encode_steps(lambda t: (f[t], c[t]), len(freq), bits, lanes, per)


def encode_steps(model: Callable[[int], tuple[np.ndarray, np.ndarray]], n: int, bits: int, lanes: int, per: int) -> bytes:
    """The same where model(t) says frequencies and cumulative frequencies of step t, asked for from the last step to the first:
    no table of them is held.  What it says of the last lane after the n-th symbol doesn't matter."""
    x, words = np.full(lanes, LOW, np.uint64), []
    shift, half, low = np.uint64(63 - bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    short = n - (lanes - 1) * per
    for t in range(per - 1, -1, -1):
        ft, ct = (v.astype(np.uint64) for v in model(t))
        if t >= short:
            ft[-1], ct[-1] = 1 << bits, 0
        full = x >= (ft << shift)
        if full.any():
            words.append((x[full] & low).astype("<u4"))
            x = np.where(full, x >> half, x)
        q = x // ft
        x = (q << np.uint64(bits)) + (x - q * ft) + ct
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode(data: bytes, n: int, bits: int, lanes: int, per: int, model: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Symbols (of a byte at most); model(t, before, slots) says symbol, frequency and cumulative frequency at each lane's slot.

    before: the last step's symbols.  Lanes that are full at step t must be told (frequency 2**bits) by the model."""
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", -1, 8 * lanes).astype(np.uint64) if len(data) > 8 * lanes else np.zeros(0, np.uint64)
    out = np.zeros((per, lanes), np.uint8)
    mask, at, before = np.uint64((1 << bits) - 1), 0, np.zeros(lanes, np.int64)
    short = n - (lanes - 1) * per  # symbols of the last lane
    for t in range(per):
        slot = (x & mask).astype(np.int64)
        s, f, c = model(t, before, slot)
        if t >= short:  # the last lane is full: its symbol had no cost
            f, c = f.copy(), c.copy()
            f[-1], c[-1] = 1 << bits, 0
        x = f.astype(np.uint64) * (x >> np.uint64(bits)) + (slot - c).astype(np.uint64)
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
        out[t] = before = s
    return out.T.ravel()[:n]
