"""Chains: typed graphs of reversible blob transforms, checked and typed on the driver before any job runs.

A chain is a tuple of steps after the source; each step rewrites the planes that it names.  `propagate` gives the planes that
a chain ends in from element type and byte count alone; `forward` and `inverse` compose numpy functions, so that one Arrow
UDF runs a whole chain.  A chain has a text (`to_text`), which stores keep, so that old stores don't depend on any table.
Graphs of nodes, edges and terminals are checked by `validate` and become chains by `linear`."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import floats
from ..operators import codecs
from ..types import dtype


class ChainError(ValueError):
    pass


@dataclass(frozen=True)
class Plane:
    role: str
    width: int  # bytes of an element
    nbytes: int
    nibble: bool = False
    row_len: int | None = None


@dataclass(frozen=True)
class Step:
    op: str
    plane: int = 0
    arg: int = 0
    name: str = ""


Chain = tuple[Step, ...]
#: Values and scale of a block of packed four-bit floats.
PACKED_BLOCK = 17


def to_text(chain: Chain) -> str:
    return ">".join(f"{s.op}@{s.plane}:{s.arg}" + (f":{s.name}" if s.name else "") for s in chain)


def from_text(text: str) -> Chain:
    out = []
    for part in filter(None, text.split(">")):
        op, _, rest = part.partition("@")
        plane, arg, *name = rest.split(":")
        out.append(Step(op, int(plane), int(arg), *name))
    return tuple(out)


def _reorder(x: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Rotate the sign next to the mantissa (or back) in each element."""
    keep, exponent, sign = ((0x7FFFFF, 0xFF000000, 0x800000), (0x7F, 0xFF00, 0x80))[width == 2]
    v = x.view(f"<u{width}").astype(np.int64)
    if back:
        out = ((v >> 1) & (exponent >> 1)) | ((v << 8) & (sign << 8)) | (v & keep)
    else:
        out = ((v << 1) & exponent) | ((v >> 8) & sign) | (v & keep)
    return out.astype(f"<u{width}").view(np.uint8)


def _fp8(x: np.ndarray, mantissa: int, back: bool) -> np.ndarray:
    v, low = x.astype(np.int64), (1 << mantissa) - 1
    exponent = 0x7F & ~low
    out = ((v >> 1) & exponent) | ((v << (7 - mantissa)) & 0x80) | (v & low) if back else ((v & exponent) << 1) | ((v & 0x80) >> (7 - mantissa)) | (v & low)
    return out.astype(np.uint8)


def upper_median(v: np.ndarray) -> np.float32:
    return np.partition(v, len(v) // 2)[len(v) // 2]


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ChainError(message)


BYTE_OPS = ("e4m3", "e5m2", "predict", "bwt_mtf", "nibble_split", "zero_strip", "block_repack", "pack_bits", "mxfp4_deinterleave")


def _step_types(step: Step, planes: list[Plane], kind: str, deps: tuple[int, ...]) -> list[Plane]:
    _need(0 <= step.plane < len(planes), f"{step.op}: no plane {step.plane}")
    p = planes[step.plane]
    rest = lambda *new: planes[: step.plane] + list(new) + planes[step.plane + 1 :]
    _need(p.width == 1 or step.op not in BYTE_OPS, f"{step.op} needs bytes")
    if step.op in ("reorder32", "reorder16"):
        width = 4 if step.op == "reorder32" else 2
        _need(p.width == width and p.nbytes % width == 0, f"{step.op} needs elements of {width} bytes")
        return planes
    if step.op == "byte_split":
        _need(step.arg in (2, 4, 8) and p.width == step.arg and p.nbytes % step.arg == 0, "byte_split needs 2, 4 or 8 bytes, as many as the element has")
        return rest(*(Plane("exponent" if i == step.arg - 1 else "mantissa", 1, p.nbytes // step.arg) for i in range(step.arg)))
    if step.op == "nibble_split":
        _need(not p.nibble, "nibble_split of nibbles")
        return rest(Plane("high", 1, p.nbytes, True), Plane("low", 1, p.nbytes, True))
    if step.op == "bwt_mtf":
        return rest(Plane("index", 4, 4 * max(1, -(-p.nbytes // codecs.BWT_BLOCK))), replace(p, role=p.role))
    if step.op == "zero_strip":
        _need(1 <= step.arg <= 7, "zero_strip needs 1 to 7 bits")
        return planes
    if step.op == "block_repack":
        _need(step.arg >= 1, "block_repack needs a block size")
        return rest(Plane("scale", 1, -(-p.nbytes // step.arg)), p)
    if step.op == "pack_bits":
        _need(1 <= step.arg <= 8, "pack_bits needs 1 to 8 bits")
        return rest(Plane("index", 1, -(-p.nbytes * step.arg // 8)))
    if step.op == "mxfp4_deinterleave":
        _need(p.nbytes % PACKED_BLOCK == 0, f"mxfp4_deinterleave needs blocks of {PACKED_BLOCK} bytes")
        blocks = p.nbytes // PACKED_BLOCK
        return rest(Plane("value", 1, 16 * blocks), Plane("SCALE_BLOCK", 1, blocks, row_len=blocks or None))
    if step.op == "xor_ref":
        _need(0 <= step.arg < len(deps), f"xor_ref: no reference {step.arg}")
        _need(deps[step.arg] == p.nbytes, "xor_ref needs a reference of equal length")
        return planes
    if step.op == "concat":
        _need(step.arg >= 1 and step.plane + step.arg <= len(planes), "concat: no such planes")
        _need(len({q.width for q in planes[step.plane : step.plane + step.arg]}) == 1, "concat needs elements of one width")
        return planes[: step.plane] + [replace(p, nbytes=sum(q.nbytes for q in planes[step.plane : step.plane + step.arg]))] + planes[step.plane + step.arg :]
    if step.op == "reshape":
        _need(step.arg >= 1 and p.nbytes % step.arg == 0, "reshape needs whole rows")
        return rest(replace(p, row_len=step.arg))
    if step.op == "terminal":
        _need(bool(step.name), "terminal needs a role")
        return rest(replace(p, role=step.name, nibble=p.nibble or step.name in ("high", "low")))
    if step.op in ("spherical", "alpha_stable"):
        _need(kind in floats.FLOATS and p.width == dtype(kind).size and len(planes) == 1, f"{step.op} needs the floats of the source")
        n = p.nbytes // p.width
        if step.op == "alpha_stable":
            return [Plane("parameter", 4, 8), Plane("direction", 2, 2 * n), Plane("residual", p.width, p.nbytes)]
        _need(step.arg >= 1 and n % step.arg == 0, "spherical needs whole rows")
        return [Plane("radius", 4, 4 * (n // step.arg)), Plane("direction", 2, 2 * n), Plane("residual", p.width, p.nbytes)]
    if step.op in ("e4m3", "e5m2", "predict", "passthrough", "int_delta", "entropy"):
        return planes
    raise ChainError(f"unknown step {step.op}")


def _types(chain: Chain, kind: str, nbytes: int, role: str, row_len: int | None, deps: tuple[int, ...]) -> list[list[Plane]]:
    size = dtype(kind).size
    _need(nbytes % size == 0, f"{nbytes} bytes are no whole number of {kind}")
    out = [[Plane("raw" if role == "STANDARD" else role, size, nbytes, row_len=row_len)]]
    for s in chain:
        out.append(_step_types(s, out[-1], kind, deps))
    return out


def propagate(chain: Chain, kind: str, nbytes: int, role: str = "STANDARD", row_len: int | None = None, deps: tuple[int, ...] = ()) -> list[Plane]:
    """The planes that a chain ends in; `deps` are the lengths of its references."""
    return _types(chain, kind, nbytes, role, row_len, deps)[-1]


def _split(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(c) for c in x.reshape(-1, n).T]


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint8)


def _spherical(x: np.ndarray, kind: str, row: int) -> list[np.ndarray]:
    """Radii, directions as bfloat16, and what their product lacks to the values, XORed."""
    own = x.view(floats.FLOATS[kind])
    with np.errstate(all="ignore"):
        v = floats.values(own, kind).reshape(-1, row)
        r = np.sqrt(np.add.accumulate(v * v, axis=1, dtype=np.float32)[:, -1:]) if row else v[:, :0]
        d = floats.bits(np.where(r > 0, v / r, 0).astype(np.float32), "bfloat16")
        near = floats.bits((floats.values(d.ravel(), "bfloat16").reshape(v.shape) * r).astype(np.float32), kind)
    return [_bytes(r.astype("<f4").ravel()), _bytes(d.ravel()), _bytes(own ^ near.ravel())]


def _unspherical(planes: list[np.ndarray], kind: str, row: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        r, d = planes[0].view("<f4")[:, None], floats.values(planes[1].view("<u2"), "bfloat16").reshape(-1, row)
        near = floats.bits((d * r).astype(np.float32), kind)
    return _bytes(planes[2].view(floats.FLOATS[kind]) ^ near.ravel())


def _stable(x: np.ndarray, kind: str) -> list[np.ndarray]:
    """Location and scale (upper medians; 1 and 0 without spread), values in their units as bfloat16, and the XORed rest."""
    own = x.view(floats.FLOATS[kind])
    with np.errstate(all="ignore"):
        v = floats.values(own, kind)
        fine = v[np.isfinite(v)]
        delta = upper_median(fine) if len(fine) else np.float32(0)
        gamma = upper_median(np.abs(fine - delta)) if len(fine) else np.float32(0)
        if not gamma > 0 or not np.isfinite(gamma):
            delta, gamma = np.float32(0), np.float32(1)
        z = floats.bits((v - delta) / gamma, "bfloat16")
        near = floats.bits(floats.values(z, "bfloat16") * gamma + delta, kind)
    return [_bytes(np.array([delta, gamma], "<f4")), _bytes(z), _bytes(own ^ near)]


def _unstable(planes: list[np.ndarray], kind: str) -> np.ndarray:
    delta, gamma = planes[0].view("<f4")
    with np.errstate(all="ignore"):
        near = floats.bits(floats.values(planes[1].view("<u2"), "bfloat16") * gamma + delta, kind)
    return _bytes(planes[2].view(floats.FLOATS[kind]) ^ near)


def _bwt_blocks(b: bytes) -> list[bytes]:
    return [b[i : i + codecs.BWT_BLOCK] for i in range(0, len(b), codecs.BWT_BLOCK)] or [b""]


def forward(chain: Chain, kind: str, raw: bytes, deps: tuple[bytes, ...] = ()) -> list[bytes]:
    types = _types(chain, kind, len(raw), "STANDARD", None, tuple(map(len, deps)))
    planes = [np.frombuffer(raw, np.uint8)]
    for s, before in zip(chain, types, strict=False):
        x, w = planes[s.plane], before[s.plane].width
        new, count = [x], 1
        if s.op.startswith("reorder"):
            new = [_reorder(x, w, False)]
        elif s.op == "byte_split":
            new = _split(x, s.arg)
        elif s.op == "nibble_split":
            new = [x >> 4, x & 15]
        elif s.op in ("e4m3", "e5m2"):
            new = [_fp8(x, 3 if s.op == "e4m3" else 2, False)]
        elif s.op == "int_delta":
            v = x.view(f"<u{w}")
            new = [np.concatenate((v[:1], v[1:] - v[:-1])).view(np.uint8)]
        elif s.op == "zero_strip":
            _need(not len(x) or not int(np.bitwise_or.reduce(x)) & ((1 << s.arg) - 1), "low bits are not all zero")
            new = [x >> s.arg]
        elif s.op == "predict":
            new = [np.frombuffer(codecs.predict(x.tobytes()), np.uint8)]
        elif s.op == "bwt_mtf":
            parts = [codecs.bwt(b) for b in _bwt_blocks(x.tobytes())]
            new = [_bytes(np.array([r for r, _ in parts], "<u4")), np.frombuffer(b"".join(codecs.move_to_front(last) for _, last in parts), np.uint8)]
        elif s.op == "block_repack":
            full = np.zeros(-(-len(x) // s.arg) * s.arg, np.uint8)
            full[: len(x)] = x
            top = full.reshape(-1, s.arg).max(axis=1) if len(x) else full
            new = [top, np.repeat(top, s.arg)[: len(x)] - x]
        elif s.op == "pack_bits":
            try:
                new = [np.frombuffer(codecs.pack_indices(x.tobytes(), s.arg), np.uint8)]
            except ValueError as e:
                raise ChainError(str(e)) from e
        elif s.op == "mxfp4_deinterleave":
            blocks = x.reshape(-1, PACKED_BLOCK)
            new = [np.ascontiguousarray(blocks[:, :16]).ravel(), np.ascontiguousarray(blocks[:, 16])]
        elif s.op == "xor_ref":
            new = [x ^ np.frombuffer(deps[s.arg], np.uint8)]
        elif s.op == "concat":
            count = s.arg
            new = [np.concatenate(planes[s.plane : s.plane + count])]
        elif s.op == "spherical":
            new = _spherical(x, kind, s.arg)
        elif s.op == "alpha_stable":
            new = _stable(x, kind)
        planes[s.plane : s.plane + count] = new
    return [p.tobytes() for p in planes]


def inverse(chain: Chain, kind: str, planes: list[bytes], nbytes: int, deps: tuple[bytes, ...] = ()) -> bytes:
    """Undo the steps from the last to the first; plane counts and lengths come from the types."""
    types = _types(chain, kind, nbytes, "STANDARD", None, tuple(map(len, deps)))
    _need([len(p) for p in planes] == [t.nbytes for t in types[-1]], "planes don't have the lengths of their chain")
    now = [np.frombuffer(p, np.uint8) for p in planes]
    for s, before, after in zip(reversed(chain), reversed(types[:-1]), reversed(types[1:]), strict=True):
        n = 1 if s.op == "concat" else len(after) - len(before) + 1
        got, p = now[s.plane : s.plane + n], before[s.plane]
        x, w = got[0], p.width
        new = [x]
        if s.op.startswith("reorder"):
            new = [_reorder(x, w, True)]
        elif s.op == "byte_split":
            new = [np.stack(got, axis=1).ravel()]
        elif s.op == "nibble_split":
            new = [(got[0] << 4) | got[1]]
        elif s.op in ("e4m3", "e5m2"):
            new = [_fp8(x, 3 if s.op == "e4m3" else 2, True)]
        elif s.op == "int_delta":
            new = [np.cumsum(x.view(f"<u{w}"), dtype=f"<u{w}").view(np.uint8)]
        elif s.op == "zero_strip":
            new = [x << s.arg]
        elif s.op == "predict":
            new = [np.frombuffer(codecs.predict_inverse(x.tobytes()), np.uint8)]
        elif s.op == "bwt_mtf":
            rows, parts = got[0].view("<u4"), _bwt_blocks(got[1].tobytes())
            new = [np.frombuffer(b"".join(codecs.unbwt(int(r), codecs.unmove(b)) for r, b in zip(rows, parts, strict=True)), np.uint8)]
        elif s.op == "block_repack":
            new = [np.repeat(got[0], s.arg)[: p.nbytes] - got[1]]
        elif s.op == "pack_bits":
            new = [np.frombuffer(codecs.unpack_indices(x.tobytes(), s.arg, p.nbytes), np.uint8)]
        elif s.op == "mxfp4_deinterleave":
            new = [np.hstack((got[0].reshape(-1, 16), got[1][:, None])).ravel()]
        elif s.op == "xor_ref":
            new = [x ^ np.frombuffer(deps[s.arg], np.uint8)]
        elif s.op == "concat":
            new = np.split(x, np.cumsum([q.nbytes for q in before[s.plane : s.plane + s.arg]])[:-1])
        elif s.op == "spherical":
            new = [_unspherical(got, kind, s.arg)]
        elif s.op == "alpha_stable":
            new = [_unstable(got, kind)]
        now[s.plane : s.plane + n] = new
    return now[0].tobytes()


def measured(chain: Chain, kind: str, raw: bytes) -> list[float]:
    """Bits a byte of each plane that the chain's `entropy` steps look at."""
    out = []
    for i, s in enumerate(chain):
        if s.op == "entropy":
            x = np.bincount(np.frombuffer(forward(chain[:i], kind, raw)[s.plane], np.uint8))
            p = x[x > 0] / max(x.sum(), 1)
            out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return out


@dataclass(frozen=True)
class Graph:
    """Nodes (op, arg), node 0 the source; edges (node, output, node, input); terminals (node, output, role)."""

    nodes: tuple[tuple[str, int], ...]
    edges: tuple[tuple[int, int, int, int], ...]
    terminals: tuple[tuple[int, int, str], ...]


#: Outputs of ops that don't have one; byte_split has as many as its argument says.
OUTPUTS = {"nibble_split": 2, "bwt_mtf": 2, "block_repack": 2, "mxfp4_deinterleave": 2, "spherical": 3, "alpha_stable": 3}


def outputs_of(op: str, arg: int) -> int:
    return arg if op == "byte_split" else OUTPUTS.get(op, 1)


def validate(g: Graph, kind: str, nbytes: int, deps: tuple[int, ...] = ()) -> list[int]:
    """The nodes in an order that runs; ChainError for a source that isn't the first and only one, edges and terminals to
    what isn't there, outputs that aren't used exactly once, cycles, and types that don't fit."""
    n = len(g.nodes)
    _need(n > 0 and g.nodes[0][0] == "source" and all(op != "source" for op, _ in g.nodes[1:]), "a chain has one source, its first node")
    used: Counter = Counter()
    waits = [set() for _ in range(n)]
    for a, out, b, _ in g.edges:
        _need(0 <= a < n and 0 < b < n and 0 <= out < outputs_of(*g.nodes[a]), f"edge {a}.{out} to {b}: no such output")
        used[a, out] += 1
        waits[b].add(a)
    _need(bool(g.terminals), "a chain ends in terminals")
    for a, out, role in g.terminals:
        _need(0 <= a < n and 0 <= out < outputs_of(*g.nodes[a]) and bool(role), f"terminal {a}.{out}: no such output")
        used[a, out] += 1
    for a, (op, arg) in enumerate(g.nodes):
        for out in range(outputs_of(op, arg)):
            _need(used[a, out] == 1, f"output {a}.{out} is used {used[a, out]} times")
    order, ready = [], deque(i for i in range(n) if not waits[i])
    _need(list(ready) == [0], "every node but the source has an input")
    while ready:
        a = ready.popleft()
        order.append(a)
        for b in range(n):
            if a in waits[b]:
                waits[b].discard(a)
                if not waits[b]:
                    ready.append(b)
    _need(len(order) == n, "the chain runs in a circle")
    propagate(linear(g, order), kind, nbytes, deps=deps)
    return order


def linear(g: Graph, order: list[int]) -> Chain:
    """The graph as steps on planes, terminals last."""
    live, steps = [(0, 0)], []
    for b in order[1:]:
        op, arg = g.nodes[b]
        ins = [e[:2] for e in sorted((e for e in g.edges if e[2] == b), key=lambda e: e[3])]
        at = live.index(ins[0])
        _need(live[at : at + len(ins)] == ins and (len(ins) == 1 or op == "concat"), f"{op}: inputs must be neighbours in order")
        steps.append(Step(op, at, len(ins) if op == "concat" else arg))
        live[at : at + len(ins)] = [(b, k) for k in range(outputs_of(op, arg))]
    return (*steps, *(Step("terminal", live.index((a, out)), 0, role) for a, out, role in g.terminals))


@dataclass(frozen=True)
class Limits:
    """Bounds of the search for chains: nodes (source and terminals not counted), steps from the source, chains, seconds."""

    nodes: int = 8
    depth: int = 5
    candidates: int = 32
    seconds: float = 5.0
    cross_tensor: bool = False
    cross_plane: bool = False


REORDERS = {"reorder32": ("float32",), "reorder16": ("float16", "bfloat16"), "e4m3": ("float8_e4m3fn",), "e5m2": ("float8_e5m2",)}


def legal(chain: Chain, kind: str, limits: Limits = Limits()) -> bool:
    """Whether a chain is worth trying: within the limits, no reorder after a reorder, no split of what is split already,
    reorders and packed blocks only of their element types, references and joins only where they are allowed."""
    if len(chain) > limits.nodes:
        return False
    lines: list[tuple[str, ...]] = [()]
    for s in chain:
        if not 0 <= s.plane < len(lines):
            return False
        past = lines[s.plane]
        if len(past) >= limits.depth or (s.op in REORDERS and (kind not in REORDERS[s.op] or (past and past[-1] in REORDERS))):
            return False
        if s.op in ("byte_split", "nibble_split") and s.op in past:
            return False
        if (s.op == "xor_ref" and not limits.cross_tensor) or (s.op in ("concat", "reshape") and not limits.cross_plane) or (s.op == "mxfp4_deinterleave" and not dtype(kind).packed):
            return False
        count = s.arg if s.op == "concat" else 1
        lines[s.plane : s.plane + count] = [(*past, s.op)] * outputs_of(s.op, s.arg)
    return True


def explore(kind: str, limits: Limits = Limits()) -> Iterator[Chain]:
    """Legal chains by breadth: reorder, split, delta and prediction in all orders that fit the type, shortest first, none
    twice.  Bounded by the limits."""
    import time

    k = dtype(kind)
    end, seen, found = time.monotonic() + limits.seconds, set(), 0
    todo: deque[Chain] = deque([()])
    ops = [op for op, kinds in REORDERS.items() if k.name in kinds]
    while todo and found < limits.candidates and time.monotonic() < end:
        chain = todo.popleft()
        if chain and chain[-1].op not in REORDERS and chain not in seen:
            seen.add(chain)
            found += 1
            yield chain
        try:
            planes = propagate(chain, k.name, 8 * PACKED_BLOCK * k.size)
        except ChainError:
            continue
        last = len(planes) - 1
        tries = [Step(op) for op in ops] + [Step("passthrough", last)]
        tries += [Step("byte_split", last, planes[last].width)] if planes[last].width in (2, 4, 8) else []
        tries += [Step("nibble_split", last), Step("predict", last)] if planes[last].width == 1 else []
        tries += [Step("int_delta", last)] + ([Step("mxfp4_deinterleave", last)] if k.packed else [])
        for s in tries:
            new = (*chain, s)
            if not (s.op in REORDERS and len(planes) > 1) and legal(new, k.name, limits):
                todo.append(new)


def candidates(kind: str, role: str = "STANDARD") -> list[Chain]:
    """Chains that are tried for an element type and role, in order; a chain that a tensor doesn't fit is skipped."""
    k = dtype(kind).name
    if role != "STANDARD":
        return [(Step("passthrough"),)] + ([(Step("nibble_split"),)] if k == "float8_e4m3fn" or role == "PACKED_VALUES" else [])
    if k in ("float32", "bfloat16", "float16"):
        n = 4 if k == "float32" else 2
        base = (Step("reorder32" if n == 4 else "reorder16"), Step("byte_split", 0, n))
        return [base, (*base, Step("int_delta", n - 1)), (*base, Step("predict", n - 1)), *((*base, Step("zero_strip", 0, i)) for i in range(1, 5))]
    if k in ("float8_e4m3fn", "float8_e5m2"):
        return [(Step("e4m3" if k == "float8_e4m3fn" else "e5m2"), Step("nibble_split"))]
    if k in ("int16", "int32", "int64", "uint32"):
        n = dtype(k).size
        return [(Step("byte_split", 0, n),), (Step("int_delta"), Step("byte_split", 0, n))]
    return [(Step("passthrough"),)]


def candidate_union(kind: str, role: str = "STANDARD", cached: tuple[Chain, ...] = (), explored: bool = False, limits: Limits = Limits()) -> list[tuple[str, Chain]]:
    """(origin, chain): the production chains, then cached ones, then explored ones; what is there twice is tried once, by
    its first place."""
    out = [("production", c) for c in candidates(kind, role)] + [("cached", c) for c in cached if legal(c, kind, limits)]
    return out + ([("explored", c) for c in explore(kind, limits)] if explored else [])


def run_chains(tensors: DataFrame, roles: str | None = None) -> DataFrame:
    """(tensor_id, chain_id, chain, plane, bytes, and what codecs know of it) of every candidate of every tensor
    (tensor_id, dtype, raw[, role][, row_len])."""
    cols = ["tensor_id", "dtype", "raw", *([roles] if roles else []), *(["row_len"] if "row_len" in tensors.columns else [])]
    schema = "tensor_id long, chain_id int, chain string, plane int, bytes binary, role string, width int, nibble boolean, row_len int, dtype string"
    types = pa.schema([("tensor_id", pa.int64()), ("chain_id", pa.int32()), ("chain", pa.string()), ("plane", pa.int32()), ("bytes", pa.binary()), ("role", pa.string()), ("width", pa.int32()), ("nibble", pa.bool_()), ("row_len", pa.int32()), ("dtype", pa.string())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                r, out = b.slice(k, 1).to_pylist()[0], []
                role = r[roles] if roles else "STANDARD"
                for i, c in enumerate(candidates(r["dtype"], role)):
                    try:
                        got = forward(c, r["dtype"], r["raw"])
                    except ChainError:
                        continue
                    for j, (p, t) in enumerate(zip(got, propagate(c, r["dtype"], len(r["raw"]), role, r.get("row_len")), strict=True)):
                        out.append({"tensor_id": r["tensor_id"], "chain_id": i, "chain": to_text(c), "plane": j, "bytes": p, "role": t.role, "width": t.width, "nibble": t.nibble, "row_len": t.row_len, "dtype": r["dtype"]})
                yield pa.RecordBatch.from_pylist(out, schema=types)

    return tensors.select(*cols).mapInArrow(run, schema)
