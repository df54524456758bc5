"""Float formats as numpy arrays of bits and values."""

from __future__ import annotations

import numpy as np

FLOATS = {"float32": "<u4", "float16": "<u2", "bfloat16": "<u2"}


def values(bits: np.ndarray, kind: str) -> np.ndarray:
    """float32 values of the bits of float32, float16 or bfloat16."""
    if kind == "float32":
        return bits.astype("<u4").view("<f4")
    if kind == "float16":
        return bits.astype("<u2").view("<f2").astype(np.float32)
    return (bits.astype(np.uint32) << 16).view("<f4")


def bits(v: np.ndarray, kind: str) -> np.ndarray:
    """Bits of float32 values in a format, rounded to even; a NaN stays a NaN."""
    v = np.ascontiguousarray(v, "<f4")
    if kind == "float32":
        return v.view("<u4")
    if kind == "float16":
        with np.errstate(over="ignore"):
            return v.astype("<f2").view("<u2")
    u = v.view("<u4").astype(np.uint64)
    r = ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(v), ((u >> 16) | 0x40).astype(np.uint16), r).astype("<u2")
