"""Bit-level column expressions: reorderings, plane and nibble splits, and their inverses.  Values are unsigned in LONG."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def _or(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out.bitwiseOR(c)
    return out


@arrow_udf(T.ArrayType(T.LongType()))
def float_bits(v: pa.Array) -> pa.Array:
    """IEEE bits of each element of an array<float>, unsigned.  NaN payloads are kept; null elements stay null."""
    flat = v.flatten().cast(pa.float32())
    bits = pa.array(np.asarray(flat.fill_null(0)).astype("<f4", copy=False).view("<u4").astype(np.int64), mask=np.asarray(flat.is_null()))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), 0))
    offs = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(np.asarray(v.is_null()), False))
    return pa.ListArray.from_arrays(offs, bits)


def reorder32(v: Column) -> Column:
    """Sign next to the mantissa, so that the exponent fills the top byte."""
    return _or(_and(F.shiftleft(v, 1), 0xFF000000), _and(F.shiftright(v, 8), 0x800000), _and(v, 0x7FFFFF))


def restore32(r: Column) -> Column:
    return _or(_and(F.shiftright(r, 1), 0x7F800000), _and(F.shiftleft(r, 8), 0x80000000), _and(r, 0x7FFFFF))


def reorder16(v: Column) -> Column:
    return _or(_and(F.shiftleft(v, 1), 0xFF00), _and(F.shiftright(v, 8), 0x80), _and(v, 0x7F))


def restore16(r: Column) -> Column:
    return _or(_and(F.shiftright(r, 1), 0x7F80), _and(F.shiftleft(r, 8), 0x8000), _and(r, 0x7F))


def reorder_e4m3(b: Column) -> Column:
    return _or(_and(F.shiftleft(b, 1), 0xF0), _and(F.shiftright(b, 4), 0x08), _and(b, 0x07))


def restore_e4m3(r: Column) -> Column:
    return _or(_and(F.shiftright(r, 1), 0x78), _and(F.shiftleft(r, 4), 0x80), _and(r, 0x07))


def reorder_e5m2(b: Column) -> Column:
    return _or(_and(F.shiftleft(b, 1), 0xF8), _and(F.shiftright(b, 5), 0x04), _and(b, 0x03))


def restore_e5m2(r: Column) -> Column:
    return _or(_and(F.shiftright(r, 1), 0x7C), _and(F.shiftleft(r, 5), 0x80), _and(r, 0x03))


def byte_of(v: Column, i: int) -> Column:
    """Byte i, little-endian."""
    return _and(F.shiftright(v, 8 * i), 0xFF)


def planes_of(v: Column, n: int) -> Column:
    """array<struct<plane, byte>> of the n bytes of a value."""
    return F.array(*(F.struct(F.lit(i).alias("plane"), byte_of(v, i).alias("byte")) for i in range(n)))


def join_planes(*planes: Column) -> Column:
    return _or(*(F.shiftleft(p, 8 * i) for i, p in enumerate(planes)))


def nibbles_of(b: Column) -> Column:
    """array<struct<nibble_idx, nibble>>: high half first."""
    return F.array(F.struct(F.lit(0).alias("half"), _and(F.shiftright(b, 4), 15).alias("nibble")), F.struct(F.lit(1).alias("half"), _and(b, 15).alias("nibble")))
