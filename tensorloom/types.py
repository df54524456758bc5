"""Element types, roles and limits of the data model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dtype:
    name: str
    code: int
    size: int
    packed: bool = False


#: Names, codes and byte sizes of element types.
DTYPES = {d.name: d for d in (
    Dtype("float32", 1, 4), Dtype("float16", 4, 2), Dtype("bfloat16", 6, 2), Dtype("uint8", 13, 1), Dtype("uint32", 15, 4), Dtype("int8", 17, 1), Dtype("int16", 19, 2),
    Dtype("int32", 21, 4), Dtype("int64", 23, 8), Dtype("bool", 24, 1), Dtype("float8_e4m3fn", 29, 1), Dtype("float8_e5m2", 30, 1), Dtype("float4_e2m1fn_x2", 31, 1, True),
)}
ALIASES = {"float": "float32", "half": "float16", "short": "int16", "int": "int32", "long": "int64"}
#: Spellings of element types in tensor files.
FILE_TYPES = {"F32": "float32", "F16": "float16", "BF16": "bfloat16", "U8": "uint8", "U32": "uint32", "I8": "int8", "I16": "int16", "I32": "int32", "I64": "int64", "BOOL": "bool", "F8_E4M3": "float8_e4m3fn", "F8_E5M2": "float8_e5m2", "F4": "float4_e2m1fn_x2"}
ROLES = ("STANDARD", "SCALE_BLOCK", "SCALE_GLOBAL", "PACKED_VALUES")
TENSOR_SCHEMA = "tensor_id long, write_seq int, name string, dtype string, shape array<long>, row_len int, nbytes long, chunk_idx int, raw binary"


def dtype(name: str) -> Dtype:
    return DTYPES[ALIASES.get(name, name)]
