"""Deltas against other tensors: by XOR, of equal lengths, with the reference's digest; chains of references are undone
link by link, all tensors of a link at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = ".delta"
MOST_LINKS = 64


def delta_name(name: str) -> str:
    return name + SUFFIX


def base_name(name: str) -> str:
    """The name that a delta's name is of."""
    return name.removesuffix(SUFFIX)


def xor_bytes(a: bytes, b: bytes) -> bytes:
    if len(a) != len(b):
        raise ValueError(f"a delta needs equal lengths, not {len(a)} and {len(b)}")
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def float_delta(a: F.Column, b: F.Column) -> F.Column:
    """Difference in single precision: not exact, rounding is lost."""
    return (a.cast("float") - b.cast("float")).cast("float")


def float_undelta(d: F.Column, b: F.Column) -> F.Column:
    return (d.cast("float") + b.cast("float")).cast("float")


def _xor(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (a, b)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", `{out}` binary"

    def run(batches):
        for x in batches:
            got = [xor_bytes(p, q) for p, q in zip(x.column(a).to_pylist(), x.column(b).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in rest), pa.array(got, pa.binary())], names=[*rest, out])

    return df.select(*rest, a, b).mapInArrow(run, schema)


def against(tensors: DataFrame, references: DataFrame) -> DataFrame:
    """Tensors that name a delta_ref as XOR residuals (raw), with the digest of the reference; others as they are.

    A name that isn't there and unequal lengths are errors."""
    ref = references.select(F.col("name").alias("delta_ref"), F.col("raw").alias("_ref"), F.sha2("raw", 256).alias("delta_digest"))
    plain = tensors.where("delta_ref is null").withColumn("delta_digest", F.lit(None).cast("string"))
    got = tensors.where("delta_ref is not null").join(ref, "delta_ref", "left")
    there = F.when(F.col("_ref").isNotNull(), F.col("_ref")).otherwise(F.raise_error(F.concat(F.lit("no reference "), "delta_ref")).cast("binary"))
    return plain.unionByName(_xor(got.withColumn("_ref", there), "raw", "_ref", "raw"))


def resolve(stored: DataFrame) -> DataFrame:
    """(name, raw) of tensors that may be deltas of deltas: (name, raw, delta_ref, delta_digest).

    Each round undoes the deltas whose reference is known, by a join on the name; a circle or a missing reference leaves a
    round without any, which is an error, and a reference of another digest is one, too."""
    known = stored.where("delta_ref is null").select("name", "raw")
    open_ = stored.where("delta_ref is not null")
    left = open_.count()
    for _ in range(MOST_LINKS):
        if not left:
            return known
        ref = known.select(F.col("name").alias("delta_ref"), F.col("raw").alias("_ref"))
        ready = open_.join(ref, "delta_ref")
        right = F.when(F.col("delta_digest").isNull() | (F.sha2("_ref", 256) == F.col("delta_digest")), F.col("_ref")).otherwise(F.raise_error(F.concat(F.lit("another reference than that of "), "name")).cast("binary"))
        known = known.unionByName(_xor(ready.withColumn("_ref", right).select("name", "raw", "_ref"), "raw", "_ref", "raw"))
        open_ = open_.join(ref.select("delta_ref"), "delta_ref", "left_anti")
        rest = open_.count()
        if rest == left:
            raise ValueError("deltas without a reference, or in a circle")
        left = rest
    raise ValueError(f"more than {MOST_LINKS} links")
