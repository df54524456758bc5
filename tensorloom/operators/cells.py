"""Cell-level transforms: one row a value, (keys..., pos, value).  Window sizes are a tensor's, a row's or a block's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import bits


def fp32_values(df: DataFrame, id_col: str, vec_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tensor_id, carried..., pos, v) of an array<float> column."""
    got = df.select(F.col(id_col).alias("tensor_id"), *carry, bits.float_bits(vec_col).alias("x"))
    return got.select("tensor_id", *carry, F.posexplode_outer("x").alias("pos", "v")).where("pos is not null")


def split(values: DataFrame, n: int, expr: Column | None = None) -> DataFrame:
    """n byte planes of each value (of expr, if given)."""
    keep = [c for c in values.columns if c != "v"]
    got = values.select(*keep, F.explode(bits.planes_of(F.col("v") if expr is None else expr, n)).alias("p"))
    return got.select(*keep, "p.plane", "p.byte")


def int_delta(values: DataFrame, keys: list[str], width: int) -> DataFrame:
    """First value, then wrapping differences of `width` bits."""
    mask = (1 << width) - 1 if width < 64 else -1
    w = W.partitionBy(*keys).orderBy("pos")
    return values.withColumn("d", (F.col("v") - F.lag("v", 1, 0).over(w)).bitwiseAND(F.lit(mask)))


def int_delta_inverse(deltas: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Running sums modulo 2**width; for widths up to 32, where no sum of a partition overflows a LONG."""
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumn("r", F.sum("d").over(w).bitwiseAND(F.lit((1 << width) - 1)))


def predictor_xor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Finite-context prediction: the value seen last under the same hash of the three values before, XORed out.

    The hash depends on earlier inputs only, so the last value under a hash is a lag within (keys, hash)."""
    w = W.partitionBy(*keys).orderBy("pos")
    back = [F.lag("byte", i, 0).over(w) for i in (1, 2, 3)]
    h = back[0].bitwiseXOR(F.shiftleft(back[1], 6)).bitwiseXOR(F.shiftleft(back[2], 12)).bitwiseAND(F.lit(0xFFFF))
    got = cells.withColumn("h", h)
    seen = W.partitionBy(*keys, "h").orderBy("pos")
    return got.withColumn("residual", F.col("byte").bitwiseXOR(F.lag("byte", 1, 0).over(seen)))


def block_repack(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per block the largest exponent as scale, and what each exponent lacks to it."""
    top = F.max("byte").over(W.partitionBy(*keys, F.floor(F.col("pos") / size)))
    return cells.withColumn("scale", top).withColumn("lack", F.col("scale") - F.col("byte"))


def zero_strip_bits(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How many low bits (up to 7) are zero in every byte of a plane."""
    used = cells.groupBy(*keys).agg(F.bit_or("byte").alias("used"))
    k = F.lit(7)
    for i in range(7, 0, -1):
        k = F.when(F.col("used").bitwiseAND(F.lit((1 << i) - 1)) != 0, F.lit(i - 1)).otherwise(k)
    return used.withColumn("k", k)


def mxfp4_deinterleave(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """17-byte blocks: 16 bytes of two values each (low half first), then a scale.  (values, scales)."""
    got = cells.withColumn("block", F.floor(F.col("pos") / 17)).withColumn("at", F.col("pos") % 17)
    low, high = F.col("byte").bitwiseAND(F.lit(15)), F.shiftright("byte", 4).bitwiseAND(F.lit(15))
    pair = F.array(F.struct(F.lit(0).alias("half"), low.alias("nibble")), F.struct(F.lit(1).alias("half"), high.alias("nibble")))
    values = got.where("at < 16").select(*keys, "block", "at", F.explode(pair).alias("p")).select(*keys, (F.col("block") * 32 + F.col("at") * 2 + F.col("p.half")).alias("pos"), "p.nibble")
    return values, got.where("at = 16").select(*keys, F.col("block").alias("pos"), F.col("byte").alias("scale"))


def group_histograms(nibbles: DataFrame, keys: list[str], size: int = 32) -> DataFrame:
    """16-bin counts of each group of `size` nibbles."""
    return nibbles.withColumn("grp", F.floor(F.col("pos") / size)).groupBy(*keys, "grp", "nibble").agg(F.count("*").alias("n"))


def location_scale(values: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Upper median and upper median of absolute deviations, (1, 0) where the latter is 0: an alpha-stable fit."""
    upper = lambda a: F.element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))
    got = values.groupBy(*keys).agg(F.collect_list(value).alias("a")).withColumn("delta", upper(F.col("a")))
    dev = F.transform("a", lambda v: F.abs(v - F.col("delta")))
    got = got.withColumn("mad", upper(dev))
    return got.select(*keys, F.when(F.col("mad") > 0, F.col("delta")).otherwise(0.0).alias("delta"), F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0).alias("gamma"))


def block_unpack(cells: DataFrame) -> DataFrame:
    """Undo block_repack: adds byte from scale and lack."""
    return cells.withColumn("byte", F.col("scale") - F.col("lack"))


def xor_delta(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Value by value against a reference of equal places; a place that one side lacks is an error."""
    both = a.withColumn("_a", F.lit(True)).join(b.select(*on, F.col("v").alias("ref"), F.lit(True).alias("_b")), on, "full")
    x = F.when(F.col("_a") & F.col("_b"), F.col("v").bitwiseXOR(F.col("ref"))).otherwise(F.raise_error(F.lit("a delta needs equal places")).cast("long"))
    return both.withColumn("x", x).drop("_a", "_b")


def radius(df: DataFrame, vector: str) -> DataFrame:
    """Adds radius: the Euclidean norm, summed in double precision from left to right."""
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.withColumn("radius", F.sqrt(square))
