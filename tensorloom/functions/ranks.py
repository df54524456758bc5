"""Running sums and places over ordered rows of a key, without one task a key: rows are summed in ranges of the order first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RANGES = 64


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """Which of equal ranges between its least and largest value a number is in."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or hi == lo:
        return F.lit(0)
    return F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / ranges)), F.lit(ranges - 1)).cast("int")


def running(df: DataFrame, keys: list[str], order: list, within: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of value up to and with each row, in order within keys; `within` grows with the order."""
    rows = df.withColumn("_range", within).withColumn("_value", value)
    part = rows.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = part.withColumn("_before", F.sum("_sum").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_sum"))
    before = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_before")
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.sum("_value").over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_local", local).join(before, same).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def index_offsets(df: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """Adds start: where each row's bytes begin if the rows of a key are written one after another."""
    got = running(df, keys, [order], range_of(df, order), size, "_end")
    return got.select(*df.columns, (F.col("_end") - size).alias("start"))


def hashed_places(df: DataFrame, keys: list[str], hashed: Column, ties: str) -> DataFrame:
    """Adds place (from 1) within keys by a hexadecimal hash, then by a column."""
    rows = df.withColumn("_hash", hashed)
    return running(rows, keys, ["_hash", ties], F.substring("_hash", 1, 2), F.lit(1), "place").drop("_hash")


def every_nth(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each key, from the first, in order."""
    got = running(df, keys, [order], range_of(df, order), F.lit(1), "_place")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return got.join(n, same).where((F.col("_place") - 1) % F.ceil(F.col("_n") / most) == 0).select(*df.columns)


def in_chunks(df: DataFrame, keys: list[str], order: list[str], size: int, name: str = "chunk_idx") -> DataFrame:
    """Adds the number (from 0) of each row's chunk: rows of a key in order, `size` a chunk; the last has up to twice as many."""
    got = running(df, keys, order, range_of(df, order[0]), F.lit(1), "_place")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    last = F.greatest(F.floor(F.col("_n") / size) - 1, F.lit(0))
    return got.join(n, same).select(*df.columns, F.least(F.floor((F.col("_place") - 1) / size), last).cast("int").alias(name))


def registry_of(df: DataFrame, key: str, order: str, id_name: str = "chain_id") -> DataFrame:
    """(key, id): what occurs, numbered by its first occurrence.  For keys that are few, such as chains."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return first.select(key, (F.row_number().over(W.orderBy("_first", key)) - 1).alias(id_name))


def totals(df: DataFrame, keys: list[str], original: Column, stored: Column) -> DataFrame:
    """(keys, nbytes, stored, n, ratio)."""
    return df.groupBy(*keys).agg(F.sum(original).alias("nbytes"), F.sum(stored).alias("stored"), F.count("*").alias("n")).withColumn("ratio", F.col("nbytes") / F.col("stored"))


def allowed(df: DataFrame, allow: DataFrame, key: str) -> DataFrame:
    """Rows whose key an allow-list holds; an empty list is an error."""
    if not allow.limit(1).count():
        raise ValueError("an empty allow-list")
    return df.join(allow.select(key).distinct(), key, "left_semi")


def missing(required: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are required and not there."""
    return required.select(key).distinct().join(have.select(key), key, "left_anti")
