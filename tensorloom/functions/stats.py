"""Plane statistics as aggregates over cells (keys..., pos, byte); each sums up before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def histogram(cells: DataFrame, keys: list[str], value: str = "byte") -> DataFrame:
    return cells.groupBy(*keys, value).agg(F.count("*").alias("n"))


def dense_histogram(cells: DataFrame, keys: list[str], value: str = "byte", bins: int = 256) -> DataFrame:
    """All bins, empty ones with 0.  The grid is as large as the number of keys times bins."""
    hist = histogram(cells, keys, value)
    grid = hist.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias(value))
    return grid.join(hist, [*keys, value], "left").select(*keys, value, F.coalesce("n", F.lit(0)).alias("n"))


def entropy(cells: DataFrame, keys: list[str], value: str = "byte") -> DataFrame:
    """n, distinct values and bits a value: H = log2(total) - sum(n log2 n) / total, in one pass over the histogram."""
    hist = histogram(cells, keys, value)
    total = F.sum("n").cast("double")
    return hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), (F.log2(total) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total).alias("entropy"))


def joint_histogram(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Counts of value pairs at equal places; both sides must hold the same places."""
    x, y = a.select(*on, F.col("byte").alias("a")), b.select(*on, F.col("byte").alias("b"))
    return x.join(y, on).groupBy("a", "b").agg(F.count("*").alias("n"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """H(A) + H(B) - H(A, B) from a joint histogram, all three by one pass of grouping sets; 0 if it is empty."""
    sets = joint.groupingSets([["a"], ["b"], ["a", "b"]], "a", "b").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    part = sets.groupBy("g").agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    sign = F.when(F.col("g") == 0, -F.col("h")).otherwise(F.col("h"))
    return part.agg(F.coalesce(F.sum(sign), F.lit(0.0)).alias("mi"))


def order1_counts(cells: DataFrame, row: list[str]) -> DataFrame:
    """(prev, byte, n): first bytes of rows have no prev; others count under the byte before them in their row."""
    prev = F.lag("byte").over(W.partitionBy(*row).orderBy("pos"))
    return cells.withColumn("prev", prev).groupBy("prev", "byte").agg(F.count("*").alias("n"))


def conditional_entropy(counts: DataFrame) -> DataFrame:
    """H(byte | prev) from order-1 counts."""
    seen = counts.where("prev is not null")
    ctx = seen.groupBy("prev").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return ctx.agg(F.sum("t").alias("n"), F.count("*").alias("contexts"), (F.sum(F.col("t") * F.log2(F.col("t").cast("double")) - F.col("s")) / F.sum("t")).alias("entropy"))


def entropy_bucket(h: Column) -> Column:
    """17 buckets of half a bit."""
    return F.least(F.floor(F.greatest(F.least(h, F.lit(8.0)), F.lit(0.0)) / 0.5), F.lit(16)).cast("int")
