"""Exact sizes of payloads from statistics of a plane, so that codecs can be chosen without running them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.codecs import TOTAL_BITS, code_lengths


def sparse_size(n: Column, nonzero: Column) -> Column:
    return F.lit(5) + F.ceil(n / 2) + nonzero


def order1_state_size(contexts: Column) -> Column:
    """Tables of an order-1 model: what begins a row, a bitmap, and a row for each context that occurs."""
    return F.lit(544) + contexts * 512


def by_plane(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, identity, sparse, order1_state): sizes that are plain aggregates of cells (keys..., pos, byte)."""
    got = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("byte") != 0).alias("nonzero"))
    return got.select(*keys, "n", F.col("n").alias("identity"), sparse_size(F.col("n"), F.col("nonzero")).cast("long").alias("sparse"))


def order1_states(cells: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """(keys, size) of the tables that a plane of its own would need; rows as in functions.stats.order1_counts."""
    from pyspark.sql.window import Window as W

    prev = F.lag("byte").over(W.partitionBy(*row).orderBy("pos"))
    return cells.withColumn("prev", prev).groupBy(*keys).agg(order1_state_size(F.count_distinct("prev")).alias("size"))


def huffman_bits(hist: DataFrame, keys: list[str], most: int = TOTAL_BITS) -> DataFrame:
    """(keys, bits) of a histogram (keys, byte, n) under its Huffman code of up to `most` bits a symbol; at most 256 counts a plane reach Python."""

    def run(counts: pd.Series, symbols: pd.Series) -> pd.Series:
        out = []
        for c, s in zip(counts, symbols, strict=True):
            f = np.zeros(256, np.int64)
            f[np.asarray(s, np.int64)] = c
            out.append(int((f * code_lengths(f, most)).sum()))
        return pd.Series(out)

    f = F.pandas_udf(run, "long")
    return hist.groupBy(*keys).agg(F.collect_list("n").alias("c"), F.collect_list("byte").alias("s")).select(*keys, f("c", "s").alias("bits"))


def huffman_sizes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size) of operators.codecs.huffman_encode, from histograms of a plane's four parts (keys, pos, byte, with pos
    from 0 without gaps)."""
    n = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
    q, r = F.floor(F.col("_n") / 4), F.col("_n") % 4
    part = F.when(F.col("pos") < r * (q + 1), F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor((F.col("pos") - r * (q + 1)) / F.greatest(q, F.lit(1))))
    hist = cells.join(n, keys).groupBy(*keys, "_n", part.cast("int").alias("part"), "byte").agg(F.count("*").alias("n"))

    def run(parts: pd.Series, symbols: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for p, s, c in zip(parts, symbols, counts, strict=True):
            f = np.zeros((4, 256), np.int64)
            f[np.asarray(p, np.int64), np.asarray(s, np.int64)] = c
            total, top = f.sum(axis=0), int(np.flatnonzero(f.sum(axis=0)).max()) + 1
            bits = f[:, :top] @ code_lengths(total[:top])
            body = (1 if top <= 127 else 2) + (top + 1) // 2 + 16 + int((-(-bits // 8)).sum())
            out.append(5 + body if body < total.sum() else 1 + int(total.sum()))
        return pd.Series(out)

    f = F.pandas_udf(run, "long")
    return hist.groupBy(*keys).agg(*(F.collect_list(c).alias(c) for c in ("part", "byte", "n"))).select(*keys, f("part", "byte", "n").alias("size"))
