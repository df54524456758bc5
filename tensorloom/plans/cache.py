"""Chains that worked before, by element type, role and entropy bucket; exchanged as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chain as C

SCHEMA = "dtype string, role string, bucket int, chain string"


def entries(spark: SparkSession, rows: list[tuple[str, str, int, C.Chain]]) -> DataFrame:
    return spark.createDataFrame([(k, r, b, C.to_text(c)) for k, r, b, c in rows], SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> DataFrame:
    """What is there; nothing, if nothing is."""
    return spark.read.schema(SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def save(new: DataFrame, path: str) -> int:
    """Adds what isn't there yet, and says how much that was."""
    spark = new.sparkSession
    fresh = legal_only(new).distinct().join(load(spark, path), ["dtype", "role", "bucket", "chain"], "left_anti").select("dtype", "role", "bucket", "chain")
    rows = fresh.collect()  # chains are few
    if rows:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("dtype", "role", "bucket").parquet(path)
    return len(rows)


def lookup(cached: DataFrame, kind: str, role: str, bucket: int) -> list[C.Chain]:
    got = cached.where((F.col("dtype") == kind) & (F.col("role") == role) & (F.col("bucket") == bucket)).orderBy("chain").collect()
    return [C.from_text(r.chain) for r in got]


def info(cached: DataFrame) -> DataFrame:
    return cached.groupBy("dtype", "role", "bucket").agg(F.count("*").alias("chains"))


def legal_only(table: DataFrame) -> DataFrame:
    """Chains that can be read and are legal for their element type: what an import lets in."""

    def ok(kind: str, text: str) -> bool:
        try:
            return C.legal(C.from_text(text), kind)
        except (ValueError, KeyError):
            return False

    good = [r for r in table.select("dtype", "chain").distinct().collect() if ok(r.dtype, r.chain)]
    return table.join(F.broadcast(table.sparkSession.createDataFrame(good, "dtype string, chain string")), ["dtype", "chain"], "left_semi").select(*table.columns)


def promote(cached: DataFrame, wins: DataFrame, least: int = 1) -> DataFrame:
    """(dtype, role, chain) that won at least so many tensors: chains to try always.  wins: (dtype, role, chain) of stores."""
    n = wins.groupBy("dtype", "role", "chain").count().where(F.col("count") >= least)
    return cached.select("dtype", "role", "chain").distinct().join(n, ["dtype", "role", "chain"], "left_semi")
