"""Tensor files as they arrive: a file stream whose batches are encoded and appended to a store."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import select
from ..sources.tensors import parse_file


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file, tensor) rows; tensor ids are hashes of file and name."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                got = parse_file(data)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(got)), pa.array([t["name"] for t in got], pa.string()), pa.array([t["dtype"] for t in got], pa.string()), pa.array([t["raw"] for t in got], pa.binary())], names=["file", "name", "dtype", "raw"])

    return files.select("path", "content").mapInArrow(run, "file string, name string, dtype string, raw binary").withColumn("tensor_id", F.xxhash64("file", "name"))


def encode_arrivals(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Encode what is there and append it, each batch once: a batch writes its own folder, so a replay overwrites it."""
    return watch(spark, path).writeStream.foreachBatch(lambda df, n: select.encode(df).write.mode("overwrite").parquet(f"{store}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
