"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm.common import materialize, table
from tensorloom.llm.decontaminate import decontaminate_stage
from tensorloom.llm.importance import quality_stage
from tensorloom.llm.minhash_dedup import near_dedup_stage
from tensorloom.llm.mixing import mix_stage
from tensorloom.llm.suffix_dedup import dedup_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
]
#: Fitted models, edit distances and removed passages are beyond SQL: tests hold the operators against brute force, and each
#: stage against what its operator says of the stage before's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
