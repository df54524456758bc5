"""python -m tensorloom encode|decode|info|bench|chains: stores from the command line.

encode FROM TO [--shards N] [--rule GLOB=ROLE ...] [--quant FILE] [--allow CODEC ...]: tensor files, tar shards or other files
to a store.  decode FROM TO: a store to files named as its tensors.  info STORE: totals and codecs used.  bench FROM: each
codec's size and time.  chains DTYPE [ROLE]: what is tried."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import classify
from .plans import chain, select
from .sources import tensors


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tensorloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    enc = sub.add_parser("encode")
    enc.add_argument("source")
    enc.add_argument("target")
    enc.add_argument("--shards", type=int, default=1)
    enc.add_argument("--rule", action="append", default=[])
    enc.add_argument("--quant")
    enc.add_argument("--allow", action="append")
    dec = sub.add_parser("decode")
    dec.add_argument("source")
    dec.add_argument("target")
    sub.add_parser("info").add_argument("source")
    sub.add_parser("bench").add_argument("source")
    ch = sub.add_parser("chains")
    ch.add_argument("dtype")
    ch.add_argument("role", nargs="?", default="STANDARD")
    a = p.parse_args(argv)
    if a.command == "chains":
        for origin, c in chain.candidate_union(a.dtype, a.role, explored=True):
            print(origin, chain.to_text(c))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "encode":
        quant = None
        if a.quant:
            with open(a.quant, encoding="utf-8") as f:
                quant = f.read()
        got = classify.classify(tensors.open_any(spark, a.source), a.rule, quant=quant)
        tensors.write_store(select.encode(got, tuple(a.allow) if a.allow else None), a.target, a.shards)
    elif a.command == "decode":
        tensors.write_opaque(tensors.unchunk(select.decode(tensors.read_store(spark, a.source))), a.target)
    elif a.command == "info":
        tensors.read_index(spark, a.source).agg(F.count("*").alias("tensors"), F.sum("nbytes").alias("nbytes"), F.sum("size").alias("size")).show()
        select.explode_planes(tensors.read_store(spark, a.source)).groupBy("member.codec").agg(F.count("*").alias("planes"), F.sum("member.size").alias("size")).show()
    else:
        got = tensors.open_any(spark, a.source)
        got = got if "tensor_id" in got.columns else got.withColumn("tensor_id", F.xxhash64("name"))
        select.bench(got).groupBy("codec").agg(F.sum("nbytes").alias("nbytes"), F.sum("size").alias("size"), F.sum("encode_ns").alias("encode_ns")).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
