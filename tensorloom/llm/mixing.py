"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

A source's target comes from its weight, up to `most` times its size; what is beyond is dealt anew by weight until no
target is above.  Within a source, documents are taken with unequal probabilities: a document of n words has the weight w
of n's number of bits, and is to be taken c = min(most, level * w) times, the level being that at which the source's c
times words come to its target.  The whole part of c is a certain number of copies, the rest an inclusion probability p.
Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a hash of id and seed, and
taken in that order up to the source's words: a sample of fixed size in words.

A source has at most 64 weights, so levels come from a small table of classes (source, w).  The rank is cut without
sorting a source: words are summed in 4,096 bins of rank / (1 + rank), and only the bin in which the target is reached is
ordered, its documents being taken while the middle of their words lies within the target.

Null texts: size 0, taken 0.  Null sources: a source of their own, last.  Null ids: hashed as empty.  Ties of rank go
by id and size.  Sources without words and empty tables take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 5
BINS = 4096
#: Classes (source and weight) up to this number are broadcast (under 100 bytes each); more are joined by shuffling.
BROADCAST_CLASSES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): water filling in one pass over the sorted sources."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = src.withColumn("i", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    named = named.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
    # sources are full in order of cap / weight: the level is the first at which the next source isn't
    order = W.orderBy("ratio", "i")
    rows = named.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rows = rows.withColumn("full", F.sum("cap").over(order) - F.col("cap")).withColumn("rest", F.sum("w").over(W.partitionBy()) - F.sum("w").over(order) + F.col("w"))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(W.partitionBy()) - F.col("full")) / F.col("rest"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    return rows.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def bits(size: Column) -> Column:
    """The weight of a document: how many bits its number of words has."""
    return F.length(F.bin(size)).cast("long")


def copies(classes: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, w, source_size, target, whole, p, left) from (source, w, words) and targets: how often documents of a class
    are taken for certain, with what probability once more, and the words of a source that these are to come to."""
    named = wanted.withColumnRenamed("source", "s")
    rows = classes.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    above, rest = W.partitionBy("source").orderBy(F.desc("w")), W.partitionBy("source").orderBy("w")
    # classes are full in order of weight: the level is the first, from above, at which the class isn't
    level = (F.col("target") - most * (F.sum("words").over(above) - F.col("words"))) / F.nullif(F.sum(F.col("w") * F.col("words")).over(rest).cast("double"), F.lit(0.0))
    rows = rows.withColumn("level", level)
    whole = above.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.when(F.col("level") * F.col("w") <= most, F.col("level")), ignorenulls=True).over(whole)
    c = F.when(F.col("source_size") > 0, F.least(F.coalesce(first * F.col("w"), F.lit(float(most))), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("c", c).withColumn("whole", F.floor("c")).withColumn("p", F.col("c") - F.col("whole"))
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    return rows.withColumn("left", left).select("source", "w", "source_size", "target", "whole", "p", "left")


def pareto_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds z in (0, 1), increasing in the Pareto rank of a row of inclusion probability p (0 < p < 1)."""
    hashed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return df.withColumn("u", u).withColumn("q", (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.nullif("p", F.lit(0.0)))).withColumn("z", F.col("q") / (1 + F.col("q"))).drop("u", "q")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken: a row per row of df."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("w", bits(F.col("size"))), "sized")
    classes = materialize(sized.groupBy("source", "w").agg(F.sum("size").alias("words")), "classes")
    told = materialize(copies(classes, targets(classes.withColumnRenamed("words", "size"))), "copies")
    few = told.count() <= BROADCAST_CLASSES

    def joined(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
        y = y.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in y.columns))
        same = F.lit(True)
        for c in on:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return x.join(F.broadcast(y) if few else y, same, "left").drop(*(f"_{c}" for c in on))

    ranked = pareto_order(joined(sized, told, "source", "w"), "id", seed).withColumn("bin", F.when(F.col("p") > 0, F.least(F.floor(F.col("z") * BINS), F.lit(BINS - 1))))
    bins = ranked.where("p > 0").groupBy("source", "bin", "left").agg(F.sum("size").alias("n"))
    by_bin = bins.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bin")) - F.col("n"))
    cut = materialize(by_bin.where("before <= left and before + n > left").select("source", F.col("bin").alias("cut"), "before"), "cuts")
    cut = cut.groupBy("source").agg(F.min_by(F.struct("cut", "before"), "cut").alias("c")).select("source", "c.cut", "c.before")
    ranked = joined(ranked, cut, "source")
    at_cut = ranked.where("bin = cut").withColumn("mid", F.sum("size").over(W.partitionBy("source").orderBy("z", "id", "size").rowsBetween(W.unboundedPreceding, 0)) + F.col("before") - F.col("size") / 2)
    at_cut = at_cut.withColumn("more", (F.col("mid") <= F.col("left")).cast("long"))
    others = ranked.where("bin is null or cut is null or bin <> cut").withColumn("more", F.when(F.col("bin").isNull(), 0).otherwise((F.col("cut").isNull() | (F.col("bin") < F.col("cut"))).cast("long")))
    cols = ["id", "size", "source_size", "target", "whole", "more"]
    both = others.select(cols).unionByName(at_cut.select(cols))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: what the mix takes of each document."""
    return mix(docs)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap, (2 * source_size)::DOUBLE / CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE - (sum(cap) OVER (ORDER BY ratio, i) - cap)::DOUBLE) / ((SELECT sum(w) FROM w) - sum(w) OVER (ORDER BY ratio, i) + w)::DOUBLE AS level FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, i)) FROM l WHERE level <= ratio) * w, cap::DOUBLE)) AS target FROM l
), k AS (
  SELECT source, length(bin(size)) AS w, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), v AS (
  SELECT k.source, k.w, k.words, t.source_size, t.target,
    (t.target - (2 * (sum(words) OVER (PARTITION BY k.source ORDER BY k.w DESC) - words))::DOUBLE) / nullif((sum(k.w * words) OVER (PARTITION BY k.source ORDER BY k.w))::DOUBLE, 0) AS level
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT source, arg_max(level, w) AS level FROM v WHERE level * w <= 2 GROUP BY source
), c AS (
  SELECT d.doc_id, d.source, d.size, v.source_size, v.target, v.w, v.words,
    CASE WHEN v.source_size > 0 THEN least(coalesce(f.level * v.w, 2.0::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS r
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source AND length(bin(d.size)) = v.w LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), x AS (
  SELECT source, any_value(target) - sum(size * floor(r))::DOUBLE AS rest FROM c GROUP BY source
), u AS (
  SELECT c.*, x.rest, floor(r) AS whole, r - floor(r) AS p, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':5'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM u
), m AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE - size / 2.0::DOUBLE AS mid FROM q
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN p > 0 AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
