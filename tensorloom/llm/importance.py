"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of the target (labelled good and not toxic) and of the raw corpus (every
document), give each feature a log ratio.  Features of a word: itself, its first five and four bytes, its last two bytes
(n-grams of characters), the pair that it makes with the word before, the pair of their last two bytes, and whether that
pair is one word twice.  A feature's ratio is drawn towards 0 by PRIOR pseudo-counts of its expected number, so that what
is rare in both says little.

A text is as good as its worst passage: a document's log importance weight is the least sum over PASSAGE words in a row (all
words of a shorter text).  The k documents of the largest log weight + Gumbel noise are kept, which draws k documents
without replacement in proportion to their weights (Gumbel top-k).  k is a parameter; if it isn't given, it is the number of
documents whose log weight is above the cut of fewest errors between labelled documents that the target model hasn't
seen.  The noise is from a hash of id, text and seed, so reruns agree; its spread is 1.3 and the weights of good and bad
documents lie tens apart, so it decides among documents near the k-th and seldom elsewhere.

Labels: at most LABELS rows are used (those of the smallest hashes); two thirds fit the target, the rest the cut.
Corpus counts cover every document.  Null, empty or blank text: no words, weight 0.  Null and repeated ids are scored as
they are, repeated rows alike; of equal keys at the k-th place all are kept.  No labels of a class: nothing is rejected.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, ids_of, materialize, mix, slices, table, text_bytes, trim, word_spans

LABELS = 100_000
PRIOR = 1.0
PASSAGE = 4
SEED = 9
BIG, MIDDLE, SMALL = 1 << 20, 1 << 18, 1 << 12
#: Slots of each feature: word, first five and four bytes, last two, pair of words, pair of last two, one word twice.
SLOTS = (BIG, BIG, MIDDLE, SMALL, BIG, MIDDLE, 2)
STARTS = np.concatenate(([0], np.cumsum(SLOTS)))
TOTAL = int(STARTS[-1])
CHUNK = 1 << 14
HELD_WORDS = 1 << 18
SLICE = 1 << 20


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's features (a row a feature) and offsets of each text's words."""
    buf, offs = text_bytes(arr)
    s, e, wo = word_spans(buf, offs)
    low, own = Rolling(LOWER[buf]), Rolling(buf)
    word, tail = low.raw(s, e), own.raw(np.maximum(e - 2, s), e)
    out = np.empty((len(SLOTS), len(s)), np.int32)
    first = wo[:-1][np.diff(wo) > 0]

    def before(h: np.ndarray) -> np.ndarray:
        """Each word's h and that of the word before (none before a text's first)."""
        prev = np.zeros_like(h)
        prev[1:] = h[:-1]
        prev[first] = 0
        return mix(h * np.uint64(3) + prev * np.uint64(0x9E3779B97F4A7C15))

    grams = (word, low.raw(s, np.minimum(s + 5, e)), low.raw(s, np.minimum(s + 4, e)), tail, before(word), before(tail))
    for k, (h, salt) in enumerate(zip(grams, (1, 2, 5, 3, 7, 9), strict=True)):
        out[k] = ((mix(h + np.uint64(salt)) >> np.uint64(20)) % np.uint64(SLOTS[k])).astype(np.int64) + STARTS[k]
    again = np.zeros(len(s), bool)
    again[1:] = word[1:] == word[:-1]
    again[first] = False
    out[-1] = again + STARTS[len(SLOTS) - 1]
    return out, wo


def _z(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _count(text_col: str):
    def run(batches):
        raw, target = np.zeros(TOTAL, np.int32), np.zeros(TOTAL, np.int32)
        held, few, words = [], 0, 0

        def add():
            for k, n in enumerate(SLOTS if held else ()):
                f, fit = np.concatenate([x[k] for x, _ in held]) - STARTS[k].astype(np.int32), np.concatenate([x for _, x in held])
                for total, some in ((raw, f), (target, f[fit])):
                    total[STARTS[k] : STARTS[k] + n] += np.bincount(some, minlength=n).astype(np.int32)
            held.clear()

        def told():
            for c in range(0, TOTAL, CHUNK):
                if raw[c : c + CHUNK].any():
                    both = np.stack((raw[c : c + CHUNK], target[c : c + CHUNK])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([_z(both)], pa.binary())], names=["chunk", "counts"])

        for b in slices(batches, text_col, SLICE):
            f, wo = features(b.column(text_col))
            fit = np.repeat(np.asarray(b.column("_fit").fill_null(False).cast(pa.int8())).astype(bool), np.diff(wo))
            held.append((f, fit))
            few += f.shape[1]
            words += f.shape[1]
            if few > HELD_WORDS:
                add()
                few = 0
            if words > 1 << 30:  # before a count could overflow
                add()
                yield from told()
                raw[:], target[:], few, words = 0, 0, 0, 0
        add()
        yield from told()
        trim()

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = key[0].as_py()
    total = np.zeros((2, min(CHUNK, TOTAL - chunk * CHUNK)), np.int64)
    for b in batches:
        for x in b.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_z(total)], pa.binary())], names=["chunk", "counts"])


def weights(arr: pa.Array, model: np.ndarray) -> np.ndarray:
    """Log importance weight of each text: the least sum over PASSAGE words in a row."""
    f, wo = features(arr)
    w = model[f].sum(axis=0, dtype=np.float64)
    n = np.diff(wo)
    out = np.zeros(len(n))
    if not len(w):
        return out
    first, last = np.repeat(wo[:-1], n), np.repeat(wo[1:], n)
    at = np.arange(len(w))
    total = w.copy()
    for j in range(1, PASSAGE):  # added up in one order, so that a text's weight doesn't depend on its neighbours
        total[:-j] += np.where(at[j:] < last[:-j], w[j:], 0.0)
    total[(at + PASSAGE > last) & (at > first)] = np.inf
    out[n > 0] = np.minimum.reduceat(total, wo[:-1][n > 0])
    return out


def gumbel(ids: np.ndarray, arr: pa.Array) -> np.ndarray:
    """Standard Gumbel noise from id and text."""
    buf, offs = text_bytes(arr)
    text = Rolling(buf).raw(offs[:-1], offs[1:])
    u = (mix(mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) + text) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def _score(model: np.ndarray):
    def run(batches):
        for b in slices(batches, "text", SLICE):
            w = weights(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(w), pa.array(w + gumbel(ids_of(b.column("id")), b.column("text")))], names=["id", "log_weight", "key"])

    return run


def cut_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of fewest errors between two samples, midway in its gap."""
    if not len(good) or not len(bad):
        return -np.inf
    v = np.concatenate((good, bad))
    y = np.concatenate((np.ones(len(good)), np.zeros(len(bad))))
    o = np.argsort(v, kind="stable")
    v, y = v[o], y[o]
    err = np.concatenate(([0], np.cumsum(y))) + len(bad) - np.concatenate(([0], np.cumsum(1 - y)))
    err[1:-1][v[1:] == v[:-1]] = len(v) + 1
    i = int(np.argmin(err))
    return float(v[0] - 1 if i == 0 else v[-1] + 1 if i == len(v) else (v[i - 1] + v[i]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest key, by counts in ever finer bins; only the counts of 1,024 bins come to the driver."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    for _ in range(8):
        if lo == hi:
            break
        step = (hi - lo) / 1024
        at = F.least(F.floor((F.col("key") - lo) / step), F.lit(1023)) if step > 0 else F.lit(0)
        inside = keys.where(F.col("key").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        above = 0
        for r in sorted(inside.collect(), key=lambda r: -r.bin):
            if above + r.n >= k:
                lo, hi, k = r.lo, r.hi, k - above
                break
            above += r.n
        if k == 1:
            return hi
    return lo


class Resampler:
    """The models, k and the k-th key, fitted on df and labels (id_col, quality, toxic)."""

    def __init__(self, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None):
        self.id_col, self.text_col = id_col, text_col
        few = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t")).orderBy(F.xxhash64("_id"), "_id").limit(LABELS)
        few = materialize(few.withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(3))), "labels")
        fit = few.where("_q = 1 and coalesce(_t, 0) = 0 and _fold < 2").select("_id", F.lit(True).alias("_fit"))
        docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        counts = docs.join(F.broadcast(fit), F.col("id") == F.col("_id"), "left").select("text", "_fit").mapInArrow(_count("text"), "chunk int, counts binary")
        raw, target = np.zeros(TOTAL), np.zeros(TOTAL)
        for r in counts.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").toLocalIterator():
            at = slice(r.chunk * CHUNK, (r.chunk + 1) * CHUNK)
            raw[at], target[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), np.int64).reshape(2, -1)
        share = target[: SLOTS[0]].sum() / max(raw[: SLOTS[0]].sum(), 1)
        self.model = np.log((target + PRIOR) / (raw * share + PRIOR)).astype(np.float32) if share else np.zeros(TOTAL, np.float32)
        self.scores = materialize(docs.mapInArrow(_score(self.model), "id long, log_weight double, key double"), "scores")
        held = self.scores.join(F.broadcast(few.where("_fold = 2")), F.col("id") == F.col("_id"))
        held = held.select("log_weight", F.coalesce((F.col("_q") == 1) & (F.coalesce("_t", F.lit(0)) == 0), F.lit(False)).alias("good")).toArrow()
        w, good = np.asarray(held["log_weight"]), np.asarray(held["good"]).astype(bool)
        self.cut = cut_of(w[good], w[~good])
        self.k = self.scores.where(F.col("log_weight") > F.lit(self.cut)).count() if k is None else k
        self.least = kth_largest(self.scores, self.k)

    def result(self) -> DataFrame:
        """id, log_weight, gumbel_key, kept: a row per row."""
        return self.scores.select(F.col("id").alias(self.id_col), "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= F.lit(float(self.least))).alias("kept"))

    def keep(self, df: DataFrame) -> DataFrame:
        """The kept rows of df, scored once more where they are, so that no text is shuffled."""
        id_col, text_col, model, least = self.id_col, self.text_col, self.model, self.least

        def run(batches):
            for b in slices(batches, text_col, SLICE):
                yield b.filter(pa.array(weights(b.column(text_col), model) + gumbel(ids_of(b.column(id_col)), b.column(text_col)) >= least))

        return df.mapInArrow(run, df.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Resampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).result()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: documents that the classifier rejects go.  Nulls, repeated rows and extra columns stay as they are."""
    return Resampler(docs, table(spark, sf_dir, "labels")).keep(docs)
