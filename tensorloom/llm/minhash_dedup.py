"""MinHash near-dedup with tensored banding, and exact confirmation of every link.

Texts are sets of 5-word shingles; sets with 100 * intersection >= 75 * union are linked.  Equal sets are one node.
Each node has 16 collections of two minhashes; a table's key is a pair of collections, so 32 minhashes give 120 tables
of four.  A link of similarity 0.75 shares no table with a probability of 4e-5 (fewer than two of 16 collections of
probability 0.5625 agree).

Candidates: in each table the members of a key are held against the key's smallest member, never all against all.
Every candidate pair is confirmed on full sets.  Keys of three or more members that this leaves in two or more
components are finished by an exact way: their members' shingles are counted, and two members can only be linked if
they share one of the n - ceil(0.75 n) + 1 rarest shingles of each (prefix filter), early enough that what is left of
both sets can still make up the overlap (position filter); such pairs of different components are confirmed too, so nothing that shares a key is lost, however large the key.  Links become components over all.

A node is a set, whatever the ids of its documents: it has a number of its own, and a component's id is the least of its
documents'.  Rows of one id and different sets are nodes of their own, each with its own component.

Null, empty or blank texts: an empty set, linked with nothing.  Fewer than five words: the sequence as one shingle.
Null ids: after all others (component null if it has no other id).  Repeated rows: the same node, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, components, distinct_sets, ids_of, materialize, new_name, partitions, release, shingle_hashes, slices, table, text_bytes, trim, word_hashes

COLLECTIONS, WIDTH, SHINGLE = 16, 2, 5
PER_CENT = 75
SLICE = 1 << 20
BUCKET_ROWS = 1_000_000
_A = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 62, COLLECTIONS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = np.array([(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)])


def sets_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = text_bytes(arr)
    return distinct_sets(*shingle_hashes(*word_hashes(buf, offs), SHINGLE))


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def collections_of(sh: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """16 collection values of each non-empty set: a row of int64."""
    full = np.diff(offs) > 0
    at = offs[:-1][full]
    out = np.zeros((len(offs) - 1, COLLECTIONS), np.uint64)
    for c in range(COLLECTIONS):
        acc = np.zeros(int(full.sum()), np.uint64)
        for w in range(WIDTH):
            least = np.minimum.reduceat(_finish(sh * _A[c * WIDTH + w]), at) if len(at) else acc
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + least
        out[full, c] = _finish(acc)
    return out.view(np.int64)


def _signatures(batches):
    """Of rows (id, text, th)."""
    for b in slices(batches, "text", SLICE):
        sh, offs = sets_of(b.column("text"))
        n = np.diff(offs)
        s1 = np.add.reduceat(np.append(_finish(sh * np.uint64(0x2545F4914F6CDD1D)), np.uint64(0)), np.minimum(offs[:-1], len(sh))) if len(n) else n
        s2 = np.bitwise_xor.reduceat(np.append(_finish(sh * np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0)), np.minimum(offs[:-1], len(sh))) if len(n) else n
        sig = collections_of(sh, offs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids_of(b.column("id"))), b.column("th"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "th", "n", "h1", "h2", "sig"]
        )


def _keys(n_buckets: int):
    """Each table's keys, dealt into buckets: a payload of keys and ids for each batch and bucket."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("node"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u8").reshape(-1, COLLECTIONS)
            for lo in range(0, len(ids), 4096):
                d, s = ids[lo : lo + 4096], sig[lo : lo + 4096]
                k = _finish(s[:, _PAIR[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + s[:, _PAIR[:, 1]] * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(len(_PAIR), dtype=np.uint64) * np.uint64(0x165667B19E3779F9)).ravel()
                who = np.repeat(d, len(_PAIR))
                bucket = ((k >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[o], np.arange(n_buckets + 1))
                at = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([k[o[cuts[x] : cuts[x + 1]]].tobytes() + who[o[cuts[x] : cuts[x + 1]]].tobytes() for x in at], pa.binary())], names=["bucket", "payload"])
        trim()

    return run


def _stars(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, key, size): b held against a, the smallest node of the key."""
    K, D = [], []
    for b in batches:
        for p in b.column("payload").to_pylist():
            n = len(p) // 16
            K.append(np.frombuffer(p, "<u8", n))
            D.append(np.frombuffer(p, "<i8", n, 8 * n))
    K, D = np.concatenate(K), np.concatenate(D)
    o = np.argsort(K)
    k = K[o]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    o = o[same]
    o = o[np.lexsort((D[o], K[o]))]
    k, d = K[o], D[o]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d = k[keep], d[keep]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    g = np.cumsum(first) - 1
    size = np.bincount(g) if len(g) else g
    lead = d[np.flatnonzero(first)][g] if len(g) else d
    m = ~first
    for lo in range(0, int(m.sum()), 100_000):
        s = np.flatnonzero(m)[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(lead[s]), pa.array(d[s]), pa.array(k[s].view(np.int64)), pa.array(size[g[s]].astype(np.int64))], names=["a", "b", "k", "size"])
    trim()


def _sets(batches):
    for b in slices(batches, "text", SLICE):
        sh, offs = sets_of(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([sh[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["id", "sh"])


def linked(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if 100 * min(len(a), len(b)) < PER_CENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= PER_CENT * (len(a) + len(b) - both)


def _confirm(batches):
    for b in batches:
        ok = np.array([linked(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)], bool)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "ok"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of distinct pairs, judged on full sets."""
    second = pairs.join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    return second.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long, ok boolean")


def _prefix(batches):
    """Shingles of each set as rows."""
    for b in batches:
        ids = np.asarray(b.column("id"))
        for lo in range(0, len(ids), 512):
            sh = [np.frombuffer(x, "<i8") for x in b.column("sh").slice(lo, 512).to_pylist()]
            n = np.array([len(x) for x in sh])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 512], n)), pa.array(np.concatenate(sh) if len(sh) else np.zeros(0, np.int64)), pa.array(np.repeat(n, n).astype(np.int64))], names=["id", "t", "n"])


def _rest(open_ids: DataFrame, comp: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of different components among open_ids that can be linked, by the prefix filter; and the tables they need."""
    tokens = sets.join(open_ids, "id").mapInArrow(_prefix, "id long, t long, n long")
    tokens = materialize(tokens, "tokens")
    made = [tokens]
    count = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    # rank of a shingle within its set, rarest first; those that stand alone come before all that are kept
    shared = tokens.join(count, "t")
    alone = shared.groupBy("id").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    need = F.col("n") - F.ceil(F.col("n") * PER_CENT / 100) + 1 - (F.col("n") - F.col("m"))
    rare = alone.where(need > 0).select("id", "n", (F.col("n") - F.col("m")).alias("own"), F.posexplode(F.slice("s", 1, need.cast("int"))).alias("i", "x"))
    # the first shingle that two sets share leaves each at most n - p more: p is its place among all of the set
    rare = rare.select("id", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left"), F.col("x.t").alias("t"))
    rare = rare.join(comp, "id", "left").select("id", "n", "left", "t", F.coalesce("component", "id").alias("c"))

    def enough(left, n, other):
        return (100 + PER_CENT) * left >= PER_CENT * (n + other)

    rare = materialize(rare, "rare")
    made.append(rare)
    for _ in range(2):  # drop what no set of its shingle and of another component can be linked with
        least = rare.groupBy("t").agg(F.min("n").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t", "least")
        rare = rare.join(least, "t").where(enough(F.col("left"), F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * PER_CENT / 100)))).drop("least")
    rare = materialize(rare, "rare")
    made.append(rare)
    x, y = (rare.select("t", *(F.col(c).alias(f"{s}{c}") for c in ("id", "n", "left", "c"))) for s in "xy")
    linkable = enough(F.least("xleft", "yleft"), F.col("xn"), F.col("yn"))
    near = x.join(y, "t").where((F.col("xc") < F.col("yc")) & (100 * F.least("xn", "yn") >= PER_CENT * F.greatest("xn", "yn")) & linkable)
    return near.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).distinct(), made


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th): th tells texts of one id from each other."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n, node, component): a row per row of df; component is the least id of the class; node is null for empty sets."""
    spark = df.sparkSession
    rows = _rows(df, id_col, text_col)
    sigs = materialize(rows.mapInArrow(_signatures, "id long, th long, n long, h1 long, h2 long, sig binary"), "sigs")
    least = sigs.where("n > 0").groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "th", "sig")).alias("m"))
    # numbered in order of id, so that a key's members are held against its oldest, from which copies tend to come; and
    # numbered once, in a written table: a lost executor doesn't number anew
    least = least.select("n", "h1", "h2", "m.*").orderBy("id", "th")
    nodes = materialize(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    n_buckets = max(partitions(spark), -(-count * len(_PAIR) // BUCKET_ROWS))
    dealt = nodes.select("node", "sig").mapInArrow(_keys(n_buckets), "bucket int, payload binary")
    stars = materialize(dealt.groupBy("bucket").applyInArrow(_stars, "a long, b long, k long, size long"), "stars")
    pairs = stars.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    used = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # the text of a node's least row; rows that repeat it give the same set
    of = nodes.join(used, "node").select("node", "id", "th")
    sets = materialize(rows.join(of, ["id", "th"]).select("node", "text").mapInArrow(_sets, "id long, sh binary").dropDuplicates(["id"]), "sets")
    judged = materialize(confirm(pairs, sets), "judged")
    links = judged.where("ok").select("a", "b")
    comp = components(links)
    # keys that are not one component yet, where a pair was left unseen
    wide = stars.where("size > 2").join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    wide = wide.select("k", "a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    split = wide.where("ca <> cb").select("k").distinct()
    open_ids = wide.join(split, "k").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rest, made = _rest(open_ids, comp, sets)
    more = materialize(confirm(rest.join(pairs, ["a", "b"], "left_anti"), sets).where("ok").select("a", "b"), "more")
    if more.limit(1).count():
        old = comp
        comp = components(links.unionByName(more))
        release(old)
    release(stars, sets, judged, more, *made)
    named = nodes.join(comp.withColumnRenamed("id", "node"), "node", "left").select("n", "h1", "h2", "node", "id", F.coalesce("component", "node").alias("root"))
    label = named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root").select("n", "h1", "h2", "node", "component")
    got = sigs.select("id", "th", "n", "h1", "h2").join(label, ["n", "h1", "h2"], "left")
    return got.select("id", "th", "n", "node", F.coalesce("component", "id").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (smallest id reachable), kept (id is its component)."""
    null = lambda c: F.nullif(c, F.lit(NULL_ID))
    return _classes(df, id_col, text_col).select(null("id").alias(id_col), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: one row of each class stays, the one of the smallest id (ties by a hash of the text, and one row
    of those that repeat id and text).  Empty texts all stay."""
    got = _classes(docs, "doc_id", "text").where("node is not null")
    rows = materialize(got.groupBy("id", "th").agg(F.count("*").alias("n"), F.min("component").alias("component"), F.min("node").alias("node")), "classes")
    # classes of null ids alone have no id to tell them apart: their nodes do
    label = F.when(F.col("component") == NULL_ID, F.col("node"))
    first = rows.groupBy("component", label.alias("l")).agg(F.min(F.struct("id", "th")).alias("m")).select("m.id", "m.th")
    gone = rows.join(first, ["id", "th"], "left_anti").select(F.col("id").alias("_i"), F.col("th").alias("_h"))
    again = rows.where("n > 1").join(first, ["id", "th"], "left_semi").select(F.col("id").alias("_i"), F.col("th").alias("_h"))
    i, h = new_name(docs, "_id"), new_name(docs, "_hash")
    own = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(h, F.xxhash64("text"))
    same = (F.col(i) == F.col("_i")) & (F.col(h) == F.col("_h"))
    own = own.join(gone, same, "left_anti")
    one = own.join(again, same, "left_semi").dropDuplicates([i, h])
    return own.join(again, same, "left_anti").unionByName(one).select(*docs.columns)


__all__ = ["near_duplicates", "near_dedup_stage", "op7"]
