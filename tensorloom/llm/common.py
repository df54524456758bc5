"""Shared pieces of the training-data operators: shared storage, Arrow text access, rolling hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes that are not one of these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A null id sorts after every other id and stands for no other row.
NULL_ID = np.iinfo(np.int64).max

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a folder of our own will do if
    the driver is the only machine; on a cluster it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tensorloom-"))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tl_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(t._tl_path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def new_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array (null: empty) and the n + 1 offsets into them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    _, offs, data = arr.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, o - o[0]


def ids_of(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.cast(pa.int64()).fill_null(NULL_ID))


def trim() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep no such heap
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's bytes come to about `most` at a time (a longer row stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, o = text_bytes(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(o, o[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit words (Murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = (n + (1 << 18) - 1) >> 18 << 18
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(m, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any byte ranges of a buffer, from one pass of prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.pw, self.inv = powers(n + 1)
        self.s = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.pw[:n], out=self.s[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.s[b] - self.s[a]) * self.inv[a]

    def grams(self, k: int) -> np.ndarray:
        """Of all k-grams, in order of place."""
        return mix((self.s[k:] - self.s[:-k]) * self.inv[: len(self.s) - k])


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each text's words into them.  Words never cross texts."""
    n = len(buf)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True  # a text begins here
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    prev[edge[:n]] = False
    start = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(n, bool)
    nxt[:-1] = inside[1:]
    nxt[:-1][edge[1:n]] = False
    end = np.flatnonzero(inside & ~nxt) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, in order, and n + 1 offsets of each text's words."""
    if lower:
        buf = LOWER[buf]
    s, e, wo = word_spans(buf, offs)
    return mix(Rolling(buf).raw(s, e) + (e - s).astype(np.uint64)), wo


def shingle_hashes(words: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles; a text of fewer words (but one at least) has its whole sequence."""
    n, counts = len(words), np.diff(offs)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(many)))
    sh = np.zeros(out[-1], np.uint64)
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    if n >= k:
        acc = sum((words[j : n - k + 1 + j] * mult[j] for j in range(1, k)), words[: n - k + 1] * mult[0])
        long = counts >= k
        first = np.repeat(offs[:-1][long] - out[:-1][long], many[long])
        at = np.flatnonzero(np.repeat(long, many))
        sh[at] = acc[at + first]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[offs[i] : offs[i + 1]]
        sh[out[i]] = np.uint64((sum(int(x) * int(m) for x, m in zip(w, mult, strict=False)) + 0x5851F42D4C957F2D * len(w)) % (1 << 64))
    return mix(sh), out


def distinct_sets(sh: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats, with new offsets."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    o = np.lexsort((sh, doc))
    sh, doc = sh[o], doc[o]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    sh, doc = sh[keep], doc[keep]
    return sh, np.searchsorted(doc, np.arange(len(offs)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over the edges, for each id that has an edge.

    Every round each id takes the smallest label among its neighbours and its label's label (hooking and pointer
    jumping), so a chain of n ids takes about log n rounds.  Labels are summed up before each shuffle; every round
    is cut off by a written table, and only the count of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("m"))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        # what an id learns, its old label learns too: the tree's root hooks onto the smaller one
        told = labels.join(near, labels.id == near.u).select("id", "component", F.least("component", "m").alias("m"))
        root = told.where("m < component").groupBy(F.col("component").alias("r")).agg(F.min("m").alias("rm"))
        new = (
            told.join(root, told.id == root.r, "left")
            .select("id", F.col("component").alias("old"), F.least("m", F.coalesce("rm", "m")).alias("m"))
            .join(jump, F.col("m") == F.col("j"), "left")
            .select("id", "old", F.least("m", F.coalesce("jc", "m")).alias("component"))
        )
        nxt = materialize(new, "labels")
        changed = nxt.where("old <> component").limit(1).count()
        release(labels)
        labels = nxt.select("id", "component")
        labels._tl_path = nxt._tl_path
        if not changed:
            release(both)
            return labels
