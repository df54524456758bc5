"""Exact top-k search by dual cover trees.

Components become floor(1024 * x); the score is the integer inner product.  Queries and candidates are cut into blocks;
each pair of blocks is one group, and each query's best of all groups are put together at the end.  Within a group both
blocks get a cover tree: a node has a centre and a covering radius, its children's centres are apart by a part of the
radius and cover it.  A pair of nodes is skipped when

    cq . cx + |cq| rx + |cx| rq + rq rx < the least that the worst k-th score in the query node can be

since no score in it can then enter any of the node's lists.  That least is first taken from the lower bounds of data
nodes that hold k rows together, and handed down to the query node's children; at a leaf it is the worst k-th score
found so far.  Equal bounds are not skipped, because ties go to the smaller id.  All that is left is scored exactly in
integers, so the result is exact whatever the trees look like.

Vectors that are null, empty of numbers, or hold null or non-finite components take no part, nor do null ids.  Shorter vectors
count as padded with zeros.  A row of a repeated id is a candidate of its own, but never one of its own id; query rows of
one id are queries of their own, each with its list.  No queries or no candidates: no rows.  Vectors whose score with
themselves doesn't fit 62 bits take no part either: no other score of the rest is too large for a long.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, table

K = 10
EVERY = 100
SCALE = 1024
DATA_BLOCK, QUERY_BLOCK = 8192, 4096
LEAF, SHRINK = 32, 0.8
_BLOB = "block long, n long, payload binary"


def _prepare(id_col: str, vec_col: str):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                c = b.slice(lo, 4096)
                ids = c.column(id_col).cast(pa.int64())
                rows, keep = [], []
                for i, v in zip(ids.to_pylist(), c.column(vec_col), strict=True):
                    if i is None or not v.is_valid:
                        continue
                    x = v.values
                    if x is None or x.null_count:
                        continue
                    y = np.floor(SCALE * np.asarray(x.cast(pa.float64())))
                    if len(y) and np.isfinite(y).all():
                        if np.abs(y).max() >= 2**31 or float(np.dot(y, y)) >= 2**62:
                            continue
                        keep.append(i)
                        rows.append(y.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(rows, pa.binary())], names=["id", "v"])

    return run


class Tree:
    """A cover tree over the rows of x, as arrays: children of a node follow each other in `kids`; leaves hold rows."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.centre, self.radius, self.kids, self.rows = [], [], [], []
        self._add(np.arange(len(x)), 0)
        c = self.x[self.centre]
        self.c, self.norm, self.r = c, np.sqrt((c * c).sum(axis=1)), np.array(self.radius)
        self.count = np.array([0 if r is None else len(r) for r in self.rows], np.int64)
        for n in range(len(self.kids) - 1, -1, -1):  # children come after their parents
            self.count[n] += sum(int(self.count[k]) for k in self.kids[n])

    def bounds(self, nodes: np.ndarray, centre: np.ndarray, norm: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """No score between a row of these nodes and one within radius of the centre is above the first or below the second."""
        mid = self.c[nodes] @ centre
        off = norm * self.r[nodes] + self.norm[nodes] * radius + radius * self.r[nodes]
        off += 1e-9 * (np.abs(mid) + off + norm * self.norm[nodes]) + 1e-6
        return mid + off, mid - off

    def _add(self, rows: np.ndarray, centre: int) -> int:
        todo, first = [(rows, centre, -1)], 0
        while todo:
            rows, centre, parent = todo.pop()
            me = len(self.centre)
            if parent >= 0:
                self.kids[parent].append(me)
            d = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(float(d.max()) * (1 + 1e-12))
            self.kids.append([])
            if len(rows) <= LEAF or self.radius[-1] == 0:
                self.rows.append(rows)
                continue
            self.rows.append(None)
            # separated centres: each row not yet within reach of one becomes one; then each row goes to the nearest
            reach = self.radius[-1] * SHRINK
            near, owner, centres = d, np.zeros(len(rows), np.int64), [centre]
            while len(centres) < 64 and (far := int(np.argmax(near))) >= 0 and near[far] > reach:
                centres.append(int(rows[far]))
                e = np.sqrt(((self.x[rows] - self.x[centres[-1]]) ** 2).sum(axis=1))
                closer = e < near
                owner[closer] = len(centres) - 1
                near = np.minimum(near, e)
            if len(centres) == 1:  # one farthest row splits what has no second centre
                far = int(np.argmax(d))
                centres.append(int(rows[far]))
                owner[np.sqrt(((self.x[rows] - self.x[centres[1]]) ** 2).sum(axis=1)) < d] = 1
            for i, c in enumerate(centres):
                mine = rows[owner == i]
                if len(mine):
                    todo.append((mine, c, me))
        return first


def dual_top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best rows of x, best first, ties to the smaller id."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < 2**52
    tq, tx = Tree(q), Tree(x)
    xf = x.astype(np.float64) if exact else x
    qf = q.astype(np.float64) if exact else q
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]
    times = int(np.unique(x_ids, return_counts=True)[1].max(initial=0))
    todo = [(0, np.array([0]), -np.inf)]
    while todo:  # pairs of a query node and the data nodes that may still hold one of its best
        node, front, floor = todo.pop()
        upper, lower = tx.bounds(front, tq.c[node], tq.norm[node], tq.r[node])
        # data nodes of k rows of other ids, together, score at least this much with each query of the node
        best = np.argsort(-lower, kind="stable")
        enough = int(np.searchsorted(np.cumsum(tx.count[front[best]]), k + times))
        if enough < len(best):
            floor = max(floor, float(lower[best[enough]]))
        front = front[upper >= floor]
        if tq.rows[node] is None:
            wide = tx.r[front] > tq.r[node]  # the wider side is opened first
            front = np.array([c for n, w in zip(front.tolist(), wide.tolist(), strict=True) for c in (tx.kids[n] if w and tx.kids[n] else [n])], np.int64)
            todo += [(child, front, floor) for child in tq.kids[node]]
            continue
        rows = tq.rows[node]
        ids, scores = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.int64)
        bound = tx.bounds(front, tq.c[node], tq.norm[node], tq.r[node])[0]
        while len(front):  # the best bounds first: inner nodes give way to their children, leaves are scored
            order = np.argsort(-bound, kind="stable")
            front, bound = front[order], bound[order]
            alive = int(np.searchsorted(-bound, -floor, side="right"))
            now, front, bound = front[: min(alive, 32)], front[32:alive], bound[32:alive]
            inner = np.array([c for n in now.tolist() for c in tx.kids[n]], np.int64)
            if len(inner):
                front, bound = np.append(front, inner), np.append(bound, tx.bounds(inner, tq.c[node], tq.norm[node], tq.r[node])[0])
            leaves = [tx.rows[n] for n in now.tolist() if tx.rows[n] is not None]
            if not leaves:
                continue
            cand = np.concatenate(leaves)
            s = (qf[rows] @ xf[cand].T).astype(np.int64)
            ci = np.broadcast_to(x_ids[cand], s.shape)
            s = np.where(ci == q_ids[rows][:, None], np.iinfo(np.int64).min, s)
            ids, scores = np.concatenate((ids, ci), axis=1), np.concatenate((scores, s), axis=1)
            best = np.lexsort((ids, -scores.astype(np.float64) if exact else np.invert(scores)), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, best, axis=1), np.take_along_axis(scores, best, axis=1)
            if scores.shape[1] == k and (worst := int(scores[:, -1].min())) > np.iinfo(np.int64).min:
                floor = max(floor, float(worst))
        for i, r in enumerate(rows):
            ok = scores[i] > np.iinfo(np.int64).min
            out[r] = (ids[i][ok], scores[i][ok])
    return out


def _blob(batches):
    for b in batches:
        blocks = np.asarray(b.column("block"))
        for x in np.unique(blocks):
            c = b.filter(pa.array(blocks == x))
            v = c.column("v").to_pylist()
            ids = np.asarray(c.column("id"))
            sizes = np.array([len(y) // 8 for y in v], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([len(v)]), pa.array([struct.pack("<q", len(v)) + ids.tobytes() + sizes.tobytes() + b"".join(v)], pa.binary())], names=["block", "n", "payload"])


def _unblob(payloads: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, vectors = [], []
    for p in payloads:
        n = struct.unpack_from("<q", p)[0]
        ids.append(np.frombuffer(p, "<i8", n, 8))
        sizes = np.frombuffer(p, "<i8", n, 8 + 8 * n)
        flat = np.frombuffer(p, "<i8", -1, 8 + 16 * n)
        vectors += np.split(flat, np.cumsum(sizes)[:-1]) if n else []
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), vectors


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, queries = [], []
        for b in batches:
            for kind, p in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                (queries if kind else data).append(p)
        xi, xv = _unblob(data)
        qi, qv = _unblob(queries)
        if not len(xi) or not len(qi):
            return
        qn, qv = np.array([v[0] for v in qv]), [v[1:] for v in qv]  # a query's number comes before its components
        width = max(map(len, xv + qv))
        got = dual_top_k(_matrix(qv, width), qi, _matrix(xv, width), xi, k)
        n = [len(g[0]) for g in got]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qn, n)), pa.array(np.repeat(qi, n)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of df for each row of queries (both of id and vector)."""
    def ready(x: DataFrame, tag: str) -> DataFrame:
        return materialize(x.select(id_col, vec_col).mapInArrow(_prepare(id_col, vec_col), "id long, v binary"), tag)

    x = ready(df, "vectors")
    # queries are numbered in a written table
    q = materialize(ready(queries, "queries").withColumn("n", F.monotonically_increasing_id()), "numbered")
    little = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("n"), 16, "0"), i, 2) for i in range(15, 0, -2))))
    q = q.select("id", F.concat(little, "v").alias("v"))
    nx, nq = (max(1, -(-t.count() // size)) for t, size in ((x, DATA_BLOCK), (q, QUERY_BLOCK)))

    def dealt(t: DataFrame, n: int) -> DataFrame:
        """Blocks by a hash of id, as payloads."""
        return t.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).mapInArrow(_blob, _BLOB)

    pairs_x = dealt(x, nx).select(F.col("block").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"), F.lit(0).alias("kind"), "payload")
    pairs_q = dealt(q, nq).select(F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("bx"), F.col("block").alias("bq"), F.lit(1).alias("kind"), "payload")
    both = pairs_x.select(F.col("bx").cast("long"), F.col("bq").cast("long"), "kind", "payload").unionByName(pairs_q.select(F.col("bx").cast("long"), F.col("bq").cast("long"), "kind", "payload"))
    found = both.groupBy("bx", "bq").applyInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where(F.col("vec_id") % EVERY == 0))


OP4_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
