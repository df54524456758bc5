"""Models for coders, fitted from counts: probability tables of whole numbers, codebooks of group histograms, and tables that
several tensors share.  Counts come from Spark aggregates (functions.stats); what is fitted here is small."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Totals of tables, centroids of a codebook, rounds and restarts of its fitting, and the most clusters.
GROUP_TOTAL, ORDER1_TOTAL = 256, 4096
CENTROIDS, ROUNDS, RESTARTS, MOST_CLUSTERS = 16, 50, 5, 8
SAMPLE = 200_000


def _to_total(q: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers of the given sum: the excess comes off the largest (the last of equals), a lack goes to the smallest
    (the first of equals), one by one, and none falls under 1."""
    q = q.astype(np.int64)
    n = len(q)
    while (over := int(q.sum()) - total) > 0:
        i = n - 1 - int(np.argmax(q[::-1]))
        if q[i] <= 1:
            break
        rest = np.delete(q, i)
        q[i] -= max(1, min(over, int(q[i] - (rest.max() if n > 1 else 1))))
    while (lack := total - int(q.sum())) > 0:
        i = int(np.argmin(q))
        rest = np.delete(q, i)
        q[i] += max(1, min(lack, int((rest.min() if n > 1 else total) - q[i])))
    return q


def quantize_pmf(counts, total: int) -> np.ndarray:
    """Counts, one more each, scaled to whole numbers of sum `total`, halves rounded up, none under 1."""
    c = np.asarray(counts, np.float64) + 1.0
    if not len(c):
        return np.zeros(0, np.int64)
    return _to_total(np.maximum(np.floor(c / c.sum() * total + 0.5), 1), total)


def quantize_centroid(p, total: int = GROUP_TOTAL) -> np.ndarray:
    """Probabilities as whole numbers of sum `total`, none under 1."""
    return _to_total(np.maximum(np.floor(np.asarray(p, np.float32) * np.float32(total) + np.float32(0.5)), 1), total)


def validate_pmf(q, total: int) -> None:
    q = np.asarray(q)
    if len(q) == 0 or q.min() < 1:
        raise ValueError("a probability of zero")
    if int(q.sum()) != total:
        raise ValueError(f"probabilities sum to {int(q.sum())}, not {total}")


@dataclass
class Order1:
    """Tables of an order-1 model: what follows nothing, and what follows each byte that was seen before another."""

    marginal: np.ndarray
    rows: dict[int, np.ndarray]

    def row(self, prev: int) -> np.ndarray:
        return self.rows.get(prev, self.marginal)

    def table(self) -> np.ndarray:
        out = np.repeat(self.marginal[None], 256, axis=0)
        for k, r in self.rows.items():
            out[k] = r
        return out

    def size(self) -> int:
        return 544 + 512 * len(self.rows)


def order1_counts(x: np.ndarray, row_len: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(joint 256 x 256, marginal): bytes that begin a row count as marginal, all others under the byte before them."""
    first = np.zeros(len(x), bool)
    first[:: row_len or max(len(x), 1)] = True
    at = np.flatnonzero(~first)
    joint = np.bincount(x[at - 1].astype(np.int64) * 256 + x[at], minlength=65536).reshape(256, 256)
    return joint, np.bincount(x[first], minlength=256)


def fit_order1(joint: np.ndarray, marginal: np.ndarray) -> Order1:
    return Order1(quantize_pmf(marginal, ORDER1_TOTAL), {int(k): quantize_pmf(joint[k], ORDER1_TOTAL) for k in np.flatnonzero(joint.sum(axis=1))})


def bits_under(joint: np.ndarray, marginal: np.ndarray, model: Order1) -> float:
    """What the counted bytes cost under a model."""
    t = -np.log2(model.table() / ORDER1_TOTAL)
    return float((joint * t).sum() + (marginal * -np.log2(model.marginal / ORDER1_TOTAL)).sum())


def divergence(p: Order1, q: Order1) -> float:
    """Symmetric Kullback-Leibler divergence of the rows, each weighed by the mean of both marginals."""
    a, b = p.table() / ORDER1_TOTAL, q.table() / ORDER1_TOTAL
    per_row = ((a - b) * (np.log2(a) - np.log2(b))).sum(axis=1)
    return float((per_row * 0.5 * (p.marginal + q.marginal) / ORDER1_TOTAL).sum())


def dendrogram(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges (left < right) by average linkage, nearest first, the first of equals; a merge goes by its left name."""
    n = len(d)
    d, size = d.astype(float).copy(), np.ones(n)
    d[np.tril_indices(n)] = np.inf
    out = []
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        out.append((i, j))
        both = np.minimum(d, d.T)  # the upper half, seen from both sides
        new = (size[i] * both[i] + size[j] * both[j]) / (size[i] + size[j])
        size[i] += size[j]
        for k in range(n):
            if k != i and np.isfinite(new[k]):
                d[min(i, k), max(i, k)] = new[k]
        d[j, :] = d[:, j] = np.inf
    return out


def clusters_at(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Cluster of each of n things after n - k merges, numbered by their smallest members."""
    root = np.arange(n)
    for i, j in merges[: n - k]:
        root[root == root[j]] = root[i]
    return np.unique(root, return_inverse=True)[1]


def fit_clusters(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[Order1]]:
    """Clusters of tensors that share a table, as many (MOST_CLUSTERS at most) as cost least: tables and bytes under them.
    Fewer clusters win ties."""
    if not counts:
        return np.zeros(0, np.int64), []
    own = [fit_order1(*c) for c in counts]
    n = len(own)
    d = np.array([[divergence(a, b) for b in own] for a in own])
    merges, best = dendrogram(d), None
    for k in range(1, min(MOST_CLUSTERS, n) + 1):
        of = clusters_at(merges, n, k)
        models = [fit_order1(sum(counts[i][0] for i in np.flatnonzero(of == c)), sum(counts[i][1] for i in np.flatnonzero(of == c))) for c in range(k)]
        cost = sum(8.0 * m.size() for m in models) + sum(bits_under(*counts[i], models[of[i]]) for i in range(n))
        if best is None or cost < best[0]:
            best = (cost, of, models)
    return best[1], best[2]


def fit_codebook(hists: np.ndarray, seeds: tuple[int, ...] = tuple(range(RESTARTS))) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of 16 probabilities, group to centroid): k-means with spread starting points, the best of several seeds by
    the sum of squares, the first of equals."""
    h = np.asarray(hists, np.float64)
    if not len(h):
        return np.full((CENTROIDS, 16), 1 / 16), np.zeros(0, np.int64)
    p = h / np.maximum(h.sum(axis=1, keepdims=True), 1)
    best = None
    for seed in seeds:
        rng = np.random.Generator(np.random.PCG64(seed))
        c = p[[int(rng.integers(len(p)))]]
        near = np.full(len(p), np.inf)
        while len(c) < CENTROIDS:
            near = np.minimum(near, ((p - c[-1]) ** 2).sum(axis=1))
            pick = int(np.searchsorted(np.cumsum(near), rng.random() * near.sum(), side="right")) if near.sum() > 0 else int(rng.integers(len(p)))
            c = np.vstack((c, p[min(pick, len(p) - 1)]))
        of = None
        for _ in range(ROUNDS):
            d = (p**2).sum(axis=1)[:, None] - 2 * p @ c.T + (c**2).sum(axis=1)[None]
            new = np.argmin(d, axis=1)
            if of is not None and (new == of).all():
                break
            of = new
            for k in range(CENTROIDS):
                if (of == k).any():
                    c[k] = p[of == k].mean(axis=0)
        spread = float(((p - c[of]) ** 2).sum())
        if best is None or spread < best[0]:
            best = (spread, c, of)
    return best[1], best[2]


def stride_sample(df: DataFrame, keys: list[str], order: str, most: int = SAMPLE) -> DataFrame:
    """Every ceil(n / most)-th row of each key, in order."""
    w = Window.partitionBy(*keys)
    got = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return got.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")


_STATES = "state_id int, codec string, tensor_id long, state binary"


def pack_order1(m: Order1) -> bytes:
    have = np.zeros(256, bool)
    have[list(m.rows)] = True
    return np.packbits(have).tobytes() + m.marginal.astype("<u2").tobytes() + b"".join(m.rows[k].astype("<u2").tobytes() for k in sorted(m.rows))


def unpack_order1(b: bytes) -> Order1:
    have = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, 32)))
    t = np.frombuffer(b, "<u2", -1, 32).reshape(-1, 256).astype(np.int64)
    for row in t:
        validate_pmf(row, ORDER1_TOTAL)
    return Order1(t[0], {int(k): t[i + 1] for i, k in enumerate(have)})


def fit_shared(counts: DataFrame, group: str = "model") -> DataFrame:
    """Tables that the scale tensors of a model share: (model, state_id, codec, tensor_id, state), a row a tensor.

    counts: (model, tensor_id, prev, byte, n) of functions.stats.order1_counts, prev null for what begins a row.  A model's
    counts (at most 65,792 numbers a tensor) come together in one task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tables = sorted(pdf["tensor_id"].unique()), []
        for i in ids:
            mine = pdf[pdf["tensor_id"] == i]
            start, rest = mine[mine["prev"].isna()], mine[~mine["prev"].isna()]
            joint, marginal = np.zeros((256, 256), np.int64), np.zeros(256, np.int64)
            marginal[start["byte"].astype(int)] = start["n"]
            joint[rest["prev"].astype(int), rest["byte"].astype(int)] = rest["n"]
            tables.append((joint, marginal))
        of, models = fit_clusters(tables)
        return pd.DataFrame({group: pdf[group].iloc[0], "state_id": of.astype("int32"), "codec": "order1_scale", "tensor_id": ids, "state": [pack_order1(models[c]) for c in of]})

    kind = counts.schema[group].dataType.simpleString()
    return counts.groupBy(group).applyInPandas(fit, f"`{group}` {kind}, {_STATES}")


def used_states(states: DataFrame, planes: DataFrame) -> DataFrame:
    """The states that some plane refers to (by state_id)."""
    return states.join(planes.where("state_id is not null").select("state_id").distinct(), "state_id", "left_semi")


def with_states(planes: DataFrame, states: DataFrame, on: tuple[str, ...] = ("tensor_id",)) -> DataFrame:
    """Planes and the state that each may use (null if none)."""
    return planes.join(states.select(*on, "state_id", "state"), list(on), "left")
