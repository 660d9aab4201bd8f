"""Centroid clustering by sort-means: exact k-means rounds over integer vectors that look at few centroids for each vector.

Each round orders, for every centroid, the others by their distance from it.  A vector starts at the centroid it was
assigned to before and scans the others in that order until one lies strictly beyond twice the vector's distance to its old
centroid: by the triangle inequality no later one can be nearer, nor as near.  All vectors of an Arrow batch that share an old
centroid scan together, those still in the scan being the far end of their distances in order.

Arithmetic is on integers.  Distances of a batch whose sums could pass 62 bits are worked out with Python's integers.
Sums of components are kept in digits of base 2**40, each added up by Spark as a decimal, so means are exact at any size.

Scale: one pass over the vectors a round, written with their assignment and with the task's sums beside them, so nothing is
shuffled but k rows of sums per task.  Only centroids (k rows, a parameter) reach the driver and the workers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import drop, find_package, pieces, written

K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, "1"
_BASE = 1 << 40
_LONG = (1 << 63) - 1
STATE = "vec_id long, embedding array<double>, cluster int, digit int, n long, sums array<long>"
_STATE = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("cluster", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as int64 where squared distances fit, else as Python's integers."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 27 and x.shape[1] <= 128:
        return y.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return np.array([[exact(v) for v in row] for row in x.tolist()], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Centers:
    """Centroids in order, and the others of each by distance from it."""

    def __init__(self, rows: list[list[int]]) -> None:
        small = all(abs(v) < 1 << 27 for r in rows for v in r) and len(rows[0]) <= 128
        self.at = np.array(rows, np.int64 if small else object)
        self.apart = [squared(self.at, c) for c in self.at]
        self.order = [sorted((j for j in range(len(rows)) if j != i), key=lambda j, d=d: (d[j], j)) for i, d in enumerate(self.apart)]

    def nearest(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number) and its squared distance."""
        if x.dtype == object or self.at.dtype == object:
            x = x.astype(object)
        cluster, distance = old.copy(), np.zeros(len(x), x.dtype)
        for c in np.unique(old).tolist():
            mine = np.flatnonzero(old == c)
            first = squared(x[mine], self.at[c])
            order = np.argsort(first, kind="stable")
            mine, first = mine[order], first[order]
            best, least = np.full(len(mine), c), first.copy()
            for j in self.order[c]:
                far = int(np.searchsorted(4 * first, self.apart[c][j]))  # squares: four times the old distance's
                if far == len(mine):
                    break
                d = squared(x[mine[far:]], self.at[j])
                better = (d < least[far:]) | ((d == least[far:]) & (j < best[far:]))
                least[far:] = np.where(better, d, least[far:])
                best[far:] = np.where(better, j, best[far:])
            cluster[mine], distance[mine] = best, least
        return cluster, distance


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, size)


def _old(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)


def _digits(total: list[int]) -> list[list[int]]:
    """Numbers as digits of base 2**40, the lowest first; the highest has the sign."""
    out = []
    while any(v not in (0, -1) for v in total) or not out:
        out.append([v % _BASE for v in total])
        total = [v >> 40 for v in total]
    if any(total):
        out.append(total)
    return out


def _round(centers: list[list[int]], scale: int):
    """Vectors with their new cluster, then the task's sums by cluster."""

    def run(batches):
        c = Centers(centers)
        k, size = c.at.shape
        n, sums = np.zeros(k, np.int64), [[0] * size for _ in range(k)]
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            x = scaled(_vectors(batch, size), scale)
            cluster, _ = c.nearest(x, _old(batch))
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster).tolist():
                sums[j] = [a + int(b) for a, b in zip(sums[j], x[cluster == j].sum(axis=0), strict=True)]
            none = lambda kind, m=batch.num_rows: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(cluster, pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], schema=_STATE)
        rows = [{"cluster": j, "digit": d, "n": int(n[j]), "sums": s} for j in np.flatnonzero(n).tolist() for d, s in enumerate(_digits(sums[j]))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

    return run


def _last(centers: list[list[int]], scale: int):
    def run(batches):
        c = Centers(centers)
        for batch in pieces(batches):
            if batch.num_rows:
                cluster, d = c.nearest(scaled(_vectors(batch, c.at.shape[1]), scale), _old(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([min(int(v), _LONG) for v in d.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _means(state: DataFrame, size: int) -> dict[int, list[int]]:
    """floor(sum / count) of each cluster that has vectors; a row per cluster and digit comes to the driver."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    rows = state.where("digit is not null").groupBy("cluster", "digit").agg(F.sum("n").alias("n"), *sums).collect()
    total: dict[int, list[int]] = {}
    count: dict[int, int] = {}
    for r in rows:
        old = total.setdefault(r["cluster"], [0] * size)
        total[r["cluster"]] = [a + (int(r[f"s{i}"]) << 40 * r["digit"]) for i, a in enumerate(old)]
        if r["digit"] == 0:
            count[r["cluster"]] = r["n"]
    return {c: [v // count[c] for v in t] for c, t in total.items()}


def whole(column: Column, size: int) -> Column:
    """Whether an array has exactly `size` components, none of them null, NaN or infinite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == size) & finite, F.lit(False))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of `size` finite components.

    Component x counts as floor(scale * x).  The first centroids are the k vectors with the smallest sha-256 of
    ``seed:vec_id`` (repeated ids: by components); with fewer vectors there are fewer centroids.  Every
    round assigns each vector to its nearest centroid (squared Euclidean distance, ties: the smaller number) and
    replaces every centroid that has vectors by the floor of their mean; vectors are assigned once more at the end.
    Vectors of another size, or with a null, NaN or infinite component, are left out.  A null id comes back null and hashes as
    if empty.  Repeated rows all count.  An empty table gives an empty result; other columns don't take part.  Distances and
    sums of them beyond a long are given as the largest long; what is nearest is exact all the same.
    """
    spark = vectors.sparkSession
    find_package(spark)
    two = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding"))
    kept = two.where(whole(F.col("embedding"), size))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "embedding").limit(k).select("embedding").collect()
    out = "vec_id long, cluster int, distance long"
    if not first:
        empty = spark.createDataFrame([], out)
        return empty.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    centers = [[int(v) for v in row] for row in scaled(np.array([r["embedding"] for r in first]), scale)]
    state, before = kept.withColumn("cluster", F.lit(0)), None
    for _ in range(rounds):
        now = written(state.mapInArrow(_round(centers, scale), STATE), "centroids")
        if before is not None:
            drop(before)
        means = _means(now, size)
        centers = [means.get(j, c) for j, c in enumerate(centers)]
        before, state = now, now.where("digit is null").select("vec_id", "embedding", "cluster")
    found = written(state.mapInArrow(_last(centers, scale), out), "assigned")
    if before is not None:
        drop(before)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _LONG)
    rows = [(j, min(s, _LONG), total, hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for j, s in sums.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
