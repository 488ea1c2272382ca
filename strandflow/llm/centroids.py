"""Centroid clustering in exact integers: the expansion |x|² - 2 x·c + |c|² by blocked float64 BLAS.

Vectors are turned into integers floor(``scale`` x) and written in blocks of ``block`` rows.  For a vector x and a centroid
c no sum of the expansion, in whatever order BLAS adds, leaves ±dims (max|x| + max|c|)².  Where that bound is below 2^53
every partial sum is an integer that float64 holds, so the result is exact; the other pairs are computed in Python's
integers.  So results don't depend on the order of sums, the size of blocks or the number of tasks.

Each round sums the vectors of each cluster by ``treeAggregate``: a task adds its blocks to k sums and k counts, which meet
in a tree, and only k sums reach the driver, however many vectors there are.  The driver floors sum / count and sends the
k new centroids with the next round.

Defined results: a vector that is null, has another number of components, or a null or non-finite one is left out; a vector
with a null id is clustered but never a first centroid; rows of one id count each, and ties of their hash go by
components; with fewer than ``k`` vectors there are as many centroids; an empty table gives an empty result; a distance or
inertia that 63 bits can't hold is null, while assignments stay exact; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Below this bound float64 sums integers exactly.
EXACT = float(1 << 53)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as float64, which holds it exactly for a scale that is a power of two."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def exact(x: np.ndarray) -> np.ndarray:
    """Float64 integers as Python integers."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def squared_distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """[vector, centroid] in exact integers: int64 where all pairs pass the bound, else Python integers."""
    c = np.array([[float(v) for v in row] for row in centroids])
    bound = x.shape[1] * (np.abs(x).max(1, initial=0)[:, None] + np.abs(c).max(1, initial=0)[None, :]) ** 2
    safe = bound < EXACT / 2
    c_safe = np.where(safe.any(0)[:, None], c, 0)
    x_safe = np.where(safe.any(1)[:, None], x, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.einsum("ij,ij->i", x_safe, x_safe)[:, None] - 2 * (x_safe @ c_safe.T) + np.einsum("ij,ij->i", c_safe, c_safe)[None, :]
    if safe.all():
        return d.astype(np.int64)
    out = np.empty(d.shape, dtype=object)
    out[safe] = exact(d[safe])
    for j in np.flatnonzero(~safe.all(0)):
        rows = np.flatnonzero(~safe[:, j])
        apart = exact(x[rows]) - np.array(centroids[j], dtype=object)
        out[rows, j] = (apart * apart).sum(1)
    return out


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """[cluster, component] sums in Python integers."""
    out = np.zeros((k, x.shape[1]), dtype=object)
    wide = len(x) * np.abs(x).max(initial=0) >= EXACT
    for j in range(k):
        own = x[cluster == j]
        if len(own):
            out[j] = exact(own).sum(0) if wide else exact(own.sum(0))
    return out


def _long(v) -> int | None:
    return int(v) if int(v) < 1 << 63 else None


def vector_blocks(df: DataFrame, *, id_col: str, vector: str, dims: int, block: int) -> DataFrame:
    """(ids, x): the usable vectors, ``block`` of them a row, as float64 bytes."""
    double = F.transform(vector, lambda v: v.cast("double"))
    usable = df.where((F.size(vector) == dims) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def pack(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((batch.num_rows, 0))
            for lo in range(0, batch.num_rows, block):
                ids, x = batch.column(0).slice(lo, block), flat[lo : lo + block]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()])], names=["ids", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return staged(usable.select(id_col, double.alias("__x")).mapInArrow(pack, f"ids array<{kind}>, x binary"), "vector-blocks")


def first_centroids(df: DataFrame, *, id_col: str, vector: str, dims: int, k: int, scale: int, seed: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest sha256 of ``seed:id``, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    usable = df.where(F.col(id_col).isNotNull() & (F.size(vector) == dims) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = usable.select(rank.alias("rank"), F.transform(vector, lambda v: v.cast("double")).alias("x")).orderBy("rank", "x").limit(k).collect()
    return [[int(v) for v in integers(np.array(r.x, dtype=np.float64), scale)] for r in rows]


def fit(blocks: DataFrame, centroids: list[list[int]], *, rounds: int, scale: int) -> tuple[list[list[int]], list[int]]:
    """Centroids after ``rounds`` rounds of assignment and floored means, and the inertia of each cluster with them."""
    k, dims = len(centroids), len(centroids[0])
    rows = blocks.select("x").rdd

    def added(now: list[list[int]]):
        def add(total, row):
            x = integers(np.frombuffer(row.x, np.float64).reshape(-1, dims), scale)
            d = squared_distances(x, now)
            cluster = d.argmin(1).astype(np.int64)
            near = exact(d[np.arange(len(d)), cluster])
            spread = np.zeros(k, dtype=object)
            np.add.at(spread, cluster, near)
            return merged(total, (sums(x, cluster, k), np.bincount(cluster, minlength=k).astype(object), spread))

        return add

    def merged(a, b):
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b, strict=True))

    for _ in range(rounds):
        total, count, _ = rows.treeAggregate(None, added(centroids), merged)
        centroids = [[int(v) // int(n) for v in own] if n else old for own, n, old in zip(total, count, centroids, strict=True)]
    return centroids, [int(v) for v in rows.treeAggregate(None, added(centroids), merged)[2]]


def centroid_clusters(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", block: int = 1024) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    ``scale`` is a power of two."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks = vector_blocks(df, id_col=id_col, vector=vector, dims=dims, block=block)
    start = first_centroids(df, id_col=id_col, vector=vector, dims=dims, k=k, scale=scale, seed=seed)
    if not start:
        return df.sparkSession.createDataFrame([], schema)
    centroids, spread = fit(blocks, start, rounds=rounds, scale=scale)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each, whole = [_long(v) for v in spread], _long(sum(spread))

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, raw = batch.column(0)[i].values, batch.column(1)[i].as_py()
                d = squared_distances(integers(np.frombuffer(raw, np.float64).reshape(-1, dims), scale), centroids)
                cluster = d.argmin(1).astype(np.int64)
                near = [_long(v) for v in d[np.arange(len(d)), cluster]]
                columns = [ids, pa.array(cluster, pa.int32()), pa.array(near, pa.int64()), *(pa.array([v[j] for j in cluster], t) for v, t in ((each, pa.int64()), ([whole] * len(each), pa.int64()), (digest, pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assign, schema)
