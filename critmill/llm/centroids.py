"""Centroid clustering: nearest centroids by the threshold algorithm, exact integer means."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .vectors import integer_rows, plain

#: Vectors that walk the lists together, and the largest number that a 64-bit sum of squares may reach.
TILE, SAFE = 2048, 1 << 62


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (ties: the smaller) and their exact squared distance.

    In every dimension the centroids stand in a list sorted by value. From each vector's own value the lists
    are walked outward, the nearer neighbour on either side first, all dimensions at one depth; a centroid
    met anywhere gets its exact distance. None that is still unmet can be nearer than the sum of the squared gaps at the
    frontier, so a vector stops as soon as that sum strictly exceeds its best distance (at equality an unmet one of
    smaller number could tie).
    """
    k, d = c.shape
    most = int(np.abs(v).max(initial=0)) + int(np.abs(c).max(initial=0))
    kind = np.int64 if d * most * most < SAFE else object  # Python's integers where squares don't fit
    v, c = v.astype(kind), c.astype(kind)
    order = np.argsort(c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, axis=0)
    far = most * 2 + 1
    walls = np.full((1, d), far, kind)
    lists = np.concatenate([-walls, lists, walls])  # a wall at either end is farther than any centroid
    dims = np.arange(d)
    cluster, distance = np.zeros(len(v), np.int64), np.zeros(len(v), kind)
    for lo in range(0, len(v), TILE):
        rows, x = np.arange(lo, min(lo + TILE, len(v))), v[lo : lo + TILE]
        right = np.stack([np.searchsorted(lists[:, j], x[:, j]) for j in range(d)], axis=1)
        right = np.clip(right, 1, k + 1)
        left = right - 1
        met = np.full((len(x), k), d * far * far * 4, kind)
        seen = np.zeros((len(x), k), bool)
        for _ in range(k):
            below, above = x - lists[left, dims], lists[right, dims] - x
            go_left = (below <= above) & (left > 0) | (right > k)
            gap = np.where(go_left, below, above)
            fresh = np.zeros_like(seen)
            fresh[np.arange(len(x))[:, None], order[np.where(go_left, left, right) - 1, dims]] = True
            fresh &= ~seen
            seen |= fresh
            for j in np.flatnonzero(fresh.any(axis=0)):
                at = np.flatnonzero(fresh[:, j])
                off = x[at] - c[j]
                met[at, j] = (off * off).sum(axis=1)
            left, right = left - go_left, right + ~go_left
            best = met.argmin(axis=1)  # the first of equals
            least = met[np.arange(len(x)), best]
            done = ((gap * gap).sum(axis=1) > least) | seen.all(axis=1)
            cluster[rows[done]], distance[rows[done]] = best[done], least[done]
            if done.all():
                break
            go = ~done
            rows, x, left, right, met, seen = rows[go], x[go], left[go], right[go], met[go], seen[go]
    return cluster, distance


def _start(vectors: DataFrame, column: str, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The first k usable vectors by the hash of their id; k rows come to the driver. Equal ids by their components."""

    def usable(batches):
        for b in batches:
            for at, v in integer_rows(b.column("v"), scale, dims):
                yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(at)), pa.array(list(v), pa.list_(pa.int64()))], names=["h", "v"])

    t = vectors.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), plain(F.col(column)).alias("v"))
    rows = t.mapInArrow(usable, "h string, v array<long>").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), dims)


def _means(vectors: DataFrame, column: str, dims: int, scale: int, centroids: np.ndarray) -> np.ndarray:
    """Floor of the exact mean of each centroid's vectors; a centroid without vectors stays.

    A task adds up its own vectors, in two halves that 64 bits hold, so that one row a centroid and dimension
    leaves it; the sums of all tasks are decimals. dims * k rows come to the driver.
    """
    k = len(centroids)

    def sums(batches):
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, v in integer_rows(b.column("v"), scale, dims):
                at, _ = nearest(v, centroids)
                n += np.bincount(at, minlength=k)
                for j in np.unique(at):
                    high[j] += (v[at == j] >> 32).sum(axis=0)
                    low[j] += (v[at == j] & 0xFFFFFFFF).sum(axis=0)
        some = np.flatnonzero(n)
        c, d = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, d, np.repeat(n[some], dims), high[some].reshape(-1), low[some].reshape(-1))], names=["c", "d", "n", "high", "low"])

    t = vectors.select(plain(F.col(column)).alias("v")).mapInArrow(sums, "c long, d long, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    new = centroids.copy()
    for r in t.groupBy("c", "d").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect():
        new[r.c, r.d] = (int(r.high) * (1 << 32) + int(r.low)) // r.n
    return new


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, column: str = "embedding", dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors of `dims` finite components become floor(scale * x); centroids start as the k of smallest
    sha256 of "seed:vec_id" and are replaced `rounds` times by the floor of their vectors' exact means. Each round reads the vectors where they
    lie and shuffles sums only: a row a task, centroid and dimension.

    Null vectors, those of another length or with null or non-finite components take no part, nor does one whose component
    is no 64-bit integer after scaling. A row without vec_id is clustered but no start; repeated rows count as often as they
    stand there. Fewer than k vectors give fewer centroids, an empty table none and an empty result. A distance or inertia beyond 64
    bits is null. Columns of other names, the added ones among them, don't matter.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", column)
    centroids = _start(vectors, column, k, dims, scale, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _means(vectors, column, dims, scale, centroids)

    def assign(batches):
        for b in batches:
            for at, v in integer_rows(b.column("v"), scale, dims):
                number, distance = nearest(v, centroids)
                if distance.dtype == object:
                    distance = [x if x < 1 << 63 else None for x in distance]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    t = save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), plain(F.col(column)).alias("v")).mapInArrow(assign, out))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    total = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(F.col(c).cast("decimal(38,0)")))
    per = t.groupBy("cluster").agg(total("distance").alias("s"))
    per = per.crossJoin(F.broadcast(per.agg(total("s").alias("all"))))  # one row
    per = per.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    per = per.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
    return t.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
