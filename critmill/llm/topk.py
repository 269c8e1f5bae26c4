"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save


def usable(vector: Column) -> Column:
    """Vectors that are null, empty or hold null, NaN or infinite components take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, as double. Rows without a vec_id take no part, nor do those with a component that gives no 64-bit integer."""
    v = F.col(column).cast("array<double>")
    small = ~F.exists(v, lambda x: F.abs(x * scale) >= float(1 << 62))
    return vectors.filter(F.col("vec_id").isNotNull() & usable(v) & small).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def tile_top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller column, in no order; all columns if fewer."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, equal = scores > kth, scores == kth
    keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)[1].reshape(len(scores), k)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where sums stay below 2^53, Python integers beyond."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T


#: Stands for no score.
NONE = -(1 << 63) + 1
#: Bytes of the vectors that a task holds at a time, columns and query rows of a tile, queries that one pass over the vectors serves.
SHARD_BYTES, COLUMNS, TILE, PASS_ROWS = 16 << 20, 1 << 13, 512, 1 << 16


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of doubles of the vectors of each length."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0))
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _shards(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a task's rows, in shards of one length; ids ascend inside a shard."""
    held: dict[int, list] = {}

    def joined(parts):
        ids, v = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        return ids[order], v[order]

    for b in batches:
        ids = np.array(b.column("vec_id"))
        for at, v in _matrices(b.column("v")):
            d, most = v.shape[1], rows or max(1, SHARD_BYTES // (8 * v.shape[1]))
            for lo in range(0, len(at), most):
                held.setdefault(d, []).append((ids[at[lo : lo + most]], v[lo : lo + most]))
                if sum(len(x[0]) for x in held[d]) >= most:
                    yield joined(held.pop(d))
    yield from map(joined, held.values())


def _asked(uris: list[str], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries of written files, streamed: their numbers, ids and matrix, a block of one length each."""
    for uri in uris:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(rows, columns=["q", "vec_id", "v"]):
                number, ids = np.array(b.column("q")), np.array(b.column("vec_id"))
                for at, v in _matrices(b.column("v")):
                    yield number[at], ids[at], v


def _tile(own: np.ndarray, a: np.ndarray, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of a tile; NONE for a row of the query's own id and for a score beyond 64 bits."""
    s = products(a, c)
    if s.dtype == object:
        s = np.where((s > NONE) & (s < 1 << 63), s, NONE).astype(np.int64)
    s[own[:, None] == ids[None, :]] = NONE
    return s


def _tiles(uris: list[str], k: int, query_rows: int, shard_rows: int | None, columns: int):
    def f(batches):
        task = TaskContext.get().partitionId()
        for ids, c in _shards(batches, shard_rows):
            for number, own, a in _asked(uris, query_rows):
                if a.shape[1] != c.shape[1]:
                    continue
                best, place = np.zeros((len(a), 0), np.int64), np.zeros((len(a), 0), np.int64)
                for lo in range(0, len(c), columns):
                    s = _tile(own, a, ids[lo : lo + columns], c[lo : lo + columns])
                    at = tile_top(s, k)
                    # The tile's columns come after those kept so far, so ties stay with the smaller id.
                    best, place = np.hstack((best, np.take_along_axis(s, at, 1))), np.hstack((place, at + lo))
                    at = tile_top(best, k)
                    best, place = np.take_along_axis(best, at, 1), np.take_along_axis(place, at, 1)
                row, col = np.nonzero(best > NONE)
                cells = (number[row], own[row], np.full(len(row), task, np.int64), ids[place[row, col]], best[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["q", "query_id", "sb", "vec_id", "score"])

    return f


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, query_rows: int = TILE, shard_rows: int | None = None, fan_in: int = 16) -> DataFrame:
    """Each query's k best rows other than itself by inner product: query_id, rank, vec_id, score; ties to the smaller id.

    Inputs hold vec_id and v (integers as doubles, one length). Vectors stay where they are read: a task holds them a shard at a time, and
    the queries, written once, stream past in blocks. Matrix products of tiles keep k rows a query, which a task merges over the tiles of a shard. Lists of
    tasks are merged in a tree, `fan_in` at a time.

    Rows without vec_id take no part. Empty inputs give an empty result; vectors of
    a length other than the query's take no part, nor do scores beyond 64 bits; a repeated vec_id is a row of its own (as query it gives its rows again), and a query
    skips every row of its own id. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    q = queries.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v").withColumn("q", F.monotonically_increasing_id())  # fixed once it's written
    q = save(q)
    n = q.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if n > PASS_ROWS:
        q = save(q.repartition(-(-n // PASS_ROWS), "q"))
    files = sorted(q.inputFiles())
    # A pass serves a file of about PASS_ROWS queries, a small table's files all together.
    t = None
    for uris in [[x] for x in files] if n > PASS_ROWS else [files]:
        part = rows.mapInArrow(_tiles(uris, k, query_rows, shard_rows, COLUMNS), "q long, query_id long, sb long, vec_id long, score long")
        t = part if t is None else t.unionByName(part)
    best = [F.col("score").desc(), F.col("vec_id")]
    while True:
        t = t.withColumn("sb", F.floor(F.col("sb") / fan_in))
        t = save(t.withColumn("rank", F.row_number().over(Window.partitionBy("q", "sb").orderBy(*best))).filter(F.col("rank") <= k))
        if not t.agg(F.max("sb")).first()[0]:
            return t.select("query_id", "rank", "vec_id", "score")
