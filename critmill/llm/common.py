"""What the operators share: scratch tables, distributed ranks, text kernels for tasks."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many narrow rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch: a task holds several copies of one, in the JVM and in its Python worker.
BATCH_BYTES = 8 << 20
U64 = np.uint64
MASK = (1 << 64) - 1


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    # With its scheme, so that tasks that write files themselves mean the same store as Spark does.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/critmill-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and gives true sizes."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes a table of `save` that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless the user has set a bound: 10,000 whole texts may be far more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins a saved table: broadcast below BROADCAST_ROWS rows, by shuffle beyond."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def ranked(df: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """Adds each row's 0-based place in the order of `keys`, which should end in a unique one.

    One range exchange; rows are numbered inside their partition, then partition bases (prefix
    sums of row counts, one row a partition) are added. No task holds more than its range.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    t = df.select("*", *(k.alias(n) for k, n in zip(keys, names)))
    t = t.repartitionByRange(partitions(spark), *names).sortWithinPartitions(*names)
    t = save(t.drop(*names).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = t.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    bases = spark.sql("SELECT __part, sum(__n) OVER (ORDER BY __part) - __n AS __base FROM {s}", s=sizes)
    # One row a partition: bounded by the number of shuffle partitions.
    t = t.withColumn("__part", part).join(F.broadcast(bases), "__part")
    return t.withColumn(out, F.col("__base") + row).drop("__part", "__at", "__base")


def worker_state() -> types.ModuleType:
    """A place for caches that outlive a task in a reused Python worker."""
    return sys.modules.setdefault("_critmill_worker_state", types.ModuleType("_critmill_worker_state"))


def text_chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, end row, UTF-8 bytes, offsets (n + 1)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer of public 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base mod 2^64 and of its inverse: a string's hash is (P[end] - P[start]) / base^start."""

    base = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 1 << 18)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.upto(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk of texts, in order, and for each text the index of its first word (n + 1)."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return powers.spans(powers.prefix(data), start, end), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words inside each text; a text of fewer words (at least one) has one, of them all.

    Returns the hashes and, for each text, the index of its first one (n + 1).
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - out_first[:-1], n) + np.arange(out_first[-1])
    padded = np.concatenate((words, np.zeros(size, U64)))
    length = np.repeat(np.minimum(counts, size), n)
    h = np.full(len(at), 0x2545F4914F6CDD1D, U64)
    for k in range(size):
        h = np.where(k < length, mix64(h * U64(0x9DDFEA08EB382D69) + padded[at + k]), h)
    return h, out_first
