"""Hard-negative mining with Kronecker-packed products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .topk import tile_top, usable
from .vectors import integer_rows, plain

#: Candidates that a task holds at a time, columns of a tile, anchors of a block, anchors that one pass over the candidates serves.
SHARD_ROWS, TILE_ROWS, BLOCK_ROWS, ANCHOR_ROWS = 1 << 16, 1 << 13, 512, 1 << 16
#: Integers up to this many bits are exact in a double, whose products the linear algebra library makes; fields of a wider, Python integer.
WORD_BITS, WIDE_FIELDS = 53, 16
#: Vectors with larger components are packed apart, so that they don't widen the fields of all others.
ORDINARY = 1 << 20
NONE = np.iinfo(np.int64).min + 1


class Packed:
    """Candidates with several of them in the fields of one wide integer a component.

    Both sides are biased to be non-negative, so that no field borrows from its neighbour: a field holds
    sum((a + A)(c + C)), at most d * 2A * 2C, which sets its width. One product of an anchor's component and a word serves all
    candidates of the word. Where a word of two fields or more fits 53 bits it's held in a double and products are
    matrix products; a field that doesn't fit goes into Python's integers.
    """

    def __init__(self, c: np.ndarray, most: int) -> None:
        """most: the largest magnitude of an anchor's component."""
        self.n, d = c.shape
        self.bias, self.anchor_bias = int(np.abs(c).max(initial=0)), most
        self.width = max(1, (d * 2 * self.bias * 2 * most).bit_length())
        self.wide = self.width > WORD_BITS
        self.fields = WIDE_FIELDS if self.wide else WORD_BITS // self.width
        kind = object if self.wide else np.int64
        self.sums = c.astype(kind).sum(axis=1)
        up = np.zeros((-(-self.n // self.fields) * self.fields, d), kind)
        up[: self.n] = c.astype(kind) + self.bias
        up = up.reshape(-1, self.fields, d)
        words = sum(up[:, f] << (f * self.width) for f in range(self.fields))
        self.words = (words if self.wide else words.astype(np.float64)).T

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Exact inner products of anchors and candidates, unpacked; 64-bit where every one fits, else Python's integers."""
        kind = object if self.wide else np.int64
        a = a.astype(kind)
        up = a + self.anchor_bias
        words = up @ self.words if self.wide else (up.astype(np.float64) @ self.words).astype(np.int64)
        mask = (1 << self.width) - 1
        out = np.stack([(words >> (f * self.width)) & mask for f in range(self.fields)], axis=2).reshape(len(a), -1)[:, : self.n]
        return out - self.bias * a.sum(axis=1)[:, None] - (self.anchor_bias * self.sums + a.shape[1] * self.bias * self.anchor_bias)[None, :]


def by_size(v: np.ndarray) -> list[np.ndarray]:
    """Rows of ordinary vectors, and of those with large components."""
    large = (np.abs(v) > ORDINARY).any(axis=1)
    return [x for x in (np.flatnonzero(~large), np.flatnonzero(large)) if len(x)]


def candidates(batches, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of a task's rows, in shards of vectors of one length and kind of size; ids ascend inside a tile."""
    held: dict[int, list] = {}

    def shards(parts):
        ids, labels, v = (np.concatenate(x) for x in zip(*parts))
        for rows in by_size(v):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            yield ids[rows], labels[rows], v[rows]

    for b in batches:
        ids, labels = (np.array(b.column(c)) for c in ("vec_id", "label"))
        for at, v in integer_rows(b.column("v"), scale):
            parts = held.setdefault(v.shape[1], [])
            parts.append((ids[at], labels[at], v))
            if sum(len(x[0]) for x in parts) >= SHARD_ROWS:
                yield from shards(held.pop(v.shape[1]))
    for parts in held.values():
        yield from shards(parts)


def blocks(uris: list[str], scale: int, columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Anchors of written files, streamed: labels, vectors and the named columns, a block of one length and kind of size each."""
    for uri in uris:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(BLOCK_ROWS, columns=["label", "v", *columns]):
                label = np.array(b.column("label"))
                for at, v in integer_rows(b.column("v"), scale):
                    for rows in by_size(v):
                        some = pa.array(at[rows])
                        yield label[at[rows]], v[rows], [b.column(c).take(some) for c in columns]


def keep_best(rows: np.ndarray, score: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each row: highest score, then the smaller column."""
    order = np.lexsort((column, -score, rows))
    r = rows[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    return order[np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < k]


def _positive_tiles(uris: list[str], scale: int, k: int):
    def f(batches):
        for ids, labels, c in candidates(batches, scale):
            by_label = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
            packs: dict = {}
            for label, a, (number, own) in blocks(uris, scale, ["a", "vec_id"]):
                if a.shape[1] != c.shape[1]:
                    continue
                number, own, most = np.array(number), np.array(own), int(np.abs(a).max(initial=0))
                most = 1 << most.bit_length()  # few different biases, so that a shard is packed once or twice
                for x in np.unique(label):
                    cols = by_label.get(x, ())
                    mine = np.flatnonzero(label == x)
                    for lo in range(0, len(cols), TILE_ROWS):
                        at = cols[lo : lo + TILE_ROWS]
                        if (x, lo, most) not in packs:
                            packs[x, lo, most] = Packed(c[at], most)
                        s = narrow(packs[x, lo, most].scores(a[mine]))
                        s[own[mine][:, None] == ids[at][None, :]] = NONE
                        best = tile_top(s, k)
                        row, col = np.repeat(np.arange(len(mine)), best.shape[1]), best.reshape(-1)
                        ok = s[row, col] > NONE
                        row, col = row[ok], col[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in (number[mine[row]], ids[at[col]], s[row, col])], names=["a", "positive_id", "positive_score"])

    return f


def narrow(s: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; one that doesn't fit becomes NONE and takes no part."""
    if s.dtype == object:
        s = np.where((s > NONE) & (s < 1 << 63), s, NONE).astype(np.int64)
    return s


def _negative_tiles(uris: list[str], scale: int, k: int, low: int, high: int, of: int):
    def f(batches):
        for ids, labels, c in candidates(batches, scale):
            packs: dict = {}
            for label, a, (number, own, found) in blocks(uris, scale, ["a", "vec_id", "positives"]):
                if a.shape[1] != c.shape[1]:
                    continue
                number, own, found = np.array(number), np.array(own), found.to_pylist()
                most = 1 << int(np.abs(a).max(initial=0)).bit_length()
                for lo in range(0, len(c), TILE_ROWS):
                    if (lo, most) not in packs:
                        packs[lo, most] = Packed(c[lo : lo + TILE_ROWS], most)
                    part = slice(lo, lo + TILE_ROWS)
                    s = narrow(packs[lo, most].scores(a))
                    other = (label[:, None] != labels[part][None, :]) & (s > NONE)
                    for i in range(max(map(len, found), default=0)):
                        # low * p <= of * s <= high * p, as bounds on s: exact for integers.
                        bounds = [(-(-low * f[i]["positive_score"] // of), high * f[i]["positive_score"] // of) if len(f) > i else (1, 0) for f in found]
                        least, top = (np.array([max(NONE + 1, min(x[j], (1 << 63) - 1)) for x in bounds], np.int64)[:, None] for j in (0, 1))
                        fit = other & (s >= least) & (s <= top)
                        row, col = np.nonzero(fit)
                        if len(row) > 16 * k * len(a):  # many: k of each row by partition first
                            best = tile_top(np.where(fit, s, NONE), k)
                            row, col = np.repeat(np.arange(len(a)), best.shape[1]), best.reshape(-1)
                            ok = fit[row, col]
                            row, col = row[ok], col[ok]
                        at = keep_best(row, s[row, col], col, k)
                        row, col = row[at], col[at]
                        positive = [found[r][i] for r in row]
                        cells = (number[row], own[row], np.full(len(row), i + 1, np.int32), np.array([p["positive_id"] for p in positive], np.int64), np.array([p["positive_score"] for p in positive], np.int64), ids[part][col], s[row, col])
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in cells], names=["a", "anchor_id", "i", "positive_id", "positive_score", "negative_id", "negative_score"])

    return f


def _files(t: DataFrame) -> list[str]:
    return sorted(t.inputFiles())


def _passes(rows: DataFrame, files: list[str], tiles, schema: str, per_pass: int) -> DataFrame:
    """One pass over the candidates for each `per_pass` files of anchors: tasks grow in number, not in work, with the anchors."""
    out = None
    for lo in range(0, len(files), per_pass):
        t = rows.mapInArrow(tiles(files[lo : lo + per_pass]), schema)
        out = t if out is None else out.unionByName(t)
    return out


def mine(vectors: DataFrame, anchors: DataFrame, column: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, of: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors and anchors: vec_id, label and vectors, which become floor(scale * x); anchors are rows of vectors.
    Scores are integer inner products, higher first, ties by smaller vec_id. An anchor's positives are its first rows of the same label and another
    id; each positive's negatives the first rows of another label with low * positive <= of * negative <= high * positive.

    Candidates stay where they are read and are packed in the task (`Packed`); anchors are written once, their files stream past each
    shard of candidates. A task sends on the best few of each anchor, so no group of a label meets in one place. The
    first pass finds positives, the second, which knows their scores, negatives.

    Rows with a null vec_id or label, or a null, empty or non-finite vector take no part, nor do components that are no 64-bit
    integers after scaling and scores beyond 64 bits. Vectors of other lengths have no score. Each repeated row is a row of its own: as anchor it gives
    its rows again, as candidate it fills a rank. Anchors without a positive, and positives without a negative, give no rows; empty tables an empty result. Other
    columns don't matter.
    """
    spark = vectors.sparkSession
    ready = lambda t: t.filter("vec_id IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), plain(F.col(column)).alias("v"))
    rows = ready(vectors)
    a = ready(anchors).filter(usable(F.col("v"))).withColumn("a", F.monotonically_increasing_id())  # fixed once it's written
    n = a.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], result)
    parts = -(-n // BLOCK_ROWS // 8) if n > BLOCK_ROWS else 1
    per_pass = max(1, ANCHOR_ROWS // (BLOCK_ROWS * 8))
    a = save(a.repartition(parts, "a"))
    found = _passes(rows, _files(a), lambda uris: _positive_tiles(uris, scale, positives), "a long, positive_id long, positive_score long", per_pass)
    best = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= positives)
    found = found.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("i", "positive_id", "positive_score"))).alias("positives"))
    asked = save(a.join(found.hint("merge"), "a").repartition(parts, "a"))
    if not (files := _files(asked)) or asked.isEmpty():
        return spark.createDataFrame([], result)
    got = _passes(rows, files, lambda uris: _negative_tiles(uris, scale, negatives, low, high, of), "a long, anchor_id long, i int, positive_id long, positive_score long, negative_id long, negative_score long", per_pass)
    best = Window.partitionBy("a", "i").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
