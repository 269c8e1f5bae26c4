"""Cosine search over stored vectors: exact by matrix products, and through an inverted file of cells."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized

#: Similarities to centres that a worker holds at once, and bytes of blocks that it's sent at once (unless the session has a bound of its own).
SIMILARITIES, BATCH_BYTES = 1 << 20, 8 << 20
#: Bytes of probing queries up to which they're sent to every task.
BROADCAST_BYTES = 32 << 20


def comparable(t: DataFrame, key: str, match: list[str]) -> DataFrame:
    """key, v (doubles), d (their number) and m (the match values as one text) of rows with a key whose vector is finite and not zero."""
    t = t.select(key, F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(match)), F.lit(0).alias("m"))).alias("m"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return t.filter(F.col(key).isNotNull() & F.col("v").isNotNull() & finite).withColumn("d", F.size("v"))


def packed(rows: DataFrame, key: str, by: list[str], prefix: str) -> DataFrame:
    """One row a block: its keys, match texts and vectors, one after the other."""
    t = rows.groupBy(*by).agg(F.collect_list(F.struct(key, "m", "v")).alias("x"))
    return t.select(*by, F.col(f"x.{key}").alias(f"{prefix}_id"), F.col("x.m").alias(f"{prefix}_m"), F.flatten("x.v").alias(f"{prefix}_v"))


def best_of_cells(cells: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """query_id, nct_id, similarity: the k best rows of each query in each cell (q_id, q_m, q_v, r_id, r_m, r_v)."""

    def unit(flat, n):
        v = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def best(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_id, q_m, q_v, r_id, r_m, r_v = (b.column(c)[i].values for c in ("q_id", "q_m", "q_v", "r_id", "r_m", "r_v"))
                n, m = len(q_id), len(r_id)
                score = np.rint((unit(q_v, n) @ unit(r_v, m).T) * 10000).astype(np.int64)
                place = np.empty(m, np.int64)
                place[np.argsort(r_id.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(m)
                order = score * m - place  # no two alike, so k are chosen without a full sort
                codes = pd.factorize(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (q_m, r_m)]))[0]
                out = codes[:n, None] != codes[None, n:]
                if skip_self:
                    names = pd.factorize(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (q_id, r_id)]))[0]
                    out |= names[:n, None] == names[None, n:]
                order[out] = -np.iinfo(np.int64).max
                top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (n, 1))
                at = np.repeat(np.arange(n), top.shape[1])
                top = top.ravel()
                ok = ~out[at, top]
                at, top = at[ok], top[ok]
                yield pa.RecordBatch.from_arrays([q_id.take(pa.array(at)), r_id.take(pa.array(top)), pa.array(score[at, top] / 10000)], ["query_id", "nct_id", "similarity"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if cells.sparkSession.conf.get(name, None) is None:
        cells.sparkSession.conf.set(name, str(BATCH_BYTES))
    return cells.select("q_id", "q_m", "q_v", "r_id", "r_m", "r_v").mapInArrow(best, "query_id string, nct_id string, similarity double")


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "nct_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _dealt(key: str, n: int | Column) -> Column:
    """A block's number; the vector is hashed too, so that rows of one id needn't share a block."""
    return F.pmod(F.xxhash64(key, "v"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def exact_search(q: DataFrame, rows: DataFrame, k: int, skip_self: bool, block: int = 256, rows_block: int = 1024) -> DataFrame:
    """The k best of all comparable rows for each comparable query. Every pair of blocks is one matrix product."""
    n_q, n_r = max(1, -(-q.count() // block)), max(1, -(-rows.count() // rows_block))
    qs = packed(q.withColumn("qb", _dealt("query_id", n_q)), "query_id", ["d", "qb"], "q").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    rs = packed(rows.withColumn("rb", _dealt("nct_id", n_r)), "nct_id", ["d", "rb"], "r").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return ranked_best(best_of_cells(rs.join(qs.hint("shuffle_hash"), ["d", "qb", "rb"]), k, skip_self), k)


class VectorIndex:
    """An inverted file: every comparable row lies in the cell of its nearest centre, and a query looks into its nearest cells only.

    The centres are fitted by k-means (cosine) on the `sample` rows of least hash, a stated bound; all rows are dealt to them. How many cells a
    query looks into is measured when the index is built: the `probing` stored rows of least hash are searched exactly, and `probes`
    is the least number of cells that holds the share `target` of their ten nearest. Rows in a probed cell are compared exactly, so a result
    only ever lacks rows of other cells. Nulls, zero and non-finite vectors are in no result, as in the exact search; vectors must have one length.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.text(f"{self.path}/about", wholetext=True).first().value)
        self.match, self.probes, self.recall = about["match"], about["probes"], about["recall"]
        #: Cells * dimensions numbers: at most 4,096 cells.
        self.centres = np.array([r.centre for r in spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])

    @classmethod
    def build(cls, emb: DataFrame, path: str, match: list[str] | None = None, cells: int | None = None, sample: int = 50_000, probing: int = 200, target: float = 0.95, rows_block: int = 1024) -> VectorIndex:
        """emb: nct_id, embedding and the columns that searches may match. `cells` is about the root of the rows, unless given."""
        spark, path, match = emb.sparkSession, path.rstrip("/"), match or []
        keep = ["nct_id", "v", *match]
        at = emb.filter("nct_id IS NOT NULL").select(F.struct("nct_id", *match).alias("at"), "embedding")
        rows = materialized(comparable(at, "at", []).select("at.*", "v", "d"))
        dims = [r.d for r in rows.select("d").distinct().limit(2).collect()]
        if len(dims) > 1:
            raise ValueError("vectors must have one length")
        n = rows.count()
        cells = max(1, min(cells or int(n**0.5), 4096, n))
        first = lambda m: rows.orderBy(F.xxhash64("nct_id", "v"), "nct_id").limit(m)
        if n:
            fit = materialized(first(max(sample, cells)).select(array_to_vector("v").alias("features")))
            model = KMeans(k=cells, distanceMeasure="cosine", seed=7, maxIter=10).fit(fit)
            centres = [[float(x) for x in c] for c in model.clusterCenters()]
            placed = model.transform(rows.withColumn("features", array_to_vector("v"))).select(*keep, F.col("prediction").alias("cell"))
        else:
            centres, placed = [], rows.select(*keep, F.lit(0).alias("cell"))
        spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        placed = materialized(placed)
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_block).alias("blocks"))  # at most 4,096 rows
        placed = placed.join(F.broadcast(sizes), "cell").withColumn("block", _dealt("nct_id", F.col("blocks"))).select(*keep, "block", "cell")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        probes, recall = cls._measure(spark, path, rows, first(probing), np.array(centres), target) if n else (1, 1.0)
        about = json.dumps({"match": match, "probes": probes, "recall": recall})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")  # last: without it there's no index
        return cls(spark, path)

    @staticmethod
    def _measure(spark, path, rows, asked, centres, target) -> tuple[int, float]:
        plain = lambda t: t.withColumn("m", F.lit(""))
        asked = materialized(plain(asked.withColumnRenamed("nct_id", "query_id")))
        near = materialized(exact_search(asked, plain(rows), 10, True))
        order = asked.select("query_id", _nearest(centres, len(centres))("v").alias("order"))
        where = spark.read.parquet(f"{path}/rows").select("nct_id", "cell").join(near.hint("merge"), "nct_id")
        at = where.join(order.hint("merge"), "query_id").select(F.array_position("order", F.col("cell").cast("int")).alias("at"))
        counts = at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # a row a cell at most
        total, seen = sum(r.n for r in counts), 0
        for r in counts:
            seen += r.n
            if seen >= target * total:
                return int(r["at"]), seen / total
        return 1, 1.0

    def search(self, queries: DataFrame, with_criteria: DataFrame | None = None, k: int = 10, match: list[str] | None = None, skip_self: bool = False, probes: int | None = None, block: int = 256) -> DataFrame:
        """As joins.similar_to_vectors. Queries that found fewer than k rows in their cells, as under a narrow filter, are searched exactly."""
        match = match or []
        if missing := set(match) - set(self.match):
            raise ValueError(f"the index doesn't keep {sorted(missing)}")
        if not len(self.centres):
            return self.spark.createDataFrame([], "query_id string, nct_id string, similarity double, rank int")
        k, probes = max(1, min(k, 500)), min(probes or self.probes, len(self.centres))
        stored = self.spark.read.parquet(f"{self.path}/rows")
        if with_criteria is not None:
            stored = stored.join(with_criteria.select("nct_id").distinct(), "nct_id", "left_semi")
        rows = comparable(stored.withColumnRenamed("v", "embedding").select("*", F.struct("cell", "block", "nct_id").alias("at")).drop("nct_id"), "at", match)
        rows = rows.select("at.*", "v", "m", "d")
        q = materialized(comparable(queries, "query_id", match).filter(F.col("d") == self.centres.shape[1]))
        n = q.count()
        asked = q.withColumn("cell", F.explode(_nearest(self.centres, probes)("v"))).withColumn("qb", _dealt("query_id", max(1, -(-n // block))))
        asked = packed(asked, "query_id", ["cell", "qb"], "q")
        blocks = packed(rows, "nct_id", ["cell", "block"], "r")
        small = n * probes * self.centres.shape[1] * 8 <= BROADCAST_BYTES
        pairs = blocks.join(F.broadcast(asked) if small else asked.hint("merge"), "cell")
        found = materialized(ranked_best(best_of_cells(pairs, k, skip_self), k))
        if probes == len(self.centres):
            return found
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        short = materialized(q.join(full.hint("merge"), "query_id", "left_anti").select(*q.columns))
        if short.isEmpty():
            return found
        rest = exact_search(short, rows, k, skip_self)
        return found.join(short.select("query_id").distinct().hint("merge"), "query_id", "left_anti").select(*rest.columns).unionByName(rest)


def _nearest(centres: np.ndarray, n: int):
    """A function of a vector column: the n nearest cells by cosine, nearest first."""
    c = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    step = max(1, SIMILARITIES // max(1, len(c)))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(v), step):
            out.extend(np.argsort(-(np.stack(v.iloc[i : i + step].to_list()) @ c.T), axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(out, dtype=object)

    return nearest
