"""Compression classifier: dictionaries from good and bad texts, size difference, calibrated score."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, save, small_batches


@dataclass
class Model:
    """Two dictionaries and the calibration (intercept, slope); without dictionaries the score is constant."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float
    level: int = 3
    piece: int = 1024


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(texts: Iterable[bytes], model: Model) -> np.ndarray:
    """Difference of compressed sizes over the text's bytes, higher where the good dictionary fits better.

    A text is compressed in pieces, so that its own beginning doesn't take the dictionary's
    place; every piece of the whole text counts.
    """
    good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
    out = []
    for t in texts:
        g = b = 0
        for at in range(0, len(t), model.piece):
            part = t[at : at + model.piece]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        out.append((b - g) / len(t) if t else 0.0)
    return np.array(out)


def _dictionary(parts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the text itself serves
        return b"".join(parts)[:size] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(a + b x))) with a small ridge on standardised x."""
    scale = x.std() or 1.0
    m = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = m.T @ (m * (p * (1 - p))[:, None]) + ridge * np.eye(2) * len(x)
        step = np.linalg.solve(h, m.T @ (y - p) - ridge * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, pieces: int = 8, size: int = 1 << 18) -> Model:
    """Learns from `rows` labelled texts of each class at most, outside the held-out fold, chosen by a hash of doc_id.

    One half makes the dictionaries, from up to `pieces` pieces of 2,048 characters of each text, which a hash picks from the whole
    text; the other calibrates: its whole texts are compressed in tasks. These bounded pieces and a number for each calibrating
    text are all that reaches the driver. With no label of one class, the score is the smoothed share of good labels. Null labels
    and texts teach nothing, nor does a doc_id with both labels; of rows that share a doc_id, the text of the least hash counts.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("__z")).filter("y = __z").drop("__z")
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    # At most 2 * rows ids.
    ids = picked[0].union(picked[1]).withColumn("__at", place)
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "y", "__at").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    sample = save(sample)
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(b" ", b" ", float(np.log(share / (1 - share))), 0.0)
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(2048))
    some = F.slice(F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), F.substring(F.col("text"), i, F.lit(2048)).alias("part")))), 1, pieces)
    learn = sample.filter("__at % 2 = 1").select("y", "__at", F.transform(some, lambda x: x["part"]).alias("parts")).collect()
    learn = sorted(learn, key=lambda r: r["__at"])
    good, bad = (_dictionary([p.encode() for r in learn if r.y == y for p in r.parts if p], size) for y in (1, 0))
    model = Model(good, bad, 0.0, 0.0)

    @F.pandas_udf("double")
    def differ(text: pd.Series) -> pd.Series:
        return pd.Series(difference((t.encode() for t in text), model))

    got = sample.filter("__at % 2 = 0").select("y", "__at", differ("text").alias("x")).collect()
    got = sorted((r["y"], r["__at"], r["x"]) for r in got)
    drop_saved(sample)
    model.intercept, model.slope = _logistic(np.array([g[2] for g in got]), np.array([float(g[0]) for g in got]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score >= threshold); columns of these names are replaced.

    Only the text decides, whole; a null or empty one has difference 0 and the score of the intercept. Equal texts
    have equal scores; an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        x = difference(((t or "").encode() for t in text), model)
        return pd.Series(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -500, 500))))

    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", rate("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
