"""The inverted file against brute force: all cells, measured recall, filters, equal rows, messy rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from critmill.operators import joins as jo
from critmill.operators.vectors import VectorIndex

SCHEMA = "nct_id string, embedding array<double>, phase string, more int"


@pytest.fixture(scope="module")
def table(spark):
    """Clustered vectors, a third of all rows equal, and rows that take no part."""
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(20, 16))
    v = middle[rnd.integers(0, 20, 2000)] + rnd.normal(scale=0.4, size=(2000, 16))
    v[::3] = v[0]
    rows = [(f"N{i:05d}", x.tolist(), f"P{i % 3}" if i % 7 else None, i) for i, x in enumerate(v)]
    rows += [("bad1", None, "P0", 1), ("bad2", [0.0] * 16, "P0", 1), ("bad3", [float("nan")] * 16, "P0", 1), ("bad4", [None] * 16, "P0", 1), (None, v[1].tolist(), "P0", 1)]
    return v, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return VectorIndex.build(table[1], f"{tmp_path_factory.mktemp('v')}/index", ["phase"], probing=100, rows_block=100)


def brute(v, at, k, allowed=lambda i, j: True):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit[at] @ unit.T, 4)
    out = set()
    for n, i in enumerate(at):
        best = sorted((j for j in range(len(v)) if allowed(i, j)), key=lambda j: (-s[n, j], j))[:k]
        out |= {(f"N{i:05d}", f"N{j:05d}", r + 1) for r, j in enumerate(best)}
    return out


def rows(t):
    return {(r.query_id, r.nct_id, r["rank"]) for r in t.collect()}


def asked(t):
    return t.filter("nct_id LIKE 'N%' AND more % 100 = 1").withColumnRenamed("nct_id", "query_id")


def test_every_row_lies_in_a_cell(table, index):
    v, t = table
    stored = index.spark.read.parquet(f"{index.path}/rows")
    assert sorted(r.nct_id for r in stored.select("nct_id").collect()) == [f"N{i:05d}" for i in range(2000)]
    assert stored.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200  # equal rows are dealt out
    got = index.search(asked(t), k=7, match=["phase"], probes=len(index.centres))
    phase = lambda i: f"P{i % 3}" if i % 7 else None
    assert rows(got) == brute(v, range(1, 2000, 100), 7, lambda i, j: phase(i) == phase(j))


def test_recall_with_few_cells(table, index):
    v, t = table
    assert index.recall >= 0.95 and index.probes < len(index.centres) / 2
    want = {x[:2] for x in brute(v, range(1, 2000, 100), 10)}
    got = {x[:2] for x in rows(jo.similar_to_vectors(t, asked(t), index=index))}
    assert len(want & got) >= 0.9 * len(want)


def test_narrow_filter_is_searched_exactly(table, index):
    """Fewer than k rows in the probed cells: the whole table answers."""
    v, t = table
    few = t.filter("more % 400 = 5").select("nct_id")
    got = jo.similar_to_trials(t, asked(t).select(F.col("query_id").alias("nct_id")), few, k=3, index=index)
    assert rows(got) == brute(v, range(1, 2000, 100), 3, lambda i, j: i != j and j % 400 == 5)


def test_messy_and_empty(spark, table, index, tmp_path):
    v, t = table
    messy = t.filter("nct_id LIKE 'bad%'").withColumnRenamed("nct_id", "query_id")
    assert jo.similar_to_vectors(t, messy).count() == 0 == index.search(messy).count()
    short = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<double>")
    assert jo.similar_to_vectors(t, short).count() == 0 == index.search(short).count()
    none = VectorIndex.build(t.limit(0), f"{tmp_path}/none")
    assert none.search(asked(t)).count() == 0
    with pytest.raises(ValueError):
        index.search(asked(t), match=["more"])
    huge = spark.createDataFrame([("a", [1e200, 0.0]), ("b", [1e-200, 1e-200])], "nct_id string, embedding array<double>")
    got = jo.similar_to_vectors(huge, huge.withColumnRenamed("nct_id", "query_id"))
    assert {(r.query_id, r.nct_id): r.similarity for r in got.collect()} == {("a", "a"): 1, ("b", "b"): 1, ("a", "b"): 0.7071, ("b", "a"): 0.7071}


def test_nearest_cells_hold_few_similarities_at_once(spark, monkeypatch):
    """Chunks of rows give the order of all at once."""
    import numpy as np
    import pandas as pd

    from critmill.operators import vectors as ve

    rng = np.random.default_rng(3)
    centres, v = rng.normal(size=(7, 4)), pd.Series(list(rng.normal(size=(50, 4))))
    monkeypatch.setattr(ve, "SIMILARITIES", 21)
    sizes = []
    real = np.argsort
    monkeypatch.setattr(ve.np, "argsort", lambda x, **k: sizes.append(x.size) or real(x, **k))
    got = [list(x) for x in ve._nearest(centres, 3).func(v)]
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    assert got == [list(real(-(unit @ x), kind="stable")[:3]) for x in v] and max(sizes) <= 21
