"""Centroid clustering and hard negatives against brute force in plain Python."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from critmill.llm import centroids, negatives, queries, topk
from critmill.llm.vectors import integer_rows

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance double, a int, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, other lengths, ties, repeated rows, large components, clashing column names."""
    rnd = np.random.default_rng(3)
    v = lambda n=64, s=0.2: (rnd.normal(size=n) * s).tolist()
    rows = [(i * 10, v(), i % 3) for i in range(60)]
    same = v()
    rows += [(1000 + i, same, i % 3) for i in range(12)] + [(1003, same, 0), (2000, [0.0] * 64, 1), (2100, [0.0] * 64, 1)]
    rows += [(3000, None, 1), (3100, v(63), 1), (3200, v(63), 0), (3300, v(63), 1), (3400, [], 1), (3500, [0.1] * 63 + [None], 0), (3600, [0.1] * 63 + [math.nan], 0), (3700, [math.inf] * 64, 0)]
    rows += [(None, v(), 1), (3800, v(), None), (3900, [3e4] * 64, 1), (4000, [2.5e4] * 64, 0), (4100, [1e17] * 64, 1), (4200, [1e300] * 64, 0), (300, rows[30][1], 0)]
    return spark.createDataFrame([(*r, "x", 1.0, 7, 7) for r in rows], SCHEMA)


def whole(x, scale):
    """floor(scale * x) as Python integers; None where a vector takes no part."""
    if not x or any(y is None or not math.isfinite(y) for y in x):
        return None
    out = [math.floor(y * scale) for y in x]
    return None if max(map(abs, out)) >= 1 << 62 else out


def brute_clusters(rows, k=16, rounds=3):
    kept = [(r.vec_id, v) for r in rows if (v := whole(r.embedding, 64)) is not None and len(v) == 64]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in starts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else old for j, old in enumerate(c)]
    got = [(i, *near(v)) for i, v in kept]
    total = defaultdict(int)
    for _, d, j in got:
        total[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    every = [fits(d) for _, d, _ in got]
    inertia = fits(sum(total.values())) if None not in every else None
    per = {j: fits(t) if all(fits(d) is not None for _, d, x in got if x == j) else None for j, t in total.items()}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, fits(d), per[j], inertia, sha[j]) for i, d, j in got), key=str)


def test_clusters(spark, odd):
    got = sorted((tuple(r) for r in centroids.cluster(odd.repartition(5)).collect()), key=str)
    assert got == brute_clusters(odd.collect())
    small = odd.filter("vec_id < 50")  # fewer vectors than centroids
    assert sorted((tuple(r) for r in centroids.cluster(small).collect()), key=str) == brute_clusters(small.collect())
    assert centroids.cluster(odd.limit(0)).count() == 0 and centroids.cluster(odd.filter("embedding IS NULL")).count() == 0


def test_registered_clusters(spark, sf):
    got = sorted((tuple(r) for r in queries.op11_centroid_clustering(spark, sf).collect()), key=str)
    assert got == brute_clusters(spark.read.parquet(f"{sf}/embeddings.parquet").collect())


@pytest.mark.parametrize("k,d,size", [(1, 1, 5), (3, 2, 3), (16, 64, 100), (40, 3, 4), (5, 8, 1 << 40)])
def test_nearest(k, d, size):
    """Few different values, so that most distances tie; and numbers whose squares 64 bits don't hold."""
    rnd = np.random.default_rng(k)
    v, c = rnd.integers(-size, size, (500, d)), rnd.integers(-size, size, (k, d))
    number, distance = centroids.nearest(v, c)
    for i, x in enumerate(v.tolist()):
        all_ = [(sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c.tolist())]
        assert (int(distance[i]), int(number[i])) == min(all_)


def test_walk_stops_early(monkeypatch):
    """Vectors near their centroid meet few others: most exact distances are never made."""
    rnd = np.random.default_rng(1)
    c = rnd.integers(-10_000, 10_000, (200, 4))
    v = c[rnd.integers(0, 200, 1000)] + rnd.integers(-3, 4, (1000, 4))
    made = []
    real = np.flatnonzero

    def counting(x):
        out = real(x)
        if x.ndim == 1 and x.dtype == bool and len(x) != 200:
            made.append(len(out))
        return out

    monkeypatch.setattr(centroids.np, "flatnonzero", counting)
    centroids.nearest(v, c)
    assert sum(made) < 0.1 * 200 * 1000


def test_integer_rows():
    import pyarrow as pa

    column = pa.array([[0.5, -0.01], None, [1.0], [math.nan, 1.0], [2.0, None], [], [-0.5, 0.999]], pa.list_(pa.float64()))
    got = {v.shape[1]: (at.tolist(), v.tolist()) for at, v in integer_rows(column, 64)}
    assert got == {2: ([0, 6], [[32, -1], [-32, 63]]), 1: ([2], [[64]])}


@pytest.mark.parametrize("size", [1, 160, 1 << 12, 1 << 22, 1 << 45])
def test_packed_products(size):
    rnd = np.random.default_rng(7)
    a, c = rnd.integers(-size, size + 1, (9, 64)), rnd.integers(-size, size + 1, (37, 64))
    p = negatives.Packed(c, size)
    assert p.wide == (size > 1 << 22) and p.words.shape == (64, -(-37 // p.fields)) and (size > 160 or p.fields > 1)
    want = [[sum(x * y for x, y in zip(r, s)) for s in c.tolist()] for r in a.tolist()]
    assert [[int(x) for x in r] for r in p.scores(a)] == want


def brute_negatives(vectors, anchors):
    usable = lambda rows: [(r.vec_id, r.label, v) for r in rows if r.vec_id is not None and r.label is not None and (v := whole(r.embedding, 256))]
    rows, out = usable(vectors), []
    for i, label, v in usable(anchors):
        score = [(-s, j, x) for j, x, w in rows if len(v) == len(w) and abs(s := sum(a * b for a, b in zip(v, w))) < 1 << 63]
        for s, j, _ in sorted(x for x in score if x[2] == label and x[1] != i)[:5]:
            fit = sorted(x for x in score if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit[:5])]
    return sorted(out)


def test_negatives(spark, odd, monkeypatch):
    ask = odd.filter("vec_id % 50 = 0")
    got = sorted(tuple(r) for r in negatives.mine(odd.repartition(4), ask).collect())
    want = brute_negatives(odd.collect(), ask.collect())
    assert got == want and len(want) > 50
    assert negatives.mine(odd, ask.limit(0)).count() == 0 == negatives.mine(odd.limit(0), ask).count()
    assert negatives.mine(odd.filter("label = 1"), ask).count() == 0


def test_negatives_in_blocks(spark, odd, monkeypatch):
    """Many small shards, tiles, blocks and passes give the same rows."""
    for name, value in {"SHARD_ROWS": 20, "TILE_ROWS": 7, "BLOCK_ROWS": 2, "ANCHOR_ROWS": 16}.items():
        monkeypatch.setattr(negatives, name, value)
    # Tasks read the module anew, so tiles and shards are checked in this process as well.
    import pyarrow as pa

    rows = odd.filter("vec_id IS NOT NULL AND label IS NOT NULL").selectExpr("vec_id", "cast(label as long) label", "embedding v").toPandas()
    b = pa.RecordBatch.from_pandas(rows)
    parts = list(negatives.candidates([b.slice(i, 9) for i in range(0, len(rows), 9)], 256))
    assert len(parts) > 5 and all((np.diff(ids) >= 0).all() for ids, _, _ in parts)
    ask = odd.filter("vec_id % 50 = 0")
    assert sorted(tuple(r) for r in negatives.mine(odd, ask).collect()) == brute_negatives(odd.collect(), ask.collect())


def test_registered_negatives(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    want = brute_negatives(t.collect(), t.filter("vec_id % 100 = 0").collect())
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).collect()) == want


def test_top_k_of_extreme_vectors(spark):
    """Scores beyond 64 bits and components beyond 62 take no part; all others come, exact."""
    rows = [(0, [1e17] * 4), (1, [1e17] * 4), (2, [1e9] * 4), (3, [0.5] * 4), (4, [1e300, 0.0, 0.0, 0.0]), (5, [-1e16, 1.0, 0.0, 0.0])]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {r.vec_id: [int(x) for x in r.v] for r in t.collect()}
    assert set(whole) == {2, 3, 5}
    big = spark.createDataFrame([(0, [2.0**61] * 4), (1, [2.0**61] * 4), (2, [3.0, 1.0, 0.0, 0.0])], "vec_id long, v array<double>")
    want = {(0, 1, 2, 4 << 61), (1, 1, 2, 4 << 61), (2, 1, 0, 4 << 61), (2, 2, 1, 4 << 61)}
    got = {tuple(r) for r in topk.top_k(big, big, 5).collect()}
    assert got == {x for x in want if x[3] < 1 << 63} == set()
    mixed = spark.createDataFrame([(0, [2.0**61, 0.0]), (1, [2.0**61, 1.0]), (2, [3.0, 1.0]), (3, [1.0, 5.0])], "vec_id long, v array<double>")
    v = {0: (1 << 61, 0), 1: (1 << 61, 1), 2: (3, 1), 3: (1, 5)}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    want = {(a, n + 1, b, score(a, b)) for a in v for n, b in enumerate(sorted((b for b in v if b != a and score(a, b) < 1 << 63), key=lambda b: (-score(a, b), b)))}
    assert {tuple(r) for r in topk.top_k(mixed, mixed, 5).collect()} == want
