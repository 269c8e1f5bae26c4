"""Mixing, sharding, packing, token files and top-k against brute force and round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from critmill.llm import mixing, packing, queries, sharding, tokens, topk


def n_words(text):
    return len((text or "").encode().split())


def brute_targets(sizes, weights, share, cap):
    """Reshares the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        room = budget - sum(fixed.values())
        t = {s: room * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_mixing(spark, sf, messy, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    source = docs.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in source)
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in source:
        sizes[r.source] += n_words(r.text)
        longest[r.source] = max(longest[r.source], n_words(r.text))
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    for r in out:
        assert r.size == n_words(r.text) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.01 * longest[s]
    if which == "documents":
        assert again == {(r.doc_id, r.taken) for r in out}
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in out)


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_sharding(spark, sf, messy, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet")
    n = 8
    out = sharding.shard(docs, n, chunk_bytes=20000).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    size, slots = [0] * n, defaultdict(list)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    slack = 0.011 * sum(size) / n + max(r.size for r in out)
    assert max(size) - min(size) <= 2 * slack
    if which == "documents":
        where = defaultdict(set)
        for r in out:
            where[r.text].add(r.shard)
        assert sum(len(x) > 1 for x in where.values()) <= n


def test_sharding_hot_group_and_empty(spark, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    size = Counter()
    for r in sharding.shard(docs, 10).collect():
        size[r.shard] += r.size
    assert len(size) == 10 and max(size.values()) < 1.03 * min(size.values())
    assert sharding.shard(empty, 4).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def whole_ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_packing(spark, sf, messy, tokenizer, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    parts = packing.pieces(docs, queries.TOKENIZER, with_ids=True)
    packed = packing.pack(parts)
    out = packed.collect()
    by_doc = defaultdict(list)
    for r in docs.collect():
        by_doc[r.doc_id].append(whole_ids(tokenizer, r.text, 0))
    want = Counter()
    for d, copies in by_doc.items():
        for ids in copies:
            for p, i in enumerate(range(0, len(ids), 2048)):
                want[d, p, i, len(ids[i : i + 2048]), crc(ids[i : i + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    rows = defaultdict(list)
    for r in out:
        rows[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for x in rows.values():
        at = 0
        for offset, length, _ in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(rows) <= 1.02 * total / 2048 + 1
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert got == {s: b"".join(i for _, _, i in sorted(x)) for s, x in rows.items()}


def test_packing_empty(empty):
    assert packing.pack(packing.pieces(empty, queries.TOKENIZER)).count() == 0


def test_fullest_against_all_subsets():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        items = rnd.integers(1, 40, rnd.integers(1, 9)).tolist()
        room = int(rnd.integers(1, 90))
        used = packing.fullest(Counter(items), sorted(set(items), reverse=True), room)
        assert all(Counter(items)[k] >= v for k, v in used.items())
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(k * v for k, v in used.items()) == max(sums)


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_token_files(spark, sf, messy, tokenizer, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    out = tokens.read_tokens(tokens.write_tokens(docs, queries.TOKENIZER, 1, tokens.token_folder(docs)), with_ids=True).collect()
    source = docs.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r.doc_id, tuple(whole_ids(tokenizer, r.text, 1))) for r in source)
    at, last = 0, None
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    assert out and sorted(out, key=lambda r: r.start)[0].doc_id is None


def test_token_files_empty(empty):
    assert tokens.read_tokens(tokens.write_tokens(empty, queries.TOKENIZER, 1, tokens.token_folder(empty))).count() == 0


def test_sharding_driver_part(spark, sf, monkeypatch):
    """The keys that reach the driver don't depend on the number of chunks, and chunks hold about what they should."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    probes, count = [], sharding._histogram
    monkeypatch.setattr(sharding, "_histogram", lambda t, keys: probes.append(len(keys)) or count(t, keys))
    seen = {}
    for chunk_bytes in (1 << 30, 5000):
        probes.clear()
        out = sharding.shard(docs, 4, chunk_bytes=chunk_bytes).collect()
        seen[chunk_bytes] = list(probes), {r.doc_id: (r.shard, r.slot) for r in out}
        size, slots = Counter(), defaultdict(list)
        for r in out:
            size[r.shard, r.chunk] += r.size
            slots[r.shard, r.chunk].append(r.slot)
        # Slots of a chunk are one run; a chunk passes its size by the rows of its last key at most.
        assert all(max(x) - min(x) + 1 == len(x) for x in slots.values())
        assert max(size.values()) <= chunk_bytes + max(r.size for r in out)
    assert seen[1 << 30] == seen[5000] and len(size) > 40


def test_write_shards(spark, messy, tmp_path):
    """What is written and read again: every row once, in folders by shard, with a column that clashes replaced."""
    docs = messy.withColumn("shard", F.lit("mine")).withColumn("chunk", F.lit("mine")).withColumn("slot", F.lit("mine"))
    out = sharding.shard(docs, 5, chunk_bytes=20000)
    sharding.write_shards(out, f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert {r.shard for r in got.select("shard").collect()} == set(range(5))
    assert Counter(map(tuple, got.select(*out.columns).collect())) == Counter(map(tuple, out.collect()))


def brute_top(vectors, k):
    out = set()
    for q, a in vectors:
        if q % 20 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in vectors if c != q and len(a) == len(b)))[:k]
            out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)] + [(400, [1e9, 2e9, -3e9, 1e8])]
    bad = [(1000, None), (1020, [1.0, None, 2.0, 3.0]), (1040, [float("nan")] * 4), (1060, [float("inf")] * 4), (1080, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    v = topk.quantised(df)
    monkeypatch.setattr(topk, "COLUMNS", 4)
    monkeypatch.setattr(topk, "PASS_ROWS", 8)  # three passes
    out = topk.top_k(v.filter("vec_id % 20 = 0"), v.repartition(11), k=7, query_rows=6, shard_rows=9, fan_in=3).collect()
    want = brute_top([(i, [int(np.floor(64 * x)) for x in a]) for i, a in rows], 7)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == want and len(out) == len(want)
    # Null ids take no part, large ones stay exact, and repeated ones are rows of their own.
    big = (1 << 60) + 1
    odd = [(None, [3.0, 3.0, 3.0, 3.0]), (big, [2.0, 2.0, 2.0, 2.0]), (big, [1.0, 2.0, 2.0, 2.0]), (20, [1.0, 1.0, 1.0, 1.0]), (0, [0.0, 1.0, 0.0, 1.0])]
    w = topk.quantised(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(w.filter("vec_id % 20 = 0"), w, k=3).collect()}
    assert got == {(20, 1, big, 8 * 4096), (20, 2, big, 7 * 4096), (20, 3, 0, 2 * 4096), (0, 1, big, 4 * 4096), (0, 2, big, 4 * 4096), (0, 3, 20, 2 * 4096)}
    # A repeated query gives its rows again.
    twice = w.filter("vec_id = 20")
    got = Counter(tuple(r) for r in topk.top_k(twice.union(twice), w, k=2).collect())
    assert got == {(20, 1, big, 8 * 4096): 2, (20, 2, big, 7 * 4096): 2}
    few = v.filter("vec_id < 3")
    assert topk.top_k(few, few, k=7).count() == 6
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
