"""Near-duplicate components against all pairs."""

import random

import pytest

from critmill.llm import graph, neardup


def sets(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size):
    s = {d: sets(t, size) for d, t in rows}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and min(len(s[a]), len(s[b])) * 100 >= 80 * max(len(s[a]), len(s[b])):
                both = len(s[a] & s[b])
                if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def check(df, size, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = neardup.near_duplicates(df, size, **more).collect()
    want = brute(rows, size)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, sf, size):
    check(spark.read.parquet(f"{sf}/documents.parquet"), size)


def test_messy(messy):
    check(messy, 2)


def test_large_groups(spark):
    """Near copies of one text, texts that share a frequent passage, and pairs at the edge of the threshold."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(100000)}"
    base, shared = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(60)] = word()
        rows.append(" ".join(w))
    for i in range(300):
        rows.append(" ".join(shared + [word() for _ in range(rnd.randrange(4, 30))]))
    for i in range(150):
        w = [word() for _ in range(40)]
        rows += [" ".join(w), " ".join(w[: rnd.randrange(32, 37)] + [word() for _ in range(4)])]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 2)


def test_empty_and_null_ids(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (7, "q"), (None, None)], "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 2).collect()}
    assert out == {(None, 2, 4, False), (4, 2, 4, True), (7, 1, 7, True), (None, 0, None, True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5000, 5000)] + [(2000, 2001 + i) for i in range(300)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {1001: 1000, 1002: 1000} | {2001 + i: 2000 for i in range(300)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("slice_bytes", [neardup.SLICE, 2000])
def test_branches_and_tiles(spark, slice_bytes):
    """Nodes of more than a few sets branch, are cut along their largest component, and end in tiles; heavy texts meet in tiles too."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    base, rows = [word() for _ in range(50)], []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(50)] = word()
        rows.append(" ".join(w))
    rows += [" ".join(base[:20] + [word() for _ in range(rnd.randrange(3, 25))]) for _ in range(60)]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 2, small=8, depth=1, slice_bytes=slice_bytes)
