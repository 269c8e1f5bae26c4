"""Each pipeline stage on its own input, against brute force or held-out labels."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from critmill.llm.common import save
from critmill.llm.quality import held_out
from test_neardup import brute
from test_text_ops import brute_removed

SF10 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF10}/documents.parquet").filter("doc_id < 1000")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(save(stage(spark, out[-1], SF10)))
    return out


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1])


def test_quality(spark, steps):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF10}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good, bad = [d for d, q in truth.items() if q == 1], [d for d, q in truth.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d in bad) <= 0.4 * len(bad)


def test_quality_held_out(spark):
    """Error rates on held-out labels alone: bad documents that stay, good ones that go."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.filter(held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    kept = p.filter_quality(spark, docs, d).select("doc_id", F.lit(True).alias("kept"))
    rows = held.join(docs.select("doc_id"), "doc_id", "left_semi").join(kept, "doc_id", "left").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(bad) > 100 and len(good) > 500
    stay, lost = sum(bool(r.kept) for r in bad), sum(not r.kept for r in good)
    print(f"bad that stay {stay} of {len(bad)}, good lost {lost} of {len(good)}")
    assert stay <= 0.05 * len(bad) and lost <= 0.01 * len(good)


def test_near_duplicates(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {d for d, (_, root) in brute(rows, 5).items() if d == root}
    assert {r.doc_id for r in steps[2].collect()} == want


def test_repeats(steps):
    rows = [(r.doc_id, (r.text or "").encode()) for r in steps[2].collect()]
    want = {d: bytes(x for x, g in zip(b, gone) if not g) for d, gone, b in brute_removed(rows, p.PASSAGE_BYTES)}
    for r in steps[3].collect():
        assert r.text.encode() == want[r.doc_id].decode(errors="ignore").encode()


def test_mixing_and_packing(steps):
    before, after = Counter(r.doc_id for r in steps[3].collect()), Counter(r.doc_id for r in steps[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 2
    rows = steps[5].collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == after
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * sum(used.values()) / 2048 + 1
    assert p.ORACLE_SQL is None


def test_stages_on_messy_rows(spark, messy):
    """Nulls in any column, empty and very long texts, repeated rows and clashing column names, stage after stage."""
    docs = messy.withColumn("score", F.lit(1.0)).withColumn("n_bytes", F.lit("mine")).withColumn("taken", F.lit(3)).withColumn("kept", F.lit(True))
    docs = docs.union(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = p.drop_near_duplicates(spark, docs, SF10)
    ids = Counter(r.doc_id for r in kept.collect())
    assert {1, 2, 3, None} <= set(ids) and not {7, 12} & set(ids) and kept.columns == docs.columns
    good = p.filter_quality(spark, docs, SF10)
    assert good.columns == docs.columns and good.count() <= docs.count()
    cut = p.cut_repeats(spark, docs, SF10)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == docs.count() and texts[1] is None and texts[2] == "" and texts[7] == ""
    assert cut.filter("score <> 1 OR n_bytes <> 'mine' OR taken <> 3").count() == 0
    mixed = p.mix_sources(spark, docs, SF10)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}
    packed = p.pack_sequences(spark, docs, SF10)
    assert packed.filter("piece = 0").count() == docs.count()


def test_stages_on_no_rows(spark, empty):
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF10).count() == 0, name
