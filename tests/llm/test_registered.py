"""The opN queries as they are registered: their columns and rows on the smallest tables."""

from collections import Counter

import pytest

from critmill.llm import queries

COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_simhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows, want = out.collect(), Counter(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert Counter(r.doc_id for r in rows if name != "op4_packing" or r.piece == 0) == want
    if name == "op3_sharding":
        assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} <= set(range(40)) and all(r.grown_shard is None for r in rows)
        by = Counter(r.shard for r in rows)
        assert all({r.slot for r in rows if r.shard == s} == set(range(n)) for s, n in by.items())
    if name == "op8_quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_registered_top_k(spark, sf):
    rows = queries.op7_top_k(spark, sf).collect()
    asked = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 20 == 0}
    assert {r.query_id for r in rows} == asked and all(sorted(r.rank for r in rows if r.query_id == q) == list(range(1, 21)) for q in asked)
