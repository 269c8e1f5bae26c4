"""Kept pairs against a full recount after random replacements."""

import random

from critmill.operators import cohorts as co
from critmill.operators.pairs import PairTable


def test_replacements_equal_a_recount(spark, tmp_path):
    rnd = random.Random(4)
    kept = PairTable(spark, f"{tmp_path}/p", 3)
    now: dict[str, list] = {}
    for number in range(1, 4):
        tried = [f"n{rnd.randrange(12)}" for _ in range(9)]
        rows = [(i, rnd.choice([None, "", "A", "B", "C", "D"])) for i in set(tried) for _ in range(rnd.randrange(4))]
        for i in tried:
            now[i] = [r for r in rows if r[0] == i]
        make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
        for _ in range(2):  # a replay changes nothing
            kept.replace(number, make([(i,) for i in tried], "nct_id string"), make([*rows, ("other", "A")], "nct_id string, concept_code string"))
        all_ = {(i, c) for r in now.values() for i, c in r if c}
        assert {tuple(r) for r in kept.store.read("by_trial").collect()} == all_ == {tuple(r) for r in kept.store.read("by_code").collect()}
        assert {r.concept_code: r.trials for r in kept.counts().collect()} == {c: sum(x == c for _, x in all_) for c in {c for _, c in all_}}
        assert kept.size().first().trials == len({i for i, _ in all_})
    want = make([r for x in now.values() for r in x], "nct_id string, concept_code string")
    members = {r.nct_id for r in kept.members("A").collect()}
    assert members == {i for i, c in all_ if c == "A"}
    got = {tuple(r) for r in kept.profile(kept.members("A")).select("size", "concept_code", "trials").collect()}
    assert got == {tuple(r) for r in co.cohort_profile(co.cohort_members("Concept", "A", criteria=want), want).collect()}


def test_large_replacements_write_few_tables_and_sort_no_rows(spark, tmp_path, monkeypatch):
    """Beyond the rows that are broadcast, keys are hashed; what differs is found in one pass, and a first version needs none."""
    from critmill.operators import pairs as pa

    written = []
    real = pa.materialized

    def materialized(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(pa, "materialized", materialized)
    monkeypatch.setattr(pa, "BROADCAST_ROWS", 0)
    kept = PairTable(spark, f"{tmp_path}/p", 2)
    make = lambda rows: spark.createDataFrame(rows, "nct_id string, concept_code string")
    first = [("n1", "A"), ("n1", "B"), ("n2", "A"), ("n2", "A"), ("n3", None), ("n4", "C"), (None, "A")]
    kept.replace(1, make(first), make(first))
    assert len(written) == 4 and not any("SortMergeJoin" in p for p in written)
    kept.replace(2, make([("n1", ""), ("n2", ""), ("n3", "")]), make([("n1", "B"), ("n3", "D"), ("n4", "E")]))
    assert len(written) == 9 and not any("SortMergeJoin" in p for p in written)
    want = {("n1", "B"), ("n3", "D"), ("n4", "C")}
    assert {tuple(r) for r in kept.store.read("by_trial").collect()} == want == {tuple(r) for r in kept.store.read("by_code").collect()}
    assert {r.concept_code: r.trials for r in kept.counts().collect()} == {"B": 1, "C": 1, "D": 1} and kept.size().first().trials == 3
