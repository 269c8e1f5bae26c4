"""Operators on small rows: edge cases, idempotency, agreement of the forms of one rule."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from critmill.functions import text as tx
from critmill.operators import cohorts as co
from critmill.operators import joins as jo
from critmill.operators import resolve as re_
from critmill.operators import responses as rs
from critmill.operators import search as se
from critmill.plans import queries as plans
from critmill.plans import queries_text  # noqa: F401  registers its queries
from critmill.sources import tables as ta
from critmill.sources import terminology as te


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [("  Type 2\t  Diabetes \n", "type 2 diabetes"), ("", ""), (None, ""), (" ", "")])
def test_normalize_key(spark, raw, want):
    assert one(spark, tx.normalize_key(F.lit(raw).cast("string"))) == want


def test_scores(spark):
    score = lambda q, c: one(spark, tx.match_score(F.lit(q), F.lit(c)))
    assert score("heart failure", "Heart Failure") == 1.0
    assert score("failure of the heart", "congestive heart failure") == 1.0
    assert abs(score("HIV", "infection with HIV virus") - 1.0) < 1e-9
    assert score("abc", "xyz") == 0.0
    assert one(spark, tx.acronym_score(F.lit("hiv"), F.lit("HIV"), F.lit(0.5))) == pytest.approx(0.15)
    assert one(spark, tx.levenshtein_similarity(F.lit(" "), F.lit(""))) == 1.0


def test_small_expressions(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, tx.deterministic_id(ns, F.lit("http://a/é"))) == str(uuid.uuid5(uuid.UUID(ns), "http://a/é"))
    assert one(spark, tx.unescape_markdown(F.lit(r"\>= 18 \* a\b"))) == r">= 18 * a\b"
    assert one(spark, tx.strip_bullet(F.lit(" • x"))) == "x"
    assert one(spark, tx.coerce_int(F.lit("-3.9"))) == -3
    assert one(spark, tx.clean_generated_text(F.lit('```\n"NONE"\n```'))) == "NONE"
    assert one(spark, tx.tui_from_uri(F.lit("https://x/T047"))) == "T047"
    assert one(spark, tx.slug(F.lit("??"))) == "export"


@pytest.mark.parametrize(
    "raw, outcome, repaired",
    [
        ("", "invalid_json", False), ("sorry", "invalid_json", False), ("[]", "empty_array", False), ('{"content": "[]"}', "empty_array", False),
        ('[{"NCT_ID":"NCT1","Concept":"x",}]', "success", True), ('[{"NCT_ID":"NCT1","Concept"="x"}]', "success", True), ('[{"NCT_ID":"NCT1","Concept":"x"}', "success", True),
        ('[{"NCT_ID":"NCT1","Qualifier">= 70%","Concept":"x"}]', "success", True), ('[{"NCT_ID":"NCT1","Domain":"d","Concept":"x","OriginalText":"a (b") }]', "success", True),
        ('["{\\"NCT_ID\\":\\"NCT1\\",\\"Concept\\":\\"x\\"}"]', "success", False), ('[{"NCT_ID":"NCT1","Concept":"x","OriginalText":"use ("two words" or so)"}]', "success", True),
        ('[{"NCT_ID":"NCT1","Concept":"x","OriginalText":"line\n two"}]', "success", True), ('[{"NCT_ID":"NCT1","Concept":"x"}]\n}', "success", True),
    ],
)
def test_parsing(spark, raw, outcome, repaired):
    r = rs.parse_responses(spark.createDataFrame([("NCT9", raw)], "nct_id string, raw string")).first()
    assert (r.outcome, r.was_repaired) == (outcome, repaired)
    if outcome == "success":
        assert [(x.nct_id, x.concept) for x in r.records] == [("NCT9", "x")]


def test_writers_are_idempotent(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    batch, tried = t.filter("k = 'a'").withColumn("v", F.lit(9)), spark.createDataFrame([("a",), ("b",)], "k string")
    once = ta.replace_by_key(t, batch, "k", tried)
    assert sorted(once.collect()) == sorted(ta.replace_by_key(once, batch, "k", tried).collect()) == [("a", 9), ("c", 3)]
    up = ta.upsert(t, spark.createDataFrame([("a", 5), ("z", 7)], "k string, v int"), ["k"], {"v": "increment"})
    assert sorted(up.collect()) == [("a", 6), ("b", 2), ("c", 3), ("z", 7)]


def test_latest_and_superseded_agree(spark):
    rows = [(i, f"N{i % 4}", i // 8) for i in range(40)]
    a = spark.createDataFrame(rows, "attempt_id long, nct_id string, started_at long").withColumn("status", F.lit("x")).withColumn("run_id", F.lit("r"))
    latest, old = se.latest_attempt(a), se.superseded(a)
    assert latest.count() + old.count() == a.count() and latest.join(old, "attempt_id").count() == 0
    assert se.list_attempts(a, size=100).count() == latest.count()


def test_closure_is_cycle_safe(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "child_cui string, parent_cui string")
    assert sorted(te.concept_closure(e).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 1)]


def test_closure_of_any_depth(spark):
    """Six levels and more on random edges with cycles, against a search from every node."""
    rnd = np.random.default_rng(8)
    edges = {(int(a), int(a + b)) for a, b in zip(rnd.integers(0, 60, 70), rnd.integers(1, 8, 70))} | {(50, 20), (9, 9)}
    e = spark.createDataFrame([(f"c{a}", f"c{b}") for a, b in edges], "child_cui string, parent_cui string").coalesce(2)

    def brute(depth):
        out = set()
        for start in {a for a, _ in edges}:
            far, front = {start: 0}, {start}
            for d in range(1, depth + 1):
                front = {b for a, b in edges if a in front} - set(far)
                far |= dict.fromkeys(front, d)
            out |= {(f"c{start}", f"c{x}", d) for x, d in far.items() if d}
        return out

    assert max(d for _, _, d in brute(100)) > 6
    assert {tuple(r) for r in te.concept_closure(e, 6).collect()} == brute(6)
    assert {tuple(r) for r in te.concept_closure(e, None).collect()} == brute(100)


def test_backfill_refuses_an_incomplete_terminology(spark):
    c = spark.createDataFrame([("C1", None, None), ("C9", None, None), (None, None, None)], "concept_code string, semantic_type string, semantic_type_tuis array<string>")
    types = spark.createDataFrame([("C1", "T1", "Disease")], "cui string, tui string, sty string")
    concepts = spark.createDataFrame([("C1",), ("C2",)], "cui string")
    with pytest.raises(ValueError, match="1 concepts"):
        co.backfill_job(c, concepts, types)
    new, told = co.backfill_job(c, concepts.filter("cui = 'C1'"), types)
    assert tuple(told.first()) == (1, 1) and new.filter("semantic_type = 'Disease'").count() == 1
    assert co.backfill_job(c, concepts.filter("cui = 'C1'"), types, dry_run=True)[0].filter("semantic_type IS NOT NULL").count() == 0


def test_lift_of_nothing(spark):
    e = spark.createDataFrame([], "nct_id string, concept_code string")
    none = co.defining_codes("Phase", "1", None, spark)
    names = spark.createDataFrame([], "cui string, pref_name string")
    assert co.lift_table(co.cohort_profile(e.select("nct_id"), e), co.corpus_profile(e), co.corpus_trial_count(e), names, none).count() == 0
    assert co.cohort_members("Year", "soon", criteria=e, detail=e.withColumn("start_date", F.current_date())).count() == 0


def test_csv(spark):
    df = spark.createDataFrame([('a "q"', "x,y", None)], "a string, b string, c string")
    assert ta.csv_rows(df).first()[0] == '"a ""q""","x,y",'
    assert ta.csv_header(df, ["A", 'B"', "C"]).first()[0] == 'A,"B""",C'


def test_csv_file(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), (None, 2)], "a string, b int")
    ta.export_csv(df.coalesce(1), f"{tmp_path}/out", ["A,", "B"])
    files = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(f.read_bytes() for f in files) == b'"A,",B\r\n"a\nb",1\r\n,2\r\n'


def test_dry_run_of_retries_changes_nothing(spark):
    c = spark.createDataFrame([("n1", "asthma", None)], "nct_id string, concept string, concept_code string")
    for name, kind in (("umls_name", "string"), ("match_score", "double"), ("match_source", "string"), ("semantic_type", "string"), ("semantic_type_tuis", "array<string>")):
        c = c.withColumn(name, F.lit(None).cast(kind))
    atoms = spark.createDataFrame([("C1", "asthma", "asthma")], "cui string, str string, str_norm string")
    concepts = spark.createDataFrame([("C1", "asthma", "MSH")], "cui string, pref_name string, root_source string")
    types = spark.createDataFrame([("C1", "T1", "Disease")], "cui string, tui string, sty string")
    for dry, code in ((True, None), (False, "C1")):
        out, ledger = re_.retry_unresolved(c, c.select("nct_id"), atoms, concepts, types, dry_run=dry)
        assert [r.concept_code for r in out.collect()] == [code]
        assert [tuple(r) for r in ledger.collect()] == [("n1", 1, 1)]


def test_conditions_meet_a_stored_dictionary(spark):
    stored = spark.createDataFrame([("asthma", "Asthma", 3, "C1", None, None, None)], "condition_norm string, raw_form string, study_count long, code string, match_tier string, match_score double, resolved_at timestamp")
    atoms = spark.createDataFrame([("C1", "asthma", "asthma"), ("C2", "gout", "gout")], "cui string, str string, str_norm string")
    concepts = spark.createDataFrame([("C1", "asthma", "MSH"), ("C2", "gout", "MSH")], "cui string, pref_name string, root_source string")
    closure = spark.createDataFrame([], "descendant string, ancestor string, min_distance int")
    mentions = spark.createDataFrame([("n1", " ASTHMA"), ("n1", "gout")], "nct_id string, cond string")
    out = re_.ensure_conditions(mentions, stored, atoms, concepts, closure, "2024-01-01 00:00:00")
    assert sorted((r.condition_norm, r.study_count, r.code, r.match_tier, r.resolved_at is None) for r in out.collect()) == [("asthma", 3, "C1", None, True), ("gout", 0, "C2", "exact", False)]
    assert [r.condition_norm for r in re_.pending_conditions(out).collect()] == ["asthma"]
    assert [r.condition_norm for r in re_.pending_conditions(out, force=True).collect()] == ["asthma", "gout"]


def test_empty_filters(spark):
    d = spark.createDataFrame([("N1", "t")], "nct_id string, brief_title string")
    assert se.search_studies(d, {"brief_title": " "}).count() == 0
    assert rs.empty_batch_placeholder(d.limit(0)).first().asDict() == {"nct_id": "", "brief_title": ""}


def test_retries_and_terms_without_a_cap(spark, sf, monkeypatch):
    """More than 100,000 trials and concepts all come, and r6 and r7_* ask for all."""
    e = spark.range(100_005).select(F.format_string("NCT%08d", "id").alias("nct_id"), F.format_string("c%d", "id").alias("concept"), F.lit(None).cast("string").alias("concept_code"))
    assert jo.trials_to_retry(e, e.select("nct_id").limit(0), n=None).count() == 100_005
    cache = e.limit(0).select(F.col("concept").alias("concept_norm"))
    assert co.concepts_to_normalize(e, cache, n=None).count() == 100_005 and co.concepts_to_normalize(e, cache).count() == 100_000
    asked = []
    for module, name in ((jo, "trials_to_retry"), (co, "concepts_to_normalize")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: asked.append(b["n"]) or f(*a, **b))
    for name in ("r6_retry_unresolved", "r7_no_terms", "r7_apply_terms"):
        plans.QUERIES[name](spark, sf)
    assert asked == [None] * 3


@pytest.mark.parametrize("match", [[], ["phase"]])
def test_similar_in_many_cells(spark, match):
    """All ids divisible by 50 against all rows, in cells whose number grows with the tables; against brute force."""
    rnd = np.random.default_rng(3)
    v, phase = rnd.normal(size=(600, 8)), rnd.integers(0, 3, 600)
    ids = [f"NCT{i:08d}" for i in range(600)]
    emb = spark.createDataFrame([(d, x.tolist(), int(p)) for d, x, p in zip(ids, v, phase)], "nct_id string, embedding array<double>, phase int")
    queries = emb.filter(F.substring("nct_id", 4, 8).cast("int") % 50 == 0).withColumnRenamed("nct_id", "query_id")
    t = jo.similar_to_vectors(emb, queries, k=5, match=match, block=4, rows_block=50)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 4)
    want = {(ids[i], ids[j], n + 1) for i in range(0, 600, 50) for n, j in enumerate(sorted((j for j in range(600) if not match or phase[i] == phase[j]), key=lambda j: (-s[i, j], ids[j]))[:5])}
    assert {(r.query_id, r.nct_id, r["rank"]) for r in t.collect()} == want


def test_fuzzy_arms_skip_long_and_panel_atoms(spark):
    atoms = [("C1", "chest pains | panel"), ("C2", "chest pain " + "x" * 80), ("C3", "chest pain syndrome")]
    atoms = spark.createDataFrame(atoms, "cui string, str string")
    q = spark.createDataFrame([("chest pain",)], "query string")
    assert {r.cui for r in re_.trigram_arm(q, atoms).collect()} == {"C3"}
    assert {r.cui for r in re_.token_arm(q, atoms).collect()} == {"C3"}


def test_sort_menus(spark):
    """Ties follow the key's own direction; nulls come last; unknown keys mean the first."""
    rows = [(1, "b", None), (2, "a", 0.5), (3, "a", 0.9), (4, "b", 0.9)]
    t = spark.createDataFrame(rows, "id long, concept string, match_score double").withColumn("created_at", F.lit("2024-01-01"))
    order = lambda key: [r.id for r in se.search_criteria(t, sort=key)[0].collect()]
    assert order("concept_asc") == [2, 3, 1, 4] and order("match_score_desc") == [4, 3, 2, 1] and order("created_at_asc") == [1, 2, 3, 4]
    assert order("no such key") == order(None) == order("created_at_desc") == [4, 3, 2, 1]
    a = spark.createDataFrame([("r", "n1", "failed", 3), ("r", "n2", "done", None), ("r", "n3", "done", 7)], "run_id string, nct_id string, status string, llm_prompt_tokens long")
    a = a.withColumn("started_at", F.lit("2024-01-01")).withColumn("attempt_id", F.col("nct_id"))
    names = lambda key: [r.nct_id for r in se.list_attempts(a, sort=key).collect()]
    assert names("prompt_tokens_desc") == ["n3", "n1", "n2"] and names("status_asc")[2] == "n1" and names("parsed_desc") == names("newest") == ["n3", "n2", "n1"]


def test_upsert_takes_one_row_a_key_and_children_keep_their_origin(spark):
    t = spark.createDataFrame([("p", 1, "x", "then", "ann"), ("p", 2, "y", "then", "ann"), ("q", 3, "z", "then", "ann")], "parent string, id long, v string, created_at string, created_by string")
    new = spark.createDataFrame([("p", 1, "x2", "now", "bob"), ("p", 4, "w", "now", "bob")], t.schema)
    got = {tuple(r) for r in rs.sync_children(t, new, "parent", "id").collect()}
    assert got == {("p", 1, "x2", "then", "ann"), ("p", 4, "w", "now", "bob"), ("q", 3, "z", "then", "ann")}
    twice = new.union(new.withColumn("v", F.lit("a")))
    assert {(r.id, r.v) for r in ta.upsert(t, twice, ["id"]).collect()} == {(1, "x2"), (2, "y"), (3, "z"), (4, "w")}
    s = spark.createDataFrame([(1, "old"), (3, "old")], "criterion_id long, text string")
    assert {tuple(r) for r in rs.replace_sources(s, s.limit(0).union(spark.createDataFrame([(1, "new")], s.schema)), spark.createDataFrame([(1,)], "criterion_id long")).collect()} == {(1, "new"), (3, "old")}


def test_empty_profile_keeps_the_size(spark):
    c = spark.createDataFrame([("n1", None), ("n2", "C1")], "nct_id string, concept_code string")
    members = spark.createDataFrame([("n1",)], "nct_id string")
    assert [tuple(r) for r in co.cohort_profile(members, c).collect()] == [(1, None, None)]


def test_stream_of_runs_equals_one_run_and_replays(spark, tmp_path):
    from critmill.plans.batch import CRITERIA, run_batch
    from critmill.streaming.batches import stream_runs

    text = "Adults of at least eighteen years who have given their consent to take part"
    ids = [f"NCT{i:08d}" for i in range(6)]
    for k in range(2):
        spark.createDataFrame([(i, text) for i in ids[k::2]] + [("NCT99999999", "short")], "nct_id string, criteria string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    raw = ['[{"NCT_ID":"x","Criterion":"Inclusion","Concept":"asthma","OriginalText":"t"}]', "[]", "no answer", None, '[{"NCT_ID":"x","Concept":"asthma",}]']
    responses = spark.createDataFrame(list(zip(ids, raw)), "nct_id string, raw string")
    atoms = spark.createDataFrame([("C1", "asthma", "asthma")], "cui string, str string, str_norm string")
    concepts = spark.createDataFrame([("C1", "asthma", "MSH")], "cui string, pref_name string, root_source string")
    types = spark.createDataFrame([("C1", "T1", "Disease")], "cui string, tui string, sty string")
    kinds = {"ord": "int", "match_score": "double", "semantic_type_tuis": "array<string>"}
    start = {
        "criteria": spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in CRITERIA)),
        "attempts": spark.createDataFrame([], "run_id string, nct_id string, status string, message string, was_repaired boolean, criterion_count int, started_at timestamp"),
        "failures": spark.createDataFrame([], "nct_id string, attempt_count int, last_error string"),
    }

    def run(trials, old, number):
        r = run_batch(trials, responses, atoms, concepts, types, old["criteria"], old["attempts"], old["failures"], "r1", "2024-01-01 00:00:00")
        return {"criteria": r.criteria, "attempts": r.attempts, "failures": r.failures}

    rows = lambda tables: {n: sorted(map(str, t.collect())) for n, t in tables.items()}
    source = spark.readStream.schema("nct_id string, criteria string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream_runs(source, start, run, f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    streamed = rows({n: spark.read.parquet(f"{tmp_path}/state/1/{n}") for n in start})
    once = run(spark.createDataFrame([(i,) for i in ids], "nct_id string"), start, 0)
    assert streamed == rows(once) == rows(run(spark.createDataFrame([(i,) for i in ids], "nct_id string"), once, 0))
    assert [len(streamed[n]) for n in start] == [2, 6, 3]


def test_distinct_estimates_are_close(spark):
    """Within 15 %, three times the sketch's default standard error of 5 %, from few values to many; nulls don't count."""
    t = spark.range(60_000).select(F.col("id").alias("each"), (F.col("id") % 5_000).alias("some"), (F.col("id") % 7).alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r.column_name: r.estimate for r in se.distinct_estimates(t, t.columns).collect()}
    assert all(abs(got[c] - n) <= 0.15 * n for c, n in {"each": 60_000, "some": 5_000, "few": 7, "none": 0}.items())
