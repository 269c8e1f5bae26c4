"""Registered queries: operators over whole tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cohorts as co
from ..operators import joins as jo
from ..operators import options as op
from ..operators import resolve as re_
from ..operators import responses as rs
from ..operators import search as se
from ..operators import vectors as ve
from ..sources import tables as ta
from ..sources import terminology as te
from .bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CODE = "C0000007"
LEXER = "list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
WORDS = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
TOKENS = "list_distinct(list_filter(" + WORDS + ", lambda w: length(w) >= 2 AND NOT list_contains(" + STOP + ", w)))"


def query(sql: str | None = None):
    """Registers f(tables) under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


LIFT = """
    SELECT p.concept_code, coalesce(n.pref_name, p.concept_code) AS concept_name, c.trials AS cohort_trials, p.trials AS corpus_trials,
           c.trials * 100.0 / s.size AS pct_cohort, p.trials * 100.0 / t.total AS pct_corpus, c.trials * 100.0 / s.size - p.trials * 100.0 / t.total AS excess_pp,
           (c.trials * 100.0 / s.size) / (p.trials * 100.0 / t.total) AS lift, p.concept_code IN (SELECT code FROM defining) AS is_defining
    FROM (SELECT concept_code, count(*) AS trials FROM pairs WHERE nct_id IN (SELECT nct_id FROM members) GROUP BY 1) c
    JOIN profile p USING (concept_code) LEFT JOIN concepts n ON n.cui = p.concept_code,
    (SELECT count(*) AS size FROM members) s, (SELECT count(DISTINCT nct_id) AS total FROM pairs) t
    WHERE c.trials >= 10"""


def lift(t: Tables, members: Callable[[DataFrame], DataFrame], defining: DataFrame) -> DataFrame:
    """The pairs are written once and stand for the criteria in all four parts."""
    p = ta.materialized(co.pairs(t.b_eligibility))
    members = ta.materialized(members(p))
    return co.lift_table(co.cohort_profile(members, p), co.corpus_profile(p), co.corpus_trial_count(p), t.concepts, defining)


@query(f"WITH members AS (SELECT DISTINCT nct_id FROM pairs WHERE concept_code = '{CODE}'), defining AS (SELECT '{CODE}' AS code) {LIFT}")
def a5_lift_concept(t):
    return lift(t, lambda p: co.cohort_members("Concept", CODE, criteria=p), co.defining_codes("Concept", CODE, None, t.spark))


@query(f"""WITH defining AS (SELECT 'C0001007' AS code UNION SELECT descendant FROM closure WHERE ancestor = 'C0001007'),
    members AS (SELECT DISTINCT nct_id FROM pairs WHERE concept_code IN (SELECT code FROM defining)) {LIFT}""")
def a5_lift_descendants(t):
    closure = ta.materialized(t.closure)
    return lift(t, lambda p: co.cohort_members("Concept", "C0001007", criteria=p, closure=closure), co.defining_codes("Concept", "C0001007", closure, t.spark))


@query("SELECT DISTINCT nct_id FROM b_study_detail WHERE phase = '1-URGENT' AND nct_id IN (SELECT nct_id FROM pairs)")
def a1_members_phase(t):
    return co.cohort_members("Phase", "1-URGENT", criteria=t.b_eligibility, detail=t.b_study_detail)


@query("SELECT DISTINCT nct_id FROM b_study_detail WHERE year(start_date) = 1996 AND nct_id IN (SELECT nct_id FROM pairs)")
def a1_members_year(t):
    return co.cohort_members("Year", "1996", criteria=t.b_eligibility, detail=t.b_study_detail)


def dictionary(t: Tables) -> DataFrame:
    """Seeded conditions with the smallest exact code."""
    code = t.atoms.groupBy(F.col("str_norm").alias("condition_norm")).agg(F.min("cui").alias("code"))
    return co.seed_conditions(t.b_condition_mention).join(code, "condition_norm", "left")


@query(f"""SELECT DISTINCT m.nct_id FROM mentions m JOIN (SELECT str_norm, min(cui) AS code FROM atoms GROUP BY 1) a ON a.str_norm = m.norm
    WHERE a.code = '{CODE}' AND m.nct_id IN (SELECT nct_id FROM pairs)""")
def a1_members_condition(t):
    return co.cohort_members("Condition", CODE, criteria=t.b_eligibility, mentions=t.b_condition_mention, dictionary=dictionary(t))


@query(f"""WITH m AS (SELECT DISTINCT nct_id FROM pairs WHERE concept_code = '{CODE}')
    SELECT (SELECT count(*) FROM m) AS size, concept_code, count(*) AS trials FROM pairs WHERE nct_id IN (SELECT nct_id FROM m) GROUP BY concept_code""")
def a2_cohort_profile(t):
    return co.cohort_profile(co.cohort_members("Concept", CODE, criteria=t.b_eligibility), t.b_eligibility)


@query("SELECT * FROM profile")
def a3_corpus_profile(t):
    return co.corpus_profile(t.b_eligibility)


@query("SELECT count(DISTINCT nct_id) AS trials FROM pairs")
def a4_corpus_trials(t):
    return co.corpus_trial_count(t.b_eligibility)


@query("SELECT 'C0001007' AS concept_code UNION SELECT descendant FROM closure WHERE ancestor = 'C0001007'")
def a6_defining_codes(t):
    return co.defining_codes("Concept", "C0001007", t.closure, t.spark)


@query("""WITH d AS (SELECT DISTINCT nct_id, CAST(year(start_date) AS INTEGER) AS y FROM b_study_detail WHERE start_date IS NOT NULL),
    c AS (SELECT unnest(['C0000007', 'C0000011', 'C0000199']) AS code), s AS (SELECT y, count(DISTINCT nct_id) AS n FROM d GROUP BY 1),
    h AS (SELECT y, concept_code, count(DISTINCT nct_id) AS k FROM pairs JOIN d USING (nct_id) GROUP BY ALL)
    SELECT s.y AS start_year, code AS concept_code, n AS studies, coalesce(k, 0) AS trials, round(coalesce(k, 0) * 100.0 / n, 4) AS percent, s.y = 1998 AS is_partial
    FROM s CROSS JOIN c LEFT JOIN h ON h.y = s.y AND h.concept_code = c.code""")
def a7_concept_trend(t):
    return co.concept_trend(t.b_eligibility, t.b_study_detail, ["C0000007", " C0000011", "C0000199", "C0000007"], 1998)


@query(f"""SELECT coalesce(nullif(phase, ''), '(none)') AS phase, count(DISTINCT p.nct_id) AS trials FROM pairs p LEFT JOIN b_study_detail d USING (nct_id)
    WHERE concept_code = '{CODE}' GROUP BY 1""")
def a8_phase_breakdown(t):
    return co.phase_breakdown(t.b_eligibility, t.b_study_detail, CODE)


@query("""WITH ty AS (SELECT cui, string_agg(DISTINCT sty, '; ' ORDER BY sty) AS s FROM b_type GROUP BY 1),
    up AS (SELECT descendant AS cui, count(*) AS n FROM closure GROUP BY 1), dn AS (SELECT ancestor AS cui, count(*) AS n FROM closure GROUP BY 1),
    ex AS (SELECT cui, string_agg(x, '|' ORDER BY x) AS e FROM (SELECT concept_code AS cui, original_text AS x, row_number() OVER (PARTITION BY concept_code ORDER BY original_text) AS i
        FROM (SELECT DISTINCT concept_code, original_text FROM b_eligibility WHERE concept_code IS NOT NULL)) WHERE i <= 5 GROUP BY 1),
    ph AS (SELECT concept_code AS cui, string_agg(p || '=' || CAST(n AS VARCHAR), '|' ORDER BY p) AS h FROM (SELECT concept_code, coalesce(nullif(phase, ''), '(none)') AS p, count(*) AS n
        FROM pairs LEFT JOIN b_study_detail USING (nct_id) GROUP BY ALL) GROUP BY 1)
    SELECT c.cui, pref_name, root_source, coalesce(ty.s, '') AS semantic_types, coalesce(up.n, 0) AS ancestors, coalesce(dn.n, 0) AS descendants, coalesce(p.trials, 0) AS trials,
        (SELECT count(DISTINCT nct_id) FROM pairs) AS corpus_trials, coalesce(h, '') AS phases, coalesce(e, '') AS examples
    FROM concepts c LEFT JOIN ty USING (cui) LEFT JOIN up USING (cui) LEFT JOIN dn USING (cui) LEFT JOIN profile p ON p.concept_code = c.cui LEFT JOIN ex USING (cui) LEFT JOIN ph USING (cui)""")
def a8_concept_summary(t):
    s = co.concept_summary(t.concepts.select("cui"), t.concepts, t.b_type, t.closure, t.b_eligibility, t.b_study_detail)
    shown = F.array_join(F.transform("phases", lambda x: F.concat(x["phase"], F.lit("="), x["trials"].cast("string"))), "|")
    return s.select("cui", "pref_name", "root_source", "semantic_types", "ancestors", "descendants", "trials", "corpus_trials", F.coalesce(shown, F.lit("")).alias("phases"), F.coalesce(F.array_join("examples", "|"), F.lit("")).alias("examples"))


KEY = "CASE WHEN concept_code IS NOT NULL AND concept_code <> '' THEN concept_code ELSE 'concept:' || lower(concept) END"


@query(f"""SELECT criterion, {KEY} AS group_key, concept_code IS NOT NULL AS is_resolved, max(concept) AS label, coalesce(string_agg(DISTINCT semantic_type, ', ' ORDER BY semantic_type), '') AS semantic_types,
    count(DISTINCT nct_id) AS studies, count(*) AS records FROM b_eligibility WHERE nct_id IN (SELECT nct_id FROM pairs WHERE concept_code = '{CODE}') GROUP BY 1, 2, 3""")
def a9_cluster_criteria(t):
    return co.cluster_criteria(t.b_eligibility, co.cohort_members("Concept", CODE, criteria=t.b_eligibility))


@query(f"""WITH e AS (SELECT * FROM b_eligibility WHERE nct_id IN (SELECT nct_id FROM pairs WHERE concept_code = '{CODE}')),
    codes AS (SELECT DISTINCT concept_code AS c FROM e WHERE concept_code IS NOT NULL),
    near AS (SELECT descendant, ancestor FROM closure WHERE min_distance <= 1 AND descendant IN (SELECT c FROM codes)),
    cover AS (SELECT * FROM near UNION SELECT c, c FROM codes WHERE c IN (SELECT ancestor FROM near)),
    good AS (SELECT ancestor, count(DISTINCT descendant) AS k FROM cover GROUP BY 1 HAVING count(DISTINCT descendant) > 1),
    tot AS (SELECT ancestor, count(DISTINCT descendant) AS n FROM closure GROUP BY 1),
    best AS (SELECT descendant AS concept_code, ancestor FROM (SELECT descendant, cover.ancestor, row_number() OVER (PARTITION BY descendant ORDER BY k DESC, coalesce(n, 0), cover.ancestor) AS i
        FROM cover JOIN good USING (ancestor) LEFT JOIN tot USING (ancestor)) WHERE i = 1)
    SELECT criterion, coalesce(ancestor, {KEY.replace("concept_code", "e.concept_code")}) AS group_key, e.concept_code IS NOT NULL AS is_resolved, max(coalesce(c.pref_name, concept)) AS label, max(ancestor) AS ancestor_code,
        coalesce(string_agg(DISTINCT e.concept_code, ',' ORDER BY e.concept_code), '') AS member_codes, count(DISTINCT nct_id) AS studies, count(*) AS records
    FROM e LEFT JOIN best USING (concept_code) LEFT JOIN concepts c ON c.cui = ancestor GROUP BY 1, 2, 3""")
def a10_cluster_rolled_up(t):
    c = co.cluster_criteria_rolled_up(t.b_eligibility, co.cohort_members("Concept", CODE, criteria=t.b_eligibility), t.closure, t.concepts, 1)
    return c.withColumn("member_codes", F.array_join("member_codes", ","))


@query(f"""SELECT id, nct_id, concept, original_text FROM b_eligibility WHERE criterion = 'Inclusion' AND {KEY} = 'C0000011'""")
def a11_cluster_records(t):
    return co.cluster_records(t.b_eligibility, t.b_study_detail, "Inclusion", key="C0000011").select("id", "nct_id", "concept", "original_text")


SEED = """WITH f AS (SELECT norm, raw, count(DISTINCT nct_id) AS n FROM mentions WHERE norm <> '' GROUP BY ALL),
    b AS (SELECT norm, raw, row_number() OVER (PARTITION BY norm ORDER BY n DESC, raw) AS i FROM f),
    seed AS (SELECT norm AS condition_norm, raw AS raw_form, (SELECT count(DISTINCT nct_id) FROM mentions m WHERE m.norm = b.norm) AS study_count FROM b WHERE i = 1)"""


@query(f"{SEED} SELECT * FROM seed")
def a12_seed_conditions(t):
    return co.seed_conditions(t.b_condition_mention)


#: A dictionary from before: two thirds of the keys, half of these with another raw form, and a key that no trial mentions.
STORED = """stored AS (SELECT condition_norm, CASE WHEN length(condition_norm) % 3 = 0 THEN raw_form ELSE raw_form || ' old' END AS raw_form, CAST(1 AS BIGINT) AS study_count, 'C1' AS code, '2024-01-01' AS resolved FROM seed WHERE length(condition_norm) % 3 < 2
    UNION ALL SELECT 'gone', 'Gone', 4, 'C2', '2024-01-01')"""


def stored_dictionary(t: Tables) -> DataFrame:
    s, n = co.seed_conditions(t.b_condition_mention), F.length("condition_norm") % 3
    s = s.filter(n < 2).select("condition_norm", F.when(n == 0, F.col("raw_form")).otherwise(F.concat("raw_form", F.lit(" old"))).alias("raw_form"), F.lit(1).cast("long").alias("study_count"), F.lit("C1").alias("code"))
    gone = t.spark.createDataFrame([("gone", "Gone", 4, "C2")], s.schema)
    return s.union(gone).withColumn("resolved_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""{SEED}, {STORED} SELECT coalesce(s.condition_norm, d.condition_norm) AS condition_norm, coalesce(s.raw_form, d.raw_form) AS raw_form, coalesce(s.study_count, d.study_count) AS study_count, d.code,
    CASE WHEN s.raw_form IS NULL OR s.raw_form = d.raw_form THEN d.resolved END AS resolved FROM stored d FULL JOIN seed s ON s.condition_norm = d.condition_norm""")
def a12_seed_dictionary(t):
    out = co.seed_condition_dictionary(t.b_condition_mention, stored_dictionary(t))[0]
    return out.withColumn("resolved", F.date_format("resolved_at", "yyyy-MM-dd")).drop("resolved_at")


@query(f"{SEED}, {STORED} SELECT count(*) AS inserted FROM seed WHERE condition_norm NOT IN (SELECT condition_norm FROM stored)")
def a12_inserted(t):
    return co.seed_condition_dictionary(t.b_condition_mention, stored_dictionary(t))[1]


@query("""SELECT trim(lower(concept)) AS concept_norm, min(concept) AS sample, count(*) AS frequency FROM b_eligibility WHERE concept_code IS NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100000""")
def a13_concepts_to_normalize(t):
    return co.concepts_to_normalize(t.b_eligibility, t.b_atom.limit(0).select(F.col("cui").alias("concept_norm")))


@query("""WITH l AS (SELECT * FROM latest WHERE i = 1), e AS (SELECT DISTINCT nct_id FROM b_eligibility)
    SELECT (SELECT count(*) FROM b_eligibility) AS criterion_rows, (SELECT avg(CASE WHEN concept_code IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM b_eligibility) AS resolution_rate,
        count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status NOT IN ('success', 'running', 'parse_empty', 'cancelled')) AS failures, count(*) FILTER (status = 'llm_failed') AS llm_failed,
        count(*) FILTER (status = 'parse_invalid_json') AS invalid_json, count(*) FILTER (status = 'persist_failed') AS persist_failed, count(*) FILTER (status = 'interrupted') AS interrupted, 0 AS other_failed,
        count(*) FILTER (status = 'parse_empty') AS parse_empty, count(*) AS attempted, (SELECT CAST(sum(llm_prompt_tokens) AS BIGINT) FROM b_study_attempt) AS prompt_tokens,
        (SELECT CAST(sum(llm_completion_tokens) AS BIGINT) FROM b_study_attempt) AS completion_tokens,
        (SELECT count(*) FROM b_study_detail WHERE nct_id IN (SELECT nct_id FROM e) AND nct_id NOT IN (SELECT nct_id FROM b_embedding)) AS embedding_backlog,
        (SELECT count(*) FROM b_source_trial) AS source_total,
        (SELECT count(*) FROM b_source_trial WHERE length(trim(criteria, ' ')) >= 50 AND criteria NOT ILIKE '%please contact%' AND criteria NOT ILIKE '%contact site for%' AND criteria NOT ILIKE '%contact study%') AS selectable_total,
        greatest(0, (SELECT count(*) FROM b_source_trial) - count(*)) AS remaining FROM l""")
def a14_dashboard(t):
    return co.dashboard_metrics(t.b_eligibility, t.b_study_attempt, t.b_source_trial, t.b_study_detail, t.b_embedding.withColumn("model", F.lit("m")), "m")


@query("""SELECT count(DISTINCT nct_id) AS studies, count(*) AS rows, count(concept_code) AS resolved, round(count(concept_code) / count(*), 3) AS resolution_rate FROM b_eligibility""")
def a15_run_metrics(t):
    return co.run_metrics(t.b_eligibility)


@query("SELECT phase AS model, count(*) AS vectors, (SELECT count(*) FROM b_embedding) AS total FROM b_embedding GROUP BY 1")
def a16_embedding_stats(t):
    return co.embedding_stats(t.b_embedding.withColumnRenamed("phase", "model"))


@query("""WITH c AS (SELECT cui, string_agg(DISTINCT tui, ',' ORDER BY tui) AS tuis, string_agg(DISTINCT sty, ', ' ORDER BY sty) AS s FROM b_type GROUP BY 1)
    SELECT id, coalesce(tuis, '') AS tuis, coalesce(s, semantic_type) AS semantic_type FROM b_eligibility e LEFT JOIN c ON c.cui = e.concept_code""")
def a17_backfill_types(t):
    e = t.b_eligibility.withColumn("semantic_type_tuis", F.array().cast("array<string>"))
    return co.backfill_semantic_types(e, t.b_type)[0].select("id", F.array_join("semantic_type_tuis", ",").alias("tuis"), "semantic_type")


@query("SELECT count(*) AS changed FROM b_eligibility WHERE concept_code IN (SELECT cui FROM b_type)")
def a17_backfill_count(t):
    e = t.b_eligibility.withColumn("semantic_type_tuis", F.array().cast("array<string>"))
    return co.backfill_semantic_types(e, t.b_type)[1]


@query("""SELECT (SELECT count(*) FROM b_eligibility WHERE concept_code IN (SELECT cui FROM b_type)) AS changed, (SELECT count(*) FROM b_eligibility WHERE concept_code IS NOT NULL AND concept_code NOT IN (SELECT cui FROM b_type)) AS unmappable""")
def a17_dry_run(t):
    """What a backfill would do, with the concepts that have a type as its terminology."""
    e = t.b_eligibility.withColumn("semantic_type_tuis", F.array().cast("array<string>"))
    return co.backfill_job(e, t.concepts.join(t.b_type.select("cui"), "cui", "left_semi"), t.b_type, dry_run=True)[1]


@query("""WITH RECURSIVE part_of AS (SELECT DISTINCT p_partkey AS c, p_partkey - 1 - CASE WHEN p_partkey % 8 > 1 THEN p_partkey % 2 ELSE 0 END AS p FROM part WHERE p_partkey % 8 > 0 UNION SELECT DISTINCT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 16 = 1),
    up AS (SELECT c, p, 1 AS d FROM part_of WHERE c <> p UNION SELECT up.c, x.p, d + 1 FROM up JOIN part_of x ON x.c = up.p WHERE d < 12)
    SELECT 'C' || CAST(c AS VARCHAR) AS descendant, 'C' || CAST(p AS VARCHAR) AS ancestor, min(d) AS min_distance FROM up WHERE c <> p GROUP BY c, p""")
def g1_closure_to_the_end(t):
    """Chains of up to eight parts with cycles, followed until no level finds anything new."""
    k, cui = F.col("p_partkey"), lambda c: F.concat(F.lit("C"), c.cast("string"))
    down = t.part.filter(k % 8 > 0).select(cui(k).alias("child_cui"), cui(k - 1 - F.when(k % 8 > 1, k % 2).otherwise(0)).alias("parent_cui"))
    back = t.part.filter(k % 16 == 1).select(cui(k).alias("child_cui"), cui(k + 2).alias("parent_cui"))
    return te.concept_closure(down.union(back), None)


@query("SELECT count(*) AS rows, count(DISTINCT descendant) AS descendants, max(min_distance) AS max_depth FROM closure")
def a18_hierarchy_stats(t):
    return te.hierarchy_stats(t.closure)


@query("SELECT (SELECT count(*) FROM concepts WHERE cui NOT IN (SELECT cui FROM b_type)) AS without_type, (SELECT count(*) FROM closure) >= 1000 AS hierarchy_ok")
def a18_load_completeness(t):
    return te.load_completeness(t.concepts, t.b_type, t.closure)


@query("""WITH a AS (SELECT str AS query, min(cui) AS cui FROM b_atom WHERE is_pref GROUP BY 1), b AS (SELECT str AS query, max(cui) AS cui FROM b_atom WHERE sab <> 'MDR' GROUP BY 1),
    j AS (SELECT q.query, CASE WHEN a.cui = b.cui THEN 'both' WHEN a.cui IS NOT NULL AND b.cui IS NOT NULL THEN 'different' WHEN a.cui IS NOT NULL THEN 'a_only' WHEN b.cui IS NOT NULL THEN 'b_only' ELSE 'neither' END AS bucket
        FROM (SELECT DISTINCT str AS query FROM b_atom) q LEFT JOIN a USING (query) LEFT JOIN b USING (query)),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY query) AS i FROM j)
    SELECT bucket, count(*) AS n, string_agg(query, '|' ORDER BY query) FILTER (i <= 15) AS examples FROM r GROUP BY 1""")
def a19_compare_resolvers(t):
    s = t.b_atom.select(F.col("str").alias("query"), "cui", "is_pref", "sab")
    a, b = s.filter("is_pref").groupBy("query").agg(F.min("cui").alias("cui")), s.filter("sab <> 'MDR'").groupBy("query").agg(F.max("cui").alias("cui"))
    return co.compare_resolvers(s, a, b).withColumn("examples", F.array_join("examples", "|"))


@query("""WITH r AS (SELECT *, CASE WHEN concept_code IS NOT NULL THEN concept_code || '/' || criterion ELSE CAST(id AS VARCHAR) END AS k FROM b_eligibility),
    d AS (SELECT nct_id, k, original_text, min(id) AS i FROM r GROUP BY ALL)
    SELECT r.nct_id, min(r.id) AS ord, min_by(r.concept, r.id) AS concept, any_value(g.t) AS original_text FROM r
    JOIN (SELECT nct_id, k, string_agg(original_text, ' ' ORDER BY i) AS t FROM d GROUP BY ALL) g USING (nct_id, k) GROUP BY r.nct_id, k""")
def a20_merge_duplicates(t):
    r = t.b_eligibility.select("nct_id", F.col("id").alias("ord"), "criterion", "concept", "concept_code", F.array().cast("array<string>").alias("semantic_type_tuis"), "original_text")
    return co.merge_duplicate_concepts(r).select("nct_id", "ord", "concept", "original_text")


@query("""SELECT concept FROM (SELECT DISTINCT concept FROM b_eligibility WHERE concept_code IS NULL AND concept <> '' ORDER BY concept LIMIT 20)
    UNION SELECT concept FROM (SELECT DISTINCT concept FROM b_eligibility WHERE concept_code IS NOT NULL AND concept <> '' ORDER BY concept LIMIT 30)""")
def g2_sample_concepts(t):
    return co.sample_concepts(t.b_eligibility, 20, 30)


@query("SELECT descendant, ancestor, CAST(min_distance AS INTEGER) AS min_distance FROM closure")
def g1_closure(t):
    return t.closure


# Windows, filters and lookups.


@query("SELECT attempt_id, run_id, nct_id, status FROM latest WHERE i = 1")
def w1_latest_attempt(t):
    return se.latest_attempt(t.b_study_attempt).select("attempt_id", "run_id", "nct_id", "status")


@query("SELECT attempt_id, nct_id FROM latest WHERE i > 1")
def w2_superseded(t):
    return se.superseded(t.b_study_attempt).select("attempt_id", "nct_id")


@query("""SELECT nct_id FROM b_source_trial WHERE length(trim(criteria, ' ')) >= 50 AND criteria NOT ILIKE '%please contact%' AND criteria NOT ILIKE '%contact site for%' AND criteria NOT ILIKE '%contact study%'""")
def f1_selectable_trials(t):
    return se.selectable_trials(t.b_source_trial).select("nct_id")


@query("""SELECT id, nct_id, concept FROM b_eligibility WHERE contains(lower(criterion), 'inclu') AND contains(lower(concept), 'a') AND domain = 'PROMO' ORDER BY concept, id LIMIT 50 OFFSET 50""")
def f2_search_criteria(t):
    return se.search_criteria(t.b_eligibility, criterion="INCLU", concept="a ", domain="PROMO", nct_id=" ", sort="concept", page=2)[0].select("id", "nct_id", "concept")


@query("""SELECT count(*) AS total FROM b_eligibility WHERE contains(lower(criterion), 'inclu') AND contains(lower(concept), 'a') AND domain = 'PROMO'""")
def f2_search_total(t):
    return se.search_criteria(t.b_eligibility, criterion="INCLU", concept="a", domain="PROMO")[1]


@query("""SELECT nct_id, brief_title FROM b_study_detail d WHERE contains(lower(brief_title), 'urgent') AND nct_id IN (SELECT nct_id FROM mentions WHERE contains(norm, 'b')) ORDER BY nct_id LIMIT 101""")
def f3_search_studies(t):
    names = t.b_condition_mention.groupBy("nct_id").agg(F.collect_list("cond").alias("conditions"))
    return se.search_studies(t.b_study_detail.join(names, "nct_id"), {"brief_title": "urgent", "conditions": "B", "source": ""}).select("nct_id", "brief_title")


@query("SELECT attempt_id, nct_id, status FROM latest WHERE i = 1 AND status = 'llm_failed' ORDER BY started_at DESC, nct_id DESC LIMIT 100")
def f4_list_attempts(t):
    return se.list_attempts(t.b_study_attempt, status="llm_failed", size=100).select("attempt_id", "nct_id", "status")


@query("SELECT attempt_id, status FROM b_study_attempt WHERE nct_id = (SELECT min(nct_id) FROM b_study_attempt)")
def f5_attempt_history(t):
    first = t.b_study_attempt.agg(F.min("nct_id")).first()[0]
    return se.attempt_history(t.b_study_attempt, first).select("attempt_id", "status")


AUDIT = "SELECT event_id AS audit_id, CAST(user_id AS STRING) AS user_name, event_type AS action, ts AS occurred_at FROM events"


@query(f"SELECT audit_id, user_name FROM ({AUDIT}) WHERE action = 'click' ORDER BY occurred_at DESC, audit_id DESC LIMIT 500")
def f6_search_audit(t):
    log = t.events.select(F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("user_name"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))
    return se.search_audit(log, action="click", limit=500).select("audit_id", "user_name")


@query(f"""WITH a AS ({AUDIT}), m AS (SELECT min(occurred_at) AS lo, max(occurred_at) AS hi FROM a) SELECT audit_id, user_name, action FROM a, m
    WHERE occurred_at >= lo + INTERVAL 36 HOUR AND occurred_at <= hi - INTERVAL 36 HOUR ORDER BY occurred_at DESC, audit_id DESC LIMIT 500 OFFSET 500""")
def f6_audit_range(t):
    """The second page of a time range that leaves out a day and a half at either end."""
    log = t.events.select(F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("user_name"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))
    ends = log.agg((F.min("occurred_at") + F.expr("INTERVAL 36 HOURS")).alias("lo"), (F.max("occurred_at") - F.expr("INTERVAL 36 HOURS")).alias("hi")).first()
    return se.search_audit(log, since=ends.lo, until=ends.hi, limit=500, page=2).select("audit_id", "user_name", "action")


@query("""SELECT DISTINCT 'criterion' AS column_name, criterion AS value FROM b_eligibility UNION SELECT DISTINCT 'domain', domain FROM b_eligibility
    UNION SELECT 'semantic_type', semantic_type FROM b_eligibility WHERE semantic_type IS NOT NULL""")
def f7_filter_options(t):
    return se.filter_options(t.b_eligibility, ["criterion", "domain", "semantic_type", "original_text"], 50)


@query()
def f8_distinct_estimates(t):
    return se.distinct_estimates(t.b_eligibility, ["criterion", "domain", "concept", "nct_id"])


def _kept_options(t) -> op.OptionTable:
    """Options of all criteria, with the first half of the buckets made again from the same rows."""
    kept = op.OptionTable(t.spark, ta.scratch(t.spark), ["criterion", "domain", "semantic_type", "original_text"], buckets=8, cap=50)
    kept.replace(1, t.b_eligibility)
    kept.replace(2, t.b_eligibility, [0, 1, 2, 3])
    return kept


@query("""SELECT DISTINCT 'criterion' AS column_name, criterion AS value FROM b_eligibility UNION SELECT DISTINCT 'domain', domain FROM b_eligibility
    UNION SELECT 'semantic_type', semantic_type FROM b_eligibility WHERE semantic_type IS NOT NULL""")
def f7_kept_options(t):
    return _kept_options(t).options()


@query("""SELECT column_name, n > 0 AS near FROM (SELECT 'criterion' AS column_name, count(DISTINCT criterion) AS n FROM b_eligibility UNION ALL SELECT 'domain', count(DISTINCT domain) FROM b_eligibility
    UNION ALL SELECT 'semantic_type', count(DISTINCT semantic_type) FROM b_eligibility UNION ALL SELECT 'original_text', count(DISTINCT original_text) FROM b_eligibility)""")
def f8_kept_estimates(t):
    """Estimates from merged sketches lie within 5 % of the exact numbers (three times the standard error)."""
    kept = _kept_options(t)
    exact = t.b_eligibility.agg(*(F.count_distinct(c).alias(c) for c in kept.columns))
    exact = exact.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in kept.columns))))
    return kept.estimates().join(exact.hint("merge"), "column_name").select("column_name", ((F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")) & (F.col("n") > 0)).alias("near"))


@query("""SELECT c.cui, pref_name, coalesce(p.trials, 0) AS trials FROM concepts c LEFT JOIN profile p ON p.concept_code = c.cui WHERE contains(lower(pref_name), 'e') ORDER BY 3 DESC, 2, 1 LIMIT 20""")
def f11_search_concepts(t):
    return se.search_concepts(t.concepts, co.corpus_profile(t.b_eligibility), " E ")


@query("SELECT DISTINCT concept_code, pref_name FROM pairs JOIN concepts ON cui = concept_code")
def f12_pref_names(t):
    return se.pref_names(se.resolved(t.b_eligibility), t.concepts)


RUNNING = "SELECT *, CASE WHEN attempt_id % 3 = 0 THEN 'running' ELSE status END AS s FROM b_study_attempt"


def running(t: Tables) -> DataFrame:
    return t.b_study_attempt.withColumn("status", F.when(F.col("attempt_id") % 3 == 0, "running").otherwise(F.col("status")))


@query(f"""SELECT attempt_id, CASE WHEN s = 'running' AND started_at < (SELECT max(started_at) FROM events_max) - INTERVAL 86400 SECOND THEN 'interrupted' ELSE s END AS status
    FROM ({RUNNING})""".replace("(SELECT max(started_at) FROM events_max)", "(SELECT max(ts) FROM events)"))
def f13_stale_attempts(t):
    now = t.events.agg(F.max("ts")).first()[0]
    return se.stale_to_interrupted(running(t), now, 86400).select("attempt_id", "status")


@query(f"""WITH r AS (SELECT min(run_id) AS run FROM b_study_attempt) SELECT attempt_id, CASE WHEN s = 'running' AND run_id = (SELECT run FROM r) THEN 'interrupted' ELSE s END AS status FROM ({RUNNING})""")
def f14_resolve_run(t):
    a = running(t)
    first = a.agg(F.min("run_id")).first()[0]
    runs = a.select("run_id").distinct().withColumn("status", F.lit("running"))
    return se.resolve_run(runs, a, first, "failed")[1].select("attempt_id", "status")


@query(f"""WITH r AS (SELECT min(run_id) AS run FROM b_study_attempt) SELECT run_id, CASE WHEN run_id = run THEN 'failed' ELSE 'running' END AS status, CASE WHEN run_id = run THEN 'by hand' END AS reason, true AS changed,
    (SELECT count(*) FROM ({RUNNING}) WHERE s = 'running' AND run_id = (SELECT run FROM r)) AS attempts_interrupted FROM (SELECT DISTINCT run_id FROM b_study_attempt), r""")
def f14_resolved_runs(t):
    """The runs after one is ended by hand, with what that changed."""
    a = running(t)
    first = a.agg(F.min("run_id")).first()[0]
    runs = a.select("run_id").distinct().withColumn("status", F.lit("running")).withColumn("reason", F.lit(None).cast("string"))
    new, _, told = se.resolve_run(runs, a, first, "failed", "by hand")
    return new.crossJoin(F.broadcast(told))  # one row


@query("SELECT attempt_id FROM b_study_attempt WHERE NOT (run_id = (SELECT min(run_id) FROM b_study_attempt) AND nct_id = (SELECT min(nct_id) FROM b_study_attempt))")
def f15_delete_attempt(t):
    a = t.b_study_attempt
    r = a.agg(F.min("run_id"), F.min("nct_id")).first()
    return se.delete_attempt(a, r[0], r[1]).select("attempt_id")


# Joins.


@query("""SELECT nct_id FROM b_source_trial WHERE length(trim(criteria, ' ')) >= 50 AND criteria NOT ILIKE '%please contact%' AND criteria NOT ILIKE '%contact site for%' AND criteria NOT ILIKE '%contact study%'
    AND nct_id NOT IN (SELECT nct_id FROM b_attempted) ORDER BY nct_id DESC LIMIT 200""")
def j1_select_next(t):
    return jo.select_next_trials(t.b_source_trial, t.b_attempted, "Recent", 200).select("nct_id")


@query("SELECT DISTINCT nct_id FROM b_study_attempt")
def j2_attempted_ids(t):
    return jo.attempted_ids(t.b_study_attempt)


@query(r"""SELECT nct_id, regexp_replace(regexp_replace(criteria, '([*\[\]#>_.!-])', '\\\1', 'g'), '\\([][\\`*_{}()#+.!<>|~-])', '\1', 'g') AS criteria FROM b_source_trial WHERE nct_id IN (SELECT nct_id FROM b_attempted)""")
def j3_source_trials(t):
    ids = t.b_attempted.select(F.concat(F.lit(" "), "nct_id", F.lit("\t")).alias("nct_id")).union(t.b_attempted.select(F.lit(" ")))
    escaped = t.b_source_trial.withColumn("criteria", F.regexp_replace("criteria", r"([*\[\]#>_.!-])", r"\\$1"))
    return jo.source_trials(escaped, ids).select("nct_id", "criteria")


@query("""SELECT coalesce(d.nct_id, e.nct_id) AS nct_id, brief_title, coalesce(c.x, '') AS conditions, coalesce(v.x, '') AS interventions FROM b_study_detail d
    FULL JOIN (SELECT DISTINCT nct_id FROM b_eligibility) e ON e.nct_id = d.nct_id LEFT JOIN (SELECT nct_id, string_agg(raw, '|' ORDER BY raw) AS x FROM mentions GROUP BY 1) c ON c.nct_id = coalesce(d.nct_id, e.nct_id)
    LEFT JOIN (SELECT nct_id, string_agg(domain || ':' || concept, '|' ORDER BY domain, concept) AS x FROM b_eligibility WHERE criterion = 'Inclusion' GROUP BY 1) v ON v.nct_id = coalesce(d.nct_id, e.nct_id)""")
def j4_study_snapshot(t):
    studies, e = t.b_study_detail.select("nct_id", "brief_title"), t.b_eligibility
    things = e.filter("criterion = 'Inclusion'").select("nct_id", F.col("domain").alias("intervention_type"), F.col("concept").alias("name"))
    names = t.b_condition_mention.select("nct_id", F.trim("cond").alias("name"))
    s = jo.study_snapshot(studies, studies.select("nct_id", F.col("brief_title").alias("description")), names, things, e.select("nct_id").distinct())
    shown = F.array_join(F.transform("interventions", lambda x: F.concat(x["type"], F.lit(":"), x["name"])), "|")
    return s.select("nct_id", "brief_title", F.array_join("conditions", "|").alias("conditions"), shown.alias("interventions"))


@query("""SELECT DISTINCT m.norm, a.cui, c.pref_name, a.cui IN (SELECT descendant FROM closure) AS has_hierarchy FROM mentions m JOIN atoms a ON a.str_norm = m.norm JOIN concepts c ON c.cui = a.cui""")
def j5_exact_candidates(t):
    norms = t.b_condition_mention.select(tx.normalize_key(F.col("cond")).alias("norm"))
    return jo.exact_candidates(norms, t.atoms, t.concepts, t.closure)


@query("SELECT norm AS condition_norm, min(raw) AS raw_form FROM mentions WHERE norm NOT IN (SELECT str_norm FROM atoms) GROUP BY 1")
def j6_unseen_conditions(t):
    return jo.unseen_conditions(t.b_condition_mention, t.atoms.select(F.col("str_norm").alias("condition_norm")))


@query("""SELECT DISTINCT nct_id FROM b_eligibility WHERE concept_code IS NULL AND nct_id NOT IN (SELECT nct_id FROM b_attempted) ORDER BY nct_id LIMIT 500""")
def j7_trials_to_retry(t):
    return jo.trials_to_retry(t.b_eligibility, t.b_attempted, n=500)


@query("SELECT DISTINCT concept, a.code, a.name, 0.9 AS score FROM b_eligibility e JOIN (SELECT str_norm, min(cui) AS code, min(str) AS name FROM atoms GROUP BY 1) a ON a.str_norm = trim(lower(e.concept)) WHERE e.concept_code IS NULL")
def j8_cached_resolutions(t):
    cache = t.atoms.groupBy(F.col("str_norm").alias("concept_norm")).agg(F.min("cui").alias("code"), F.min("str").alias("name")).withColumn("score", F.lit(0.9)).withColumn("resolved", F.lit(True))
    return jo.cached_resolutions(jo.unresolved_rows(t.b_eligibility), cache)


@query("SELECT nct_id FROM b_study_detail WHERE nct_id IN (SELECT nct_id FROM b_eligibility) AND nct_id NOT IN (SELECT nct_id FROM b_embedding)")
def j9_studies_to_embed(t):
    return jo.studies_to_embed(t.b_study_detail, t.b_eligibility, t.b_embedding.withColumn("model", F.lit("m")), "m").select("nct_id")


@query("SELECT id FROM b_eligibility WHERE concept_code IS NOT NULL AND concept_code NOT IN (SELECT cui FROM b_type)")
def j10_unmappable_rows(t):
    return jo.unmappable_rows(t.b_eligibility, t.b_type).select("id")


@query("""SELECT run_id, CAST(coalesce(sum(llm_prompt_tokens) FILTER (status = 'success'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(llm_completion_tokens) FILTER (status = 'success'), 0) AS BIGINT) AS completion_tokens,
    count(*) FILTER (status = 'success') AS successes FROM b_study_attempt GROUP BY 1 ORDER BY min(started_at) DESC, 1 DESC LIMIT 200""")
def j11_runs_with_totals(t):
    runs = t.b_study_attempt.groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    return jo.runs_with_totals(runs, t.b_study_attempt, size=200).drop("started_at")


@query("""SELECT run_id, avg(llm_prompt_tokens * 3) FILTER (status = 'success') AS avg_llm_ms, avg(llm_completion_tokens + 7) FILTER (status = 'success') AS avg_umls_ms, avg(attempt_id % 11) FILTER (status = 'success' AND attempt_id % 11 > 0) AS avg_persist_ms
    FROM b_study_attempt GROUP BY 1 ORDER BY min(started_at) DESC, 1 DESC LIMIT 500""")
def j11_run_phase_means(t):
    a = t.b_study_attempt.withColumn("llm_ms", F.col("llm_prompt_tokens") * 3).withColumn("umls_ms", F.col("llm_completion_tokens") + 7).withColumn("persist_ms", F.nullif(F.col("attempt_id") % 11, F.lit(0)))
    runs = a.groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    return jo.runs_with_totals(runs, a, size=500).select("run_id", "avg_llm_ms", "avg_umls_ms", "avg_persist_ms")


COSINE = """WITH q AS (SELECT * FROM b_embedding WHERE {where}), s AS (SELECT q.nct_id AS query_id, e.nct_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 4) AS similarity
    FROM q JOIN b_embedding e ON {on}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, nct_id) AS rank FROM s)
    SELECT query_id, nct_id, similarity, CAST(rank AS INTEGER) AS rank{more} FROM r WHERE rank <= 10"""


@query(COSINE.format(where="CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0", on="true", more=""))
def j12_similar_to_vectors(t):
    return jo.similar_to_vectors(t.b_embedding, t.b_embedding.filter("CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0").withColumnRenamed("nct_id", "query_id"))


@query(COSINE.format(where="CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0", on="q.nct_id <> e.nct_id AND q.phase = e.phase", more=", true AS has_vector"))
def j13_similar_to_trials(t):
    return jo.similar_to_trials(t.b_embedding, t.b_embedding.filter("CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0").select("nct_id"), match=["phase"])


@query(COSINE.format(where="CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0", on="q.phase = e.phase", more=""))
def j12_index_all_cells(t):
    """An index that looks into every cell gives the rows of the exact search: each row lies in a cell."""
    index = ve.VectorIndex.build(t.b_embedding, ta.scratch(t.spark), ["phase"], probing=20)
    queries = t.b_embedding.filter("CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0").withColumnRenamed("nct_id", "query_id")
    return index.search(queries, match=["phase"], probes=len(index.centres))


@query("SELECT count(*) AS queries, count(*) > 0 AS enough FROM b_embedding WHERE CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0")
def j13_index_recall(t):
    """The index as built against the exact search: at least 0.9 of the ten nearest of every 50th trial."""
    index = ve.VectorIndex.build(t.b_embedding, ta.scratch(t.spark))
    keys = t.b_embedding.filter("CAST(substr(nct_id, 4) AS BIGINT) % 50 = 0").select("nct_id")
    exact = jo.similar_to_trials(t.b_embedding, keys)
    found = jo.similar_to_trials(t.b_embedding, keys, index=index).withColumn("hit", F.lit(1))
    both = exact.join(found.select("query_id", "nct_id", "hit").hint("merge"), ["query_id", "nct_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("""SELECT c_custkey AS study_id, count(o_orderkey) AS criterion_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j14_authored_listing(t):
    studies = t.customer.select(F.col("c_custkey").alias("study_id"), F.lit("2024-01-01").alias("updated_at"))
    return jo.authored_listing(studies, t.orders.select(F.col("o_custkey").alias("study_id"))).select("study_id", "criterion_count")


@query("""WITH a AS (SELECT cui, string_agg(tui || ':' || sty, '|' ORDER BY sty, tui) AS x FROM b_type GROUP BY 1) SELECT DISTINCT p.concept_code, coalesce(x, '') AS assignments FROM pairs p LEFT JOIN a ON a.cui = p.concept_code""")
def j15_semantic_types_of(t):
    s = jo.semantic_types_of(se.resolved(t.b_eligibility), t.b_type)
    return s.withColumn("assignments", F.array_join(F.transform("assignments", lambda a: F.concat(a["tui"], F.lit(":"), a["sty"])), "|"))
