"""Registered queries on whole runs over a store: every table that a run leaves, checked against the rows that were damaged for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts as co
from ..operators.pairs import PairTable
from ..sources import tables as ta
from ..sources.store import Store
from ..streaming import batches as st
from . import batch as ba
from .bindings import VIEWS, Tables
from .queries import CODE, LIFT, query
from .queries_text import CONDITIONS, CRITERIA, elements, nested, sent

NOW = "2024-01-01 00:00:00"
#: Trials whose criteria are too short to be selected, and trials that an earlier run attempted.
SHORT, EARLIER = 13, 17
NUMBER = "CAST(substr(nct_id, 4, 8) AS INTEGER)"


def source(trials: DataFrame) -> DataFrame:
    k = F.expr(NUMBER)
    text = F.when(k % SHORT == 0, "too short").otherwise(F.concat(F.lit("Adults of at least eighteen years who have given their consent to "), "nct_id"))
    return trials.select("nct_id").withColumn("criteria", text)


def inputs(t: Tables, trials: DataFrame) -> ba.Inputs:
    """Tables of a run: responses are the criteria, damaged in turn; some are missing, empty or no answer. trials: nested, written."""
    studies, raw = ta.materialized(t.b_study_detail), ta.materialized(sent(trials))  # tables, as a run finds them: views would be made anew at each use
    things = elements(trials, criterion="criterion", intervention_type="domain", name="concept").filter("criterion = 'Inclusion'").drop("criterion")
    names = elements(trials, cond="cond").select("nct_id", F.trim("cond").alias("name"))
    return ba.Inputs(source(trials), studies, studies.select("nct_id", F.col("brief_title").alias("description")), names, things, raw, ta.materialized(t.atoms), ta.materialized(t.concepts), ta.materialized(t.b_type), ta.materialized(t.closure))


def opened(t: Tables, trials: DataFrame, root: str, buckets: int = 16) -> Store:
    """A store as an earlier run left it: attempts, and old rows of all trials."""
    store = Store(t.spark, root, ba.TABLES, buckets)
    done = source(trials).filter(F.expr(NUMBER) % EARLIER == 0).select("nct_id", F.lit("run-0").alias("run_id"), F.lit("success").alias("status"), F.lit("2023-01-01 00:00:00").alias("started_at"))
    old = elements(trials, criterion="criterion").filter("criterion = 'Exclusion'").select("nct_id", F.lit("old").alias("concept"), "criterion", F.lit(0).alias("ord"))
    store.commit(1, {"attempts": store.upsert("attempts", ba.conformed(store, "attempts", done)), "criteria": store.replace("criteria", ba.conformed(store, "criteria", old))})
    return store


#: The store of each session and input, so that the queries below look at one run.
_RUNS: dict[tuple[str, str], Store] = {}


def finished(t: Tables) -> Store:
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _RUNS:
        trials = ta.materialized(nested(t))
        store = opened(t, trials, ta.scratch(t.spark))
        ba.run(store, inputs(t, trials), "run-1", NOW, n=None)
        _RUNS[key] = store
    return _RUNS[key]


SELECTED = f"sel AS (SELECT DISTINCT nct_id, {NUMBER} % 50 AS k FROM b_eligibility WHERE {NUMBER} % {SHORT} <> 0 AND {NUMBER} % {EARLIER} <> 0)"
MERGED = f"""{CRITERIA}, {SELECTED},
    rw AS (SELECT nct_id, criterion, domain, concept, original_text, row_number() OVER (PARTITION BY nct_id ORDER BY id) - 1 AS ord, cui, name, score, root_source, sty_text, list_aggregate(tuis, 'string_agg', '|') AS tuis
        FROM b_eligibility JOIN sel USING (nct_id) LEFT JOIN best ON query = concept LEFT JOIN canon USING (cui) WHERE k NOT IN (10, 20, 30)),
    kd AS (SELECT *, CASE WHEN cui IS NOT NULL THEN cui || '/' || coalesce(tuis, '') || '/' || criterion ELSE '#' || CAST(ord AS VARCHAR) END AS kk FROM rw),
    tx AS (SELECT nct_id, kk, string_agg(original_text, ' ' ORDER BY o) AS original_text FROM (SELECT nct_id, kk, original_text, min(ord) AS o FROM kd GROUP BY ALL) GROUP BY ALL),
    mg AS (SELECT kd.nct_id, ord, criterion, domain, concept, tx.original_text, cui AS concept_code, name AS umls_name, score AS match_score, root_source AS match_source, sty_text AS semantic_type, tuis
        FROM kd JOIN tx ON tx.nct_id = kd.nct_id AND tx.kk = kd.kk WHERE (kd.nct_id, kd.kk, ord) IN (SELECT nct_id, kk, min(ord) FROM kd GROUP BY ALL))"""


RUN_CRITERIA = f"""{MERGED} SELECT nct_id, CAST(ord AS INTEGER) AS ord, criterion, domain, concept, original_text, concept_code, umls_name, match_score, match_source, semantic_type, tuis FROM mg
    UNION ALL SELECT nct_id, 0, 'Exclusion', NULL, 'old', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM b_eligibility WHERE criterion = 'Exclusion' AND nct_id NOT IN (SELECT nct_id FROM sel WHERE k <> 10)"""


def shown(criteria: DataFrame) -> DataFrame:
    return criteria.withColumn("tuis", F.array_join("semantic_type_tuis", "|")).drop("semantic_type_tuis", "qualifier", "time_window")


@query(RUN_CRITERIA)
def p1_run_criteria(t):
    """New rows of trials with an answer, none where it held nothing, old ones elsewhere."""
    return shown(finished(t).read("criteria"))


@query(f"""WITH {SELECTED} SELECT 'run-1' AS run_id, nct_id, CASE k WHEN 10 THEN 'llm_failed' WHEN 20 THEN 'parse_empty' WHEN 30 THEN 'parse_invalid_json' ELSE 'success' END AS status,
        CASE WHEN k IN (10, 20, 30) THEN 0 ELSE CAST((SELECT count(*) FROM b_eligibility e WHERE e.nct_id = sel.nct_id) AS INTEGER) END AS criterion_count, '2024-01-01' AS started, '2024-01-01' AS finished FROM sel
    UNION ALL SELECT DISTINCT 'run-0', nct_id, 'success', NULL, '2023-01-01', NULL FROM b_eligibility WHERE {NUMBER} % {EARLIER} = 0""")
def p1_run_attempts(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return finished(t).read("attempts").select("run_id", "nct_id", "status", "criterion_count", day("started_at").alias("started"), day("finished_at").alias("finished"))


@query(f"WITH {SELECTED} SELECT nct_id, 1 AS attempt_count, 'no response' AS last_error FROM sel WHERE k = 10")
def p1_run_failures(t):
    return finished(t).read("failures")


@query(f"""{CONDITIONS.replace("(SELECT norm, min(raw) AS raw_form FROM mentions GROUP BY 1)", f"(SELECT norm, min(raw) AS raw_form FROM mentions WHERE {NUMBER} % {SHORT} <> 0 AND {NUMBER} % {EARLIER} <> 0 GROUP BY 1)")}
    SELECT condition_norm, raw_form, CAST(0 AS BIGINT) AS study_count, code, match_tier, match_score FROM known""")
def p1_run_dictionary(t):
    return finished(t).read("dictionary").drop("resolved_at")


@query(f"""WITH {SELECTED} SELECT s.nct_id, brief_title, phase, brief_title AS brief_summary, coalesce(c.x, '') AS conditions, coalesce(v.x, '') AS interventions FROM sel s LEFT JOIN b_study_detail d USING (nct_id)
    LEFT JOIN (SELECT nct_id, string_agg(raw, '|' ORDER BY raw) AS x FROM mentions GROUP BY 1) c ON c.nct_id = s.nct_id
    LEFT JOIN (SELECT nct_id, string_agg(domain || ':' || concept, '|' ORDER BY domain, concept) AS x FROM b_eligibility WHERE criterion = 'Inclusion' GROUP BY 1) v ON v.nct_id = s.nct_id""")
def p1_run_snapshots(t):
    shown = F.array_join(F.transform("interventions", lambda x: F.concat(x["type"], F.lit(":"), x["name"])), "|")
    return finished(t).read("detail").select("nct_id", "brief_title", "phase", "brief_summary", F.array_join("conditions", "|").alias("conditions"), shown.alias("interventions"))


@query(f"""{MERGED} SELECT 'run-1' AS run_id, 'completed' AS status, (SELECT count(*) FROM sel WHERE k <> 10) AS studies, count(*) AS rows, count(concept_code) AS resolved, round(count(concept_code) / count(*), 3) AS resolution_rate FROM mg""")
def p1_run_totals(t):
    return finished(t).read("runs").drop("started_at", "finished_at")


@query(RUN_CRITERIA)
def p2_stream_runs(t):
    """The trials as a stream of three micro-batches, each a run; its tables end as those of one run over all."""
    root = ta.scratch(t.spark)
    trials = ta.materialized(nested(t))
    store = opened(t, trials, f"{root}/store")
    source(trials).repartition(3).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema("nct_id string, criteria string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    st.stream_pipeline(stream, store, inputs(t, trials), f"{root}/checkpoint", NOW).awaitTermination()
    return shown(store.read("criteria"))


@query("""WITH e AS (SELECT nct_id, count(*) AS n, count(concept_code) AS k FROM b_eligibility GROUP BY 1)
    SELECT run_id, count(DISTINCT nct_id) AS done, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(k), 0) AS BIGINT) AS resolved FROM (SELECT DISTINCT run_id, nct_id FROM b_study_attempt) LEFT JOIN e USING (nct_id) GROUP BY 1""")
def p3_keyed_progress(t):
    """Attempts as a stream that brings each of them twice; every one counts once."""
    root = ta.scratch(t.spark)
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    attempts = t.spark.sql(VIEWS["b_study_attempt"].replace("FROM events", "FROM {events}"), events=events).select("run_id", "nct_id", F.lit("success").alias("status"), F.col("started_at").alias("updated_at"))
    rows = st.progress_rows(t.b_eligibility, attempts.unionByName(attempts))
    store = Store(t.spark, f"{root}/store", st.PROGRESS, 4)
    st.stream_progress(rows, store, f"{root}/checkpoint", horizon="36500 days").awaitTermination()
    return store.read("progress").select("run_id", "done", "rows", "resolved")


@query(f"WITH members AS (SELECT DISTINCT nct_id FROM pairs WHERE concept_code = '{CODE}'), defining AS (SELECT '{CODE}' AS code) {LIFT}")
def a5_lift_kept_pairs(t):
    """The lift of a concept over kept pairs: all trials first with rows of other concepts for a third, which then are replaced."""
    e, third = ta.materialized(t.b_eligibility.select("nct_id", "concept_code")), F.expr(NUMBER) % 3 == 0
    kept = PairTable(t.spark, ta.scratch(t.spark), 8)
    wrong = F.when(third, F.concat(F.lit("X"), "concept_code")).otherwise(F.col("concept_code"))
    kept.replace(1, e, e.select("nct_id", wrong.alias("concept_code")))
    kept.replace(2, e.filter(third), e)
    return co.lift_table(kept.profile(kept.members(CODE)), kept.counts(), kept.size(), t.concepts, co.defining_codes("Concept", CODE, None, t.spark))
