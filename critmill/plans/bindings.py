"""Views that give the driver's tables the shapes of the operators; one SQL text for Spark and for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_key

VIEWS = {
    "b_eligibility": """
        SELECT l.l_orderkey * 100 + row_number() OVER (PARTITION BY l.l_orderkey
                 ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS id,
               concat('NCT', lpad(CAST(l.l_orderkey AS STRING), 8, '0')) AS nct_id,
               CASE WHEN l.l_linestatus = 'O' THEN 'Inclusion' ELSE 'Exclusion' END AS criterion,
               p.p_type AS domain, p.p_name AS concept,
               CASE WHEN p.p_partkey % 10 = 0 THEN NULL
                    ELSE concat('C', lpad(CAST(p.p_partkey % 200 AS STRING), 7, '0')) END AS concept_code,
               CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE concat('STY ', CAST(p.p_partkey % 7 AS STRING)) END AS semantic_type,
               concat(p.p_name, ' ', l.l_returnflag) AS original_text, l.l_shipdate AS created_at
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "b_study_detail": """
        SELECT concat('NCT', lpad(CAST(o.o_orderkey AS STRING), 8, '0')) AS nct_id,
               concat(c.c_name, ' ', o.o_orderpriority) AS brief_title, o.o_orderstatus AS overall_status,
               CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE o.o_orderpriority END AS phase, c.c_mktsegment AS study_type,
               CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS start_date, c.c_name AS source
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "b_condition_mention": """
        SELECT concat('NCT', lpad(CAST(l.l_orderkey AS STRING), 8, '0')) AS nct_id,
               CASE WHEN l.l_linenumber % 3 = 0 THEN upper(p.p_name)
                    WHEN l.l_linenumber % 3 = 1 THEN concat('  ', p.p_name, ' ') ELSE p.p_name END AS cond
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "b_edge": """
        SELECT DISTINCT concat('C', lpad(CAST(p_partkey % 200 AS STRING), 7, '0')) AS child_cui,
               concat('C', lpad(CAST(1000 + p_partkey % 40 AS STRING), 7, '0')) AS parent_cui FROM part
        UNION
        SELECT DISTINCT concat('C', lpad(CAST(p_partkey % 200 AS STRING), 7, '0')),
               concat('C', lpad(CAST(1000 + (p_partkey % 200) * 7 % 40 AS STRING), 7, '0')) FROM part
        UNION
        SELECT DISTINCT concat('C', lpad(CAST(1000 + p_partkey % 40 AS STRING), 7, '0')),
               concat('C', lpad(CAST(2000 + p_partkey % 8 AS STRING), 7, '0')) FROM part""",
    "b_atom": """
        SELECT concat('C', lpad(CAST(p_partkey % 200 AS STRING), 7, '0')) AS cui,
               CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE concat(p_name, ' ', lower(p_type)) END AS str,
               CASE p_type WHEN 'ECONOMY' THEN 'SNOMEDCT_US' WHEN 'LARGE' THEN 'MSH' WHEN 'MEDIUM' THEN 'RXNORM'
                           WHEN 'PROMO' THEN 'LNC' WHEN 'SMALL' THEN 'ICD10CM' ELSE 'MDR' END AS sab,
               p_size < 10 AS is_pref
        FROM part""",
    "b_study_attempt": """
        SELECT event_id AS attempt_id, concat('run-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
               concat('NCT', lpad(CAST(user_id AS STRING), 8, '0')) AS nct_id, ts AS started_at,
               CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'parse_empty'
                               WHEN 'error' THEN 'llm_failed' WHEN 'purchase' THEN 'persist_failed' ELSE 'interrupted' END AS status,
               CAST(floor(value * 10) AS BIGINT) AS llm_prompt_tokens, CAST(floor(value) AS BIGINT) AS llm_completion_tokens
        FROM events""",
    "b_source_trial": "SELECT concat('NCT', lpad(CAST(doc_id AS STRING), 8, '0')) AS nct_id, text AS criteria FROM documents",
    "b_attempted": "SELECT DISTINCT concat('NCT', lpad(CAST(doc_id AS STRING), 8, '0')) AS nct_id FROM labels WHERE quality = 1",
    "b_embedding": """
        SELECT concat('NCT', lpad(CAST(vec_id AS STRING), 8, '0')) AS nct_id, embedding, concat('PHASE', CAST(label % 4 AS STRING)) AS phase
        FROM embeddings""",
    "b_type": """
        SELECT DISTINCT concat('C', lpad(CAST(p_partkey % 200 AS STRING), 7, '0')) AS cui,
               concat('T', lpad(CAST(p_partkey % 7 AS STRING), 3, '0')) AS tui, concat('STY ', CAST(p_partkey % 7 AS STRING)) AS sty
        FROM part WHERE p_partkey % 10 <> 3""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """The driver's tables and the views over them, by name; atoms carry str_norm, concepts their preferred name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        text = VIEWS[name]
        used = [t for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text]
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})

    @property
    def atoms(self) -> DataFrame:
        return self.b_atom.withColumn("str_norm", normalize_key(F.col("str"))).withColumn("tty", F.lit("PT"))

    @property
    def concepts(self) -> DataFrame:
        from ..sources.terminology import build_concepts

        return build_concepts(self.b_atom)

    @property
    def closure(self) -> DataFrame:
        from ..sources.terminology import concept_closure

        return concept_closure(self.b_edge)


#: The same derived tables as SQL.
DERIVED = {
    "atoms": "SELECT cui, str, sab, is_pref, trim(regexp_replace(lower(str), '\\s+', ' ', 'g')) AS str_norm FROM b_atom",
    "concepts": """
        SELECT cui, str AS pref_name, sab AS root_source FROM (
            SELECT *, row_number() OVER (PARTITION BY cui ORDER BY is_pref DESC,
                CASE sab WHEN 'SNOMEDCT_US' THEN 1 WHEN 'MSH' THEN 2 WHEN 'RXNORM' THEN 3 WHEN 'LNC' THEN 4 WHEN 'ICD10CM' THEN 5 WHEN 'MDR' THEN 6 ELSE 9 END,
                length(str), str, sab) AS i FROM b_atom) WHERE i = 1""",
    "closure": """
        SELECT descendant, ancestor, min(d) AS min_distance FROM (
            SELECT child_cui AS descendant, parent_cui AS ancestor, 1 AS d FROM b_edge
            UNION ALL SELECT a.child_cui, b.parent_cui, 2 FROM b_edge a JOIN b_edge b ON a.parent_cui = b.child_cui)
        WHERE descendant <> ancestor GROUP BY ALL""",
    "pairs": "SELECT DISTINCT nct_id, concept_code FROM b_eligibility WHERE concept_code IS NOT NULL AND concept_code <> ''",
    "profile": "SELECT concept_code, count(*) AS trials FROM pairs GROUP BY 1",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY started_at DESC, attempt_id DESC) AS i FROM b_study_attempt)",
    "mentions": "SELECT nct_id, trim(cond) AS raw, trim(regexp_replace(lower(cond), '\\s+', ' ', 'g')) AS norm FROM b_condition_mention",
}
ALL = VIEWS | DERIVED


def with_views(sql: str) -> str:
    """The statement with a WITH clause of every view that it names, directly or not."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in ALL:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(ALL[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    order = [n for n in ALL if n in need]
    clause = ",\n".join(f"{n} AS ({ALL[n]})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {clause},\n{sql[5:]}" if clause else sql
    return f"WITH {clause}\n{sql}" if clause else sql
