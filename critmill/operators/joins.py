"""Joins: selection of trials, snapshots, candidates, retries, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key, trimmed, unescape_markdown, unresolved
from .search import selectable_trials
from .vectors import VectorIndex, comparable, exact_search


def attempted_ids(attempts: DataFrame) -> DataFrame:
    return attempts.select("nct_id").distinct()


def next_ids(src: DataFrame, attempted: DataFrame, direction: str = "Forward", n: int | None = 100, most: int = 1000) -> DataFrame:
    """nct_id of the first n selectable trials that weren't attempted, or of all where n is None."""
    ids = selectable_trials(src).select("nct_id").filter("nct_id IS NOT NULL").join(attempted.select("nct_id"), "nct_id", "left_anti")
    if n is None:
        return ids
    return ids.orderBy((F.asc if direction == "Forward" else F.desc)("nct_id")).limit(max(1, min(n, most)))


def select_next_trials(src: DataFrame, attempted: DataFrame, direction: str = "Forward", n: int | None = 100, most: int = 1000) -> DataFrame:
    """The first n selectable trials that weren't attempted, or all where n is None. Ids are chosen first; only theirs is the wide text joined back."""
    ids = next_ids(src, attempted, direction, n, most)
    ids = ids if n is None else F.broadcast(ids)  # at most `most` rows
    return src.join(ids, "nct_id", "left_semi").withColumn("criteria", unescape_markdown(F.col("criteria")))


def source_trials(src: DataFrame, ids: DataFrame) -> DataFrame:
    """Named trials for another run: ids are trimmed, blanks skipped, unknown ones dropped; no selection rule applies."""
    wanted = ids.select(trimmed(F.col("nct_id")).alias("nct_id")).filter("nct_id <> ''").distinct()
    return src.join(wanted, "nct_id", "left_semi").withColumn("criteria", unescape_markdown(F.col("criteria")))


def study_snapshot(studies: DataFrame, summaries: DataFrame, conditions: DataFrame, interventions: DataFrame, eligibilities: DataFrame, only: bool = False) -> DataFrame:
    """One nested row a trial that stands in studies or eligibilities (with `only`, in eligibilities): conditions by name, interventions by (type, name)."""
    names = conditions.groupBy("nct_id").agg(F.sort_array(F.collect_list("name")).alias("conditions"))
    things = interventions.groupBy("nct_id").agg(F.sort_array(F.collect_list(F.struct(F.col("intervention_type").alias("type"), "name"))).alias("interventions"))
    t = studies.join(eligibilities, "nct_id", "right" if only else "full_outer").join(summaries.withColumnRenamed("description", "brief_summary"), "nct_id", "left")
    t = t.join(names.hint("merge"), "nct_id", "left").join(things.hint("merge"), "nct_id", "left")  # lists, whose size Spark can't tell
    return t.withColumn("conditions", F.coalesce("conditions", F.array().cast("array<string>"))).withColumn("interventions", F.coalesce("interventions", F.array().cast("array<struct<type:string,name:string>>")))


def exact_candidates(norms: DataFrame, atoms: DataFrame, concepts: DataFrame, closure: DataFrame) -> DataFrame:
    """norm, cui, pref_name, has_hierarchy: distinct concepts with an atom of that normalized text."""
    hits = norms.select("norm").distinct().join(atoms.select(F.col("str_norm").alias("norm"), "cui").distinct(), "norm")
    below = closure.select(F.col("descendant").alias("cui")).distinct().withColumn("h", F.lit(True))
    return hits.join(concepts.select("cui", "pref_name"), "cui").join(below, "cui", "left").select("norm", "cui", "pref_name", F.coalesce("h", F.lit(False)).alias("has_hierarchy"))


def unseen_conditions(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """condition_norm and raw_form (the smallest) of mentioned conditions that the dictionary lacks. mentions: nct_id, cond."""
    t = mentions.select(normalize_key(F.col("cond")).alias("condition_norm"), trimmed(F.col("cond")).alias("raw")).filter("condition_norm <> ''")
    return t.join(dictionary.select("condition_norm"), "condition_norm", "left_anti").groupBy("condition_norm").agg(F.min("raw").alias("raw_form"))


def unresolved_rows(criteria: DataFrame) -> DataFrame:
    return criteria.filter(unresolved(F.col("concept_code")) & (trimmed(F.coalesce("concept", F.lit(""))) != ""))


def trials_to_retry(criteria: DataFrame, retry_log: DataFrame, include_retried: bool = False, direction: str = "Forward", n: int | None = 100) -> DataFrame:
    """Trials with unresolved rows that weren't retried, by nct_id: the first n, or all where n is None."""
    ids = unresolved_rows(criteria).select("nct_id").distinct()
    if not include_retried:
        ids = ids.join(retry_log.select("nct_id"), "nct_id", "left_anti")
    ids = ids.orderBy((F.asc if direction == "Forward" else F.desc)("nct_id"))
    return ids if n is None else ids.limit(max(1, n))


def cached_resolutions(concepts: DataFrame, cache: DataFrame) -> DataFrame:
    """concept with the cached code, name and score of its normalized form; only entries that resolved."""
    known = cache.filter(F.col("resolved") & ~unresolved(F.col("code"))).select(F.col("concept_norm").alias("__norm"), "code", "name", "score")
    return concepts.select("concept").distinct().withColumn("__norm", normalize_key(F.col("concept"))).join(known, "__norm").drop("__norm")


def studies_to_embed(detail: DataFrame, criteria: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    done = embeddings.filter(F.col("model") == model).select("nct_id")
    return detail.join(criteria.select("nct_id").distinct(), "nct_id", "left_semi").join(done, "nct_id", "left_anti")


def unmappable_rows(criteria: DataFrame, types: DataFrame) -> DataFrame:
    """Resolved rows whose code has no semantic type."""
    t = criteria.filter(~unresolved(F.col("concept_code")))
    return t.join(types.select(F.col("cui").alias("concept_code")), "concept_code", "left_anti")


#: Columns of attempts that time a phase of a trial's work.
PHASES = ["llm_ms", "umls_ms", "persist_ms"]


def runs_with_totals(runs: DataFrame, attempts: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """Runs, newest first, with token sums and mean milliseconds a phase (those that attempts time) of their successful attempts.

    A run without a timed success has null means.
    """
    ok = F.col("status") == "success"
    means = [F.avg(F.when(ok, F.col(c))).alias(f"avg_{c}") for c in PHASES if c in attempts.columns]
    per = attempts.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(ok, F.col("llm_prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("llm_completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.count_if(ok).alias("successes"),
        *means,
    )
    t = runs.join(per, "run_id", "left").fillna(0, ["prompt_tokens", "completion_tokens", "successes"])
    size = max(1, min(size, 500))
    return t.orderBy(F.desc("started_at"), F.desc("run_id")).offset((max(1, page) - 1) * size).limit(size)


def authored_listing(studies: DataFrame, criteria: DataFrame) -> DataFrame:
    """Studies with their number of criteria, 0 included, last updated first."""
    per = criteria.groupBy("study_id").agg(F.count(F.lit(1)).alias("criterion_count"))
    return studies.join(per, "study_id", "left").fillna(0, ["criterion_count"]).orderBy(F.desc("updated_at"), "study_id")


def semantic_types_of(codes: DataFrame, types: DataFrame) -> DataFrame:
    """concept_code and assignments: array of (tui, sty) by sty; empty for an unknown or blank code."""
    per = types.groupBy(F.col("cui").alias("concept_code")).agg(F.sort_array(F.collect_set(F.struct("sty", "tui"))).alias("a"))
    per = per.select("concept_code", F.transform("a", lambda x: F.struct(x["tui"].alias("tui"), x["sty"].alias("sty"))).alias("assignments"))
    none = F.array().cast("array<struct<tui:string,sty:string>>")
    return codes.select("concept_code").distinct().join(per, "concept_code", "left").withColumn("assignments", F.coalesce("assignments", none))


def similar_to_vectors(emb: DataFrame, queries: DataFrame, with_criteria: DataFrame | None = None, k: int = 10, match: list[str] | None = None, skip_self: bool = False, block: int = 256, rows_block: int = 1024, index: VectorIndex | None = None) -> DataFrame:
    """query_id, nct_id, similarity (cosine, 4 places) and rank: the k most similar rows of each query, ties by nct_id.

    emb: nct_id, embedding and the `match` columns, which must be equal to the query's. queries: query_id, embedding and
    those columns. Queries and rows are dealt by hash to blocks of about `block` and `rows_block` rows, as many as the tables
    fill; each pair of blocks is one cell, a matrix product that keeps k rows a query. So cells grow in number, not in size.
    Vectors that are null, zero or not finite take no part; those of another length aren't compared. With an index of the
    same rows, queries look into their nearest cells only (see VectorIndex).
    """
    if index is not None:
        return index.search(queries, with_criteria, k, match, skip_self)
    match = match or []
    k = max(1, min(k, 500))
    if with_criteria is not None:
        emb = emb.join(with_criteria.select("nct_id").distinct(), "nct_id", "left_semi")
    return exact_search(comparable(queries, "query_id", match), comparable(emb, "nct_id", match), k, skip_self, block, rows_block)


def similar_to_trials(emb: DataFrame, keys: DataFrame, with_criteria: DataFrame | None = None, k: int = 10, match: list[str] | None = None, index: VectorIndex | None = None) -> DataFrame:
    """As similar_to_vectors from stored vectors, without the trial itself; has_vector tells a trial without a vector (one row, no match) from one without matches."""
    wanted = keys.select("nct_id").distinct()
    queries = emb.join(wanted, "nct_id", "left_semi").withColumnRenamed("nct_id", "query_id")
    found = similar_to_vectors(emb, queries, with_criteria, k, match, skip_self=True, index=index)
    have = queries.select("query_id").withColumn("has_vector", F.lit(True))
    t = wanted.withColumnRenamed("nct_id", "query_id").join(have, "query_id", "left").join(found.hint("merge"), "query_id", "left")
    return t.withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))
