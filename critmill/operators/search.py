"""Filters, lookups and paging over criteria, studies, attempts and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, null_if_empty, significant_token_count, token_containment, trimmed, unresolved

#: Phrases of criteria that only name a contact.
STOP_PHRASES = ["please contact", "contact site for", "contact study"]
#: By what criteria and attempts can be sorted; an unknown key means the first.
CRITERIA_SORTS = ["created_at_desc", "created_at_asc", "nct_id_asc", "criterion_asc", "domain_asc", "concept_asc", "concept_code_asc", "semantic_type_asc", "match_score_desc"]
ATTEMPT_SORTS = ["started_at_desc", "started_at_asc", "finished_at_desc", "nct_id_asc", "status_asc", "duration_desc", "parsed_desc", "persisted_desc", "prompt_tokens_desc", "completion_tokens_desc"]
#: Short names of sort keys, and columns that a key's name stands for.
SHORT = {"newest": "created_at_desc", "nct": "nct_id_asc", "concept": "concept_asc", "domain": "domain_asc"}
SHORT_ATTEMPTS = {"newest": "started_at_desc", "oldest": "started_at_asc", "nct": "nct_id_asc", "duration": "duration_desc"}
NAMED = {"parsed": "parsed_record_count", "persisted": "persisted_row_count", "prompt_tokens": "llm_prompt_tokens", "completion_tokens": "llm_completion_tokens"}


def sort_columns(df: DataFrame, sort: str | None, menu: list[str], short: dict[str, str], ties: dict[str, str]) -> list[Column]:
    """Order of a menu's key: nulls last, ties in the key's own direction by the column that `ties` names for it ('' for the rest).

    A key whose column the table lacks falls back to the first as an unknown one does.
    """
    key = short.get((sort or "").lower(), (sort or "").lower())
    name, _, way = (key if key in menu else menu[0]).rpartition("_")
    took = F.col("finished_at").cast("double") - F.col("started_at").cast("double") if name == "duration" and "finished_at" in df.columns else None
    column = took if took is not None else F.col(NAMED.get(name, name)) if NAMED.get(name, name) in df.columns else None
    if column is None:
        name, _, way = menu[0].rpartition("_")
        column = F.col(name)
    down = way == "desc"
    tie = ties.get(name, ties[""])
    return [column.desc_nulls_last() if down else column.asc_nulls_last(), F.desc(tie) if down or name in ties else F.asc(tie)]


def selectable(criteria: Column, min_length: int = 50, phrases: list[str] = STOP_PHRASES) -> Column:
    ok = criteria.isNotNull() & (F.length(F.trim(criteria)) >= min_length)
    for p in phrases:
        ok = ok & ~criteria.ilike(f"%{p}%")
    return ok


def selectable_trials(src: DataFrame, min_length: int = 50, phrases: list[str] = STOP_PHRASES) -> DataFrame:
    """Trials whose criteria are long enough and no mere contact note."""
    return src.filter(selectable(F.col("criteria"), min_length, phrases))


def _given(value) -> str | None:
    value = (value or "").strip() if isinstance(value, str) or value is None else value
    return value or None


def contains(c: Column, text: str) -> Column:
    """Holds the text in any case, literally."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def page_of(df: DataFrame, order: list[Column], page: int, size: int, most: int = 200) -> DataFrame:
    """One page, from 1, of a clamped size."""
    size, page = max(1, min(size, most)), max(1, page)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def search_criteria(df: DataFrame, *, nct_id=None, criterion=None, domain=None, concept=None, concept_code=None, semantic_types=None, sort="newest", page=1, size=50) -> tuple[DataFrame, DataFrame]:
    """Page and total of the rows that pass every given filter; blank filters don't count."""
    t = df
    if v := _given(nct_id):
        t = t.filter(F.col("nct_id") == v)
    if v := _given(criterion):
        t = t.filter(contains(F.col("criterion"), v))
    if v := _given(domain):
        t = t.filter(F.col("domain") == v)
    if v := _given(concept):
        t = t.filter(contains(F.col("concept"), v))
    if v := _given(concept_code):
        t = t.filter(F.col("concept_code") == v)
    if types := sorted({x.strip() for x in semantic_types or [] if x and x.strip()}):
        t = t.filter(F.arrays_overlap("semantic_type_tuis", F.array(*map(F.lit, types))))
    return page_of(t, sort_columns(t, sort, CRITERIA_SORTS, SHORT, {"": "id"}), page, size), t.agg(F.count(F.lit(1)).alias("total"))


def _holds(text: str):
    return lambda x: contains(x, text)


def _member_holds(text: str):
    return lambda x: contains(x["name"], text) | contains(x["type"], text)


def search_studies(df: DataFrame, filters: dict[str, str], limit: int = 100) -> DataFrame:
    """Studies that hold every given text, in a column or any element of an array column; no filter finds nothing.

    Up to limit + 1 rows come back in order of nct_id: the extra one tells that there are more.
    """
    given = {c: v for c, x in filters.items() if (v := _given(x))}
    if not given:
        return df.limit(0)
    t = df
    for c, v in given.items():
        kind = df.schema[c].dataType.simpleString()
        if kind == "array<string>":
            t = t.filter(F.exists(c, _holds(v)))
        elif kind.startswith("array<struct"):
            t = t.filter(F.exists(c, _member_holds(v)))
        else:
            t = t.filter(contains(F.col(c), v))
    return t.orderBy("nct_id").limit(max(1, min(limit, 500)) + 1)


def latest_attempt(df: DataFrame) -> DataFrame:
    """The newest attempt of each trial; of attempts that began together, the greatest attempt_id."""
    whole = F.struct(*df.columns)
    return df.groupBy("nct_id").agg(F.max_by(whole, F.struct("started_at", "attempt_id")).alias("r")).select("r.*")


def superseded(df: DataFrame) -> DataFrame:
    """All attempts but each trial's latest."""
    return df.join(latest_attempt(df).select("attempt_id"), "attempt_id", "left_anti")


def list_attempts(df: DataFrame, *, status=None, run_id=None, nct_id=None, hide_superseded=True, sort="newest", page=1, size=50) -> DataFrame:
    """A page of attempts. The latest of each trial is chosen before any filter, so an old failure can't show through."""
    t = latest_attempt(df) if hide_superseded else df
    for name, value in (("status", status), ("run_id", run_id), ("nct_id", nct_id)):
        if v := _given(value):
            t = t.filter(F.col(name) == v)
    order = sort_columns(t, sort, ATTEMPT_SORTS, SHORT_ATTEMPTS, {"": "nct_id", "nct_id": "started_at", "status": "started_at"})
    return page_of(t, [*order, F.desc("attempt_id")], page, size, 1000)


def attempt_history(df: DataFrame, nct_id: str) -> DataFrame:
    return df.filter(F.col("nct_id") == nct_id).orderBy(F.desc("started_at"), F.desc("attempt_id"))


def search_audit(df: DataFrame, *, user=None, action=None, since=None, until=None, limit=50, cap=100_000, page=1) -> DataFrame:
    """A page of audit rows, newest first; the time range is inclusive."""
    t = df
    for name, value in (("user_name", user), ("action", action)):
        if v := _given(value):
            t = t.filter(F.col(name) == v)
    t = t if since is None else t.filter(F.col("occurred_at") >= F.lit(since))
    t = t if until is None else t.filter(F.col("occurred_at") <= F.lit(until))
    return page_of(t, [F.desc("occurred_at"), F.desc("audit_id")], page, limit, cap)


def append_audit(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def distinct_estimates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and estimate: one pass of sketches over all columns."""
    one = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("estimate")) for c in columns))))


def filter_options(df: DataFrame, columns: list[str], cap: int = 500) -> DataFrame:
    """column_name and value: distinct non-empty values of each column, none for a column that has more than `cap`.

    A sketch first tells which columns are too wide to scan for (over twice the cap); one aggregation then makes the
    values of all others.
    """
    cap = max(1, min(cap, 500))
    wide = distinct_estimates(df, columns).filter(F.col("estimate") > 2 * cap).select("column_name").collect()  # a row a column
    narrow = [c for c in columns if c not in {r.column_name for r in wide}]
    if not narrow:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    pairs = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in narrow))))
    values = pairs.filter(null_if_empty(trimmed(F.col("value"))).isNotNull()).distinct()
    count = F.count(F.lit(1)).over(Window.partitionBy("column_name"))
    return values.withColumn("n", count).filter(F.col("n") <= cap).select("column_name", "value")


def coverage_guard(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """For queries of two or more tokens, candidates that hold enough of them. pairs: query, name."""
    return pairs.filter((significant_token_count(F.col("query")) < 2) | (token_containment(F.col("query"), F.col("name")) >= least))


def code_guard(pairs: DataFrame) -> DataFrame:
    """A query with code tokens keeps candidates that have none or share one."""
    q, c = code_tokens(F.col("query")), code_tokens(F.col("name"))
    return pairs.filter((F.size(q) == 0) | (F.size(c) == 0) | F.arrays_overlap(q, c))


def pref_names(codes: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_code and pref_name of known codes."""
    return codes.select("concept_code").distinct().join(concepts.select(F.col("cui").alias("concept_code"), "pref_name"), "concept_code")


def search_concepts(concepts: DataFrame, profile: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """cui, pref_name and trials of names that hold the term, most used first. profile: concept_code, trials."""
    found = concepts.filter(contains(F.col("pref_name"), term.strip())).join(profile.withColumnRenamed("concept_code", "cui"), "cui", "left")
    found = found.select("cui", "pref_name", F.coalesce("trials", F.lit(0)).alias("trials"))
    return found.orderBy(F.desc("trials"), "pref_name", "cui").limit(max(1, min(limit, 100)))


def stale_to_interrupted(attempts: DataFrame, now, min_age_seconds: int) -> DataFrame:
    """Running attempts older than the age become interrupted; their error message stays if they have one. Age 0 or less changes nothing."""
    if min_age_seconds <= 0:
        return attempts
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {min_age_seconds} SECONDS"))
    if "finished_at" in attempts.columns:
        stale = stale & F.col("finished_at").isNull()
    out = attempts.withColumn("__stale", F.coalesce(stale, F.lit(False)))
    out = out.withColumn("status", F.when(F.col("__stale"), "interrupted").otherwise(F.col("status")))
    if "error_message" in attempts.columns:
        out = out.withColumn("error_message", F.when(F.col("__stale"), F.coalesce("error_message", F.lit("interrupted"))).otherwise(F.col("error_message")))
    return out.drop("__stale")


#: How a run may end by hand.
RUN_ENDS = ["completed", "failed", "cancelled", "interrupted"]


def resolve_run(runs: DataFrame, attempts: DataFrame, run_id: str, status: str, reason: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends a running run and interrupts its running attempts; any other run is left alone.

    Returns runs, attempts and one row (changed, attempts_interrupted).
    """
    if status not in RUN_ENDS:
        raise ValueError(f"not a final status: {status}")
    hit = (F.col("run_id") == run_id) & (F.col("status") == "running")
    open_run = runs.filter(hit).select("run_id")
    mine = attempts.join(F.broadcast(open_run.withColumn("__open", F.lit(True))), "run_id", "left")  # one row at most
    stop = F.col("__open").isNotNull() & (F.col("status") == "running")
    new_runs = runs.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    if "reason" in runs.columns:
        new_runs = runs.withColumn("reason", F.when(hit, F.lit(reason)).otherwise(F.col("reason"))).withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    new_attempts = mine.withColumn("status", F.when(stop, "interrupted").otherwise(F.col("status"))).select(*attempts.columns)
    told = open_run.agg((F.count(F.lit(1)) > 0).alias("changed")).crossJoin(mine.agg(F.count_if(stop).alias("attempts_interrupted")))
    return new_runs, new_attempts, told


def latest_snapshot(detail: DataFrame, nct_id: str) -> DataFrame:
    return detail.filter(F.col("nct_id") == nct_id)


def delete_attempt(attempts: DataFrame, run_id: str, nct_id: str) -> DataFrame:
    return attempts.filter(~((F.col("run_id") == run_id) & (F.col("nct_id") == nct_id)))


def resolved(df: DataFrame) -> DataFrame:
    return df.filter(~unresolved(F.col("concept_code")))
