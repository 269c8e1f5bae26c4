"""Cohorts, lift, trends, concept clusters, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key, trimmed, unresolved
from ..sources.tables import materialized
from .joins import unmappable_rows
from .search import latest_attempt, resolved, selectable


def pairs(criteria: DataFrame) -> DataFrame:
    """Distinct (nct_id, concept_code) of resolved rows: the table that cohort work is best kept in; made once, it stands for criteria in the functions below. `pairs.PairTable` keeps it from run to run."""
    return resolved(criteria).select("nct_id", "concept_code").distinct()


def with_descendants(value: str, closure: DataFrame | None, spark) -> DataFrame:
    """concept_code: the value and what lies below it."""
    own = spark.createDataFrame([(value,)], "concept_code string")
    return own if closure is None else own.union(closure.filter(F.col("ancestor") == value).select("descendant")).distinct()


def defining_codes(kind: str, value: str, closure: DataFrame | None, spark) -> DataFrame:
    """Codes that define the cohort itself; none for a phase or year."""
    return with_descendants(value, closure, spark) if kind in ("Concept", "Condition") else spark.createDataFrame([], "concept_code string")


def cohort_members(kind: str, value: str, *, criteria: DataFrame, detail: DataFrame | None = None, mentions: DataFrame | None = None, dictionary: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Distinct nct_id of a cohort by concept, condition, phase or start year; with a closure, descendants count.

    Other kinds than Concept also need a resolved criterion, so that cohort and corpus have one universe. A
    year that is no integer gives nobody.
    """
    spark = criteria.sparkSession
    universe = resolved(criteria).select("nct_id", "concept_code")
    if kind == "Concept":
        return universe.join(with_descendants(value, closure, spark), "concept_code", "left_semi").select("nct_id").distinct()
    if kind == "Condition":
        known = dictionary.select("condition_norm", F.col("code").alias("concept_code")).join(with_descendants(value, closure, spark), "concept_code", "left_semi")
        t = mentions.withColumn("condition_norm", normalize_key(F.col("cond"))).join(known.select("condition_norm"), "condition_norm", "left_semi")
    elif kind == "Phase":
        t = detail.filter(F.col("phase") == value)
    elif kind == "Year":
        year = int(value) if value.strip().lstrip("+-").isdigit() else None
        t = detail.filter(F.year("start_date") == year) if year is not None else detail.limit(0)
    else:
        raise ValueError(f"no cohort kind: {kind}")
    return t.select("nct_id").distinct().join(universe, "nct_id", "left_semi")


def cohort_profile(members: DataFrame, criteria: DataFrame) -> DataFrame:
    """concept_code, trials and the cohort's size on every row; one row without a code if the profile is empty."""
    per = pairs(criteria).join(members, "nct_id", "left_semi").groupBy("concept_code").agg(F.count(F.lit(1)).alias("trials"))
    per = materialized(per)  # made once: whether it's empty is asked as well
    size = F.broadcast(members.agg(F.count(F.lit(1)).alias("size")))  # one row
    # The row without a code goes where there are others: it is one of few rows, the profile never moves to it.
    none = per.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("concept_code"), F.lit(None).cast("long").alias("trials"))
    return per.unionByName(none).crossJoin(size).select("size", "concept_code", "trials")


def corpus_profile(criteria: DataFrame) -> DataFrame:
    return pairs(criteria).groupBy("concept_code").agg(F.count(F.lit(1)).alias("trials"))


def corpus_trial_count(criteria: DataFrame) -> DataFrame:
    return resolved(criteria).agg(F.countDistinct("nct_id").alias("trials"))


def lift_table(cohort: DataFrame, corpus: DataFrame, corpus_size: DataFrame, names: DataFrame, defining: DataFrame, min_support: int = 10) -> DataFrame:
    """Per concept of the cohort: shares in cohort and corpus (percent), their difference and ratio, and whether the code defines the cohort.

    cohort: concept_code, trials, size; corpus: concept_code, trials; corpus_size: trials (one row). Concepts below the
    support go; nothing comes of an empty cohort or corpus.
    """
    t = cohort.filter(F.col("concept_code").isNotNull() & (F.col("trials") >= max(1, min_support)) & (F.col("size") > 0))
    t = t.withColumnRenamed("trials", "cohort_trials").join(corpus.withColumnRenamed("trials", "corpus_trials"), "concept_code", "left")
    t = t.crossJoin(F.broadcast(corpus_size.select(F.col("trials").alias("corpus_size")))).filter("corpus_size > 0")  # one row
    t = t.join(names.select(F.col("cui").alias("concept_code"), "pref_name"), "concept_code", "left")
    t = t.join(defining.withColumn("is_defining", F.lit(True)), "concept_code", "left")
    a, b = F.col("cohort_trials") * 100.0 / F.col("size"), F.coalesce("corpus_trials", F.lit(0)) * 100.0 / F.col("corpus_size")
    t = t.select("concept_code", F.coalesce("pref_name", "concept_code").alias("concept_name"), "cohort_trials", F.coalesce("corpus_trials", F.lit(0)).alias("corpus_trials"), a.alias("pct_cohort"), b.alias("pct_corpus"), (a - b).alias("excess_pp"), F.when(b > 0, a / b).otherwise(0.0).alias("lift"), F.coalesce("is_defining", F.lit(False)).alias("is_defining"))
    return t.orderBy(F.desc("excess_pp"), F.desc("cohort_trials"), "concept_code")


def concept_trend(criteria: DataFrame, detail: DataFrame, codes: list[str], current_year: int, most: int = 5) -> DataFrame:
    """Per start year and code: studies, trials with the code, percent; years without a hit stay; the current year is partial."""
    spark = criteria.sparkSession
    codes = list(dict.fromkeys(c.strip() for c in codes if c and c.strip()))[:most]
    wanted = spark.createDataFrame([(c,) for c in codes], "concept_code string")
    dated = detail.filter(F.col("start_date").isNotNull()).select("nct_id", F.year("start_date").alias("start_year"))
    years = dated.groupBy("start_year").agg(F.countDistinct("nct_id").alias("studies")).crossJoin(F.broadcast(wanted))  # five rows at most
    hits = pairs(criteria).join(F.broadcast(wanted), "concept_code", "left_semi").join(dated.distinct(), "nct_id").groupBy("start_year", "concept_code").agg(F.countDistinct("nct_id").alias("hits"))
    t = years.join(hits, ["start_year", "concept_code"], "left")
    n = F.coalesce("hits", F.lit(0))
    return t.select("start_year", "concept_code", "studies", n.alias("trials"), F.round(n * 100.0 / F.col("studies"), 4).alias("percent"), (F.col("start_year") == current_year).alias("is_partial"))


def phase_breakdown(criteria: DataFrame, detail: DataFrame, code: str) -> DataFrame:
    """phase and trials with the code; no phase shows as (none)."""
    t = pairs(criteria).filter(F.col("concept_code") == code).join(detail.select("nct_id", "phase"), "nct_id", "left")
    return t.groupBy(F.coalesce(F.nullif("phase", F.lit("")), F.lit("(none)")).alias("phase")).agg(F.countDistinct("nct_id").alias("trials"))


def concept_summary(cuis: DataFrame, concepts: DataFrame, types: DataFrame, closure: DataFrame, criteria: DataFrame, detail: DataFrame, examples: int = 5) -> DataFrame:
    """One row a known concept of `cuis`: names, semantic types, relatives, trials, phases and example criteria."""
    known = concepts.join(cuis.select("cui").distinct(), "cui", "left_semi").select("cui", "pref_name", "root_source")
    sty = types.groupBy("cui").agg(F.array_join(F.array_sort(F.collect_set("sty")), "; ").alias("semantic_types"))
    up = closure.groupBy(F.col("descendant").alias("cui")).agg(F.count(F.lit(1)).alias("ancestors"))
    down = closure.groupBy(F.col("ancestor").alias("cui")).agg(F.count(F.lit(1)).alias("descendants"))
    rows = resolved(criteria).withColumnRenamed("concept_code", "cui").join(known.select("cui"), "cui", "left_semi")
    used = rows.groupBy("cui").agg(F.countDistinct("nct_id").alias("trials"))
    phase = F.coalesce(F.nullif("phase", F.lit("")), F.lit("(none)"))
    phases = rows.select("cui", "nct_id").distinct().join(detail.select("nct_id", "phase"), "nct_id", "left").groupBy("cui", phase.alias("phase")).agg(F.count(F.lit(1)).alias("trials"))
    phases = phases.groupBy("cui").agg(F.sort_array(F.collect_list(F.struct("phase", "trials"))).alias("phases"))
    first = rows.select("cui", "original_text").distinct().withColumn("i", F.row_number().over(Window.partitionBy("cui").orderBy("original_text"))).filter(F.col("i") <= examples)
    first = first.groupBy("cui").agg(F.sort_array(F.collect_list("original_text")).alias("examples"))
    t = known
    for part in (sty, up, down, used, phases, first):
        t = t.join(part, "cui", "left")
    t = t.crossJoin(F.broadcast(corpus_trial_count(criteria).withColumnRenamed("trials", "corpus_trials")))  # one row
    return t.fillna(0, ["ancestors", "descendants", "trials"]).fillna("", ["semantic_types"])


def _group_key(code: Column, concept: Column) -> Column:
    return F.when(~unresolved(code), code).otherwise(F.concat(F.lit("concept:"), F.lower(concept)))


def cluster_criteria(criteria: DataFrame, ids: DataFrame) -> DataFrame:
    """Criteria of a set of trials by criterion and concept (unresolved ones by their text), with study and record counts."""
    t = criteria.join(ids.select("nct_id").distinct(), "nct_id", "left_semi").withColumn("is_resolved", ~unresolved(F.col("concept_code")))
    t = t.groupBy("criterion", _group_key(F.col("concept_code"), F.col("concept")).alias("group_key"), "is_resolved").agg(
        F.max("concept").alias("label"), F.array_join(F.array_sort(F.collect_set("semantic_type")), ", ").alias("semantic_types"), F.countDistinct("nct_id").alias("studies"), F.count(F.lit(1)).alias("records")
    )
    return t.orderBy(F.desc("studies"), F.desc("records"), "criterion", "group_key")


def adopt_ancestors(codes: DataFrame, closure: DataFrame, level: int) -> DataFrame:
    """concept_code and its ancestor: of ancestors within the level that cover more than one code of the set, the one that covers most, then has fewest descendants, then the smallest."""
    near = closure.filter(F.col("min_distance") <= level).join(codes.select(F.col("concept_code").alias("descendant")), "descendant", "left_semi")
    # A code of the set that is an ancestor covers itself as well.
    own = codes.select(F.col("concept_code").alias("descendant")).join(near.select("ancestor").distinct(), F.col("descendant") == F.col("ancestor"))
    cover = near.select("descendant", "ancestor").union(own.select("descendant", "ancestor")).distinct()
    good = cover.groupBy("ancestor").agg(F.countDistinct("descendant").alias("covered")).filter("covered > 1")
    total = closure.join(good.select("ancestor"), "ancestor", "left_semi").groupBy("ancestor").agg(F.countDistinct("descendant").alias("below"))
    ranked = cover.join(good, "ancestor").join(total, "ancestor", "left").fillna(0, ["below"])
    best = F.row_number().over(Window.partitionBy("descendant").orderBy(F.desc("covered"), F.asc("below"), F.asc("ancestor")))
    return ranked.withColumn("i", best).filter("i = 1").select(F.col("descendant").alias("concept_code"), "ancestor")


def cluster_criteria_rolled_up(criteria: DataFrame, ids: DataFrame, closure: DataFrame, concepts: DataFrame, level: int = 1) -> DataFrame:
    """As cluster_criteria, concepts standing for the ancestor they adopt; inclusion and exclusion never merge."""
    level = max(0, min(level, 2))
    t = criteria.join(ids.select("nct_id").distinct(), "nct_id", "left_semi")
    codes = resolved(t).select("concept_code").distinct()
    adopted = adopt_ancestors(codes, closure, level)
    t = t.join(adopted, "concept_code", "left").withColumn("is_resolved", ~unresolved(F.col("concept_code")))
    t = t.join(concepts.select(F.col("cui").alias("ancestor"), F.col("pref_name").alias("ancestor_name")), "ancestor", "left")
    key = F.coalesce("ancestor", _group_key(F.col("concept_code"), F.col("concept")))
    t = t.groupBy("criterion", key.alias("group_key"), "is_resolved").agg(
        F.max(F.coalesce("ancestor_name", "concept")).alias("label"), F.max("ancestor").alias("ancestor_code"), F.array_sort(F.collect_set(F.when(F.col("is_resolved"), F.col("concept_code")))).alias("member_codes"),
        F.countDistinct("nct_id").alias("studies"), F.count(F.lit(1)).alias("records"),
    )
    return t.orderBy(F.desc("studies"), F.desc("records"), "criterion", "group_key")


def cluster_records(criteria: DataFrame, ids: DataFrame, criterion: str, key: str | None = None, members: list[str] | None = None) -> DataFrame:
    """The rows behind a cluster: of its member codes if given, else of its key."""
    t = criteria.join(ids.select("nct_id").distinct(), "nct_id", "left_semi").filter(F.col("criterion") == criterion)
    t = t.filter(F.col("concept_code").isin(members)) if members else t.filter(_group_key(F.col("concept_code"), F.col("concept")) == key)
    return t.orderBy("nct_id", "id")


def source_texts(records: DataFrame) -> DataFrame:
    return records.select(trimmed(F.col("original_text")).alias("original_text")).filter("original_text <> ''").distinct()


def seed_conditions(mentions: DataFrame) -> DataFrame:
    """condition_norm, raw_form (in most trials, ties to the smallest) and study_count (distinct trials)."""
    t = mentions.select("nct_id", normalize_key(F.col("cond")).alias("condition_norm"), trimmed(F.col("cond")).alias("raw")).filter("condition_norm <> ''")
    forms = t.distinct().groupBy("condition_norm", "raw").agg(F.count(F.lit(1)).alias("n"))
    forms = forms.groupBy("condition_norm").agg(F.min_by("raw", F.struct(-F.col("n"), F.col("raw"))).alias("raw_form"))
    return forms.join(t.groupBy("condition_norm").agg(F.countDistinct("nct_id").alias("study_count")), "condition_norm")


def seed_condition_dictionary(mentions: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary after seeding, and how many entries are new. resolved_at is cleared only where the raw form changed."""
    seeds = seed_conditions(mentions)
    t = existing.alias("d").join(seeds.alias("s"), "condition_norm", "full_outer")
    new = F.col("s.raw_form").isNotNull() & (F.col("d.raw_form").isNull() | (F.col("d.raw_form") != F.col("s.raw_form")))
    out = t.select(
        "condition_norm", F.coalesce("s.raw_form", "d.raw_form").alias("raw_form"), F.coalesce("s.study_count", "d.study_count").alias("study_count"),
        *(F.col(f"d.{c}") for c in existing.columns if c not in ("condition_norm", "raw_form", "study_count", "resolved_at")), F.when(~new, F.col("d.resolved_at")).alias("resolved_at"),
    ).select(*existing.columns)
    return out, seeds.join(existing.select("condition_norm"), "condition_norm", "left_anti").agg(F.count(F.lit(1)).alias("inserted"))


def concepts_to_normalize(criteria: DataFrame, cache: DataFrame, include_attempted: bool = False, n: int | None = 100_000) -> DataFrame:
    """Unresolved concepts by key that the cache lacks: sample form and frequency, most frequent first; all where n is None."""
    t = criteria.filter(unresolved(F.col("concept_code"))).withColumn("concept_norm", normalize_key(F.col("concept"))).filter("concept_norm <> ''")
    if not include_attempted:
        t = t.join(cache.select("concept_norm"), "concept_norm", "left_anti")
    t = t.groupBy("concept_norm").agg(F.min("concept").alias("sample"), F.count(F.lit(1)).alias("frequency"))
    t = t.orderBy(F.desc("frequency"), "concept_norm")
    return t if n is None else t.limit(max(1, min(n, 100_000)))


#: Final statuses that are no failure.
NO_FAILURE = ["success", "running", "parse_empty", "cancelled"]


def dashboard_metrics(criteria: DataFrame, attempts: DataFrame, sources: DataFrame, detail: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """One row of counts over criteria, latest attempts, all attempts' tokens, and what is left to do."""
    one = lambda c: F.count_if(c)
    status = F.col("status")
    rows = criteria.agg(F.count(F.lit(1)).alias("criterion_rows"), F.coalesce(F.avg(F.col("concept_code").isNotNull().cast("double")), F.lit(0.0)).alias("resolution_rate"))
    last = latest_attempt(attempts.select("nct_id", "attempt_id", "started_at", "status")).agg(
        one(status == "success").alias("successes"), one(~status.isin(NO_FAILURE)).alias("failures"), one(status == "llm_failed").alias("llm_failed"), one(status == "parse_invalid_json").alias("invalid_json"),
        one(status == "persist_failed").alias("persist_failed"), one(status == "interrupted").alias("interrupted"), one(~status.isin([*NO_FAILURE, "llm_failed", "parse_invalid_json", "persist_failed", "interrupted"])).alias("other_failed"),
        one(status == "parse_empty").alias("parse_empty"), F.count(F.lit(1)).alias("attempted"),
    )
    tokens = attempts.agg(F.coalesce(F.sum("llm_prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("llm_completion_tokens"), F.lit(0)).alias("completion_tokens"))
    done = embeddings.filter(F.col("model") == model).select("nct_id")
    backlog = detail.select("nct_id").join(criteria.select("nct_id").distinct(), "nct_id", "left_semi").join(done, "nct_id", "left_anti").agg(F.count(F.lit(1)).alias("embedding_backlog"))
    total = sources.agg(F.count(F.lit(1)).alias("source_total"), one(selectable(F.col("criteria"))).alias("selectable_total"))
    t = rows
    for part in (last, tokens, backlog, total):  # single rows
        t = t.crossJoin(F.broadcast(part))
    return t.withColumn("remaining", F.greatest(F.lit(0), F.col("source_total") - F.col("attempted")))


def run_metrics(rows: DataFrame) -> DataFrame:
    """Studies, rows, resolved rows and their share (3 places, half up; 0 for none)."""
    ok = ~unresolved(F.col("concept_code"))
    t = rows.agg(F.countDistinct("nct_id").alias("studies"), F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("resolved"))
    return t.withColumn("resolution_rate", F.when(F.col("rows") > 0, F.round(F.col("resolved") / F.col("rows"), 3)).otherwise(0.0))


def embedding_stats(emb: DataFrame) -> DataFrame:
    """Vectors by model, and their total on every row."""
    per = emb.groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))
    return per.withColumn("total", F.sum("vectors").over(Window.partitionBy())).orderBy(F.desc("vectors"), "model")


def canonical_types(types: DataFrame) -> DataFrame:
    """cui, tuis (sorted distinct) and sty_text (distinct names, sorted, joined)."""
    return types.groupBy("cui").agg(F.array_sort(F.collect_set("tui")).alias("tuis"), F.array_join(F.array_sort(F.collect_set("sty")), ", ").alias("sty_text"))


def backfill_semantic_types(criteria: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Criteria with the canonical types of their codes, and how many rows changed; rows without types stay as they are."""
    t = criteria.join(canonical_types(types).withColumnRenamed("cui", "concept_code"), "concept_code", "left")
    change = F.col("tuis").isNotNull() & ~(F.col("semantic_type_tuis").eqNullSafe(F.col("tuis")) & F.col("semantic_type").eqNullSafe(F.col("sty_text")))
    t = t.withColumn("__c", change)
    out = t.withColumn("semantic_type_tuis", F.when(F.col("__c"), F.col("tuis")).otherwise(F.col("semantic_type_tuis"))).withColumn("semantic_type", F.when(F.col("__c"), F.col("sty_text")).otherwise(F.col("semantic_type")))
    return out.select(*criteria.columns), t.agg(F.count_if("__c").alias("changed"))


def backfill_job(criteria: DataFrame, concepts: DataFrame, types: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """As backfill_semantic_types, for a whole load; refuses a terminology in which concepts have no semantic type.

    The second table is one row: changed, and unmappable (resolved rows whose code has no type). A dry run tells it and leaves criteria as they are.
    """
    missing = concepts.join(types.select("cui"), "cui", "left_anti").count()
    if missing:
        raise ValueError(f"the terminology is incomplete: {missing} concepts have no semantic type")
    new, changed = backfill_semantic_types(criteria, types)
    told = changed.crossJoin(F.broadcast(unmappable_rows(criteria, types).agg(F.count(F.lit(1)).alias("unmappable"))))  # one row
    return (criteria if dry_run else new), told


def compare_resolvers(sample: DataFrame, a: DataFrame, b: DataFrame, examples: int = 15) -> DataFrame:
    """bucket, n and example queries of two resolvers' results. sample: query; a, b: query, cui.

    Each task keeps its first queries of a bucket before they meet, so that no bucket is sorted whole in one task.
    """
    t = sample.select("query").distinct().join(a.select("query", F.col("cui").alias("ca")), "query", "left").join(b.select("query", F.col("cui").alias("cb")), "query", "left")
    x, y = F.col("ca").isNotNull(), F.col("cb").isNotNull()
    bucket = F.when(x & y & (F.col("ca") == F.col("cb")), "both").when(x & y, "different").when(x, "a_only").when(y, "b_only").otherwise("neither")
    t = materialized(t.select("query", bucket.alias("bucket")))
    first = t.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("query"))).filter(F.col("i") <= examples)
    first = first.groupBy("bucket").agg(F.sort_array(F.collect_list("query")).alias("examples"))
    return t.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first), "bucket")  # five rows at most


def merge_duplicate_concepts(records: DataFrame) -> DataFrame:
    """Resolved rows of a trial that share code, types and criterion become the first of them, with their distinct texts in order.

    records: nct_id, ord, criterion, concept_code, semantic_type_tuis, original_text and others. Unresolved rows pass.
    """
    tuis = F.array_join(F.array_sort("semantic_type_tuis"), "|")
    key = F.when(~unresolved(F.col("concept_code")), F.concat_ws("\x1f", "concept_code", tuis, "criterion")).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    # Groups are small and nearly all of one row: rows are sorted once beside each other, where aggregates of lists and structs would be sorted on both sides of the shuffle.
    group = Window.partitionBy("nct_id", "__k").orderBy("ord", "original_text")
    texts = F.collect_list(F.nullif("original_text", F.lit(""))).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = records.withColumn("__k", key).select("*", F.row_number().over(group).alias("__i"), texts.alias("__t")).filter("__i = 1")
    joined = F.array_join(F.array_distinct("__t"), " ")
    text = F.when(~unresolved(F.col("concept_code")), joined).otherwise(F.col("original_text"))
    return t.withColumn("original_text", text).select(*records.columns)


def sample_concepts(criteria: DataFrame, n_unresolved: int, n_resolved: int) -> DataFrame:
    """The first distinct concepts of either kind, together and sorted."""
    pick = lambda ok, n: criteria.filter(ok).select("concept").filter("concept <> ''").distinct().orderBy("concept").limit(n)
    return pick(unresolved(F.col("concept_code")), n_unresolved).union(pick(~unresolved(F.col("concept_code")), n_resolved)).distinct().orderBy("concept")
