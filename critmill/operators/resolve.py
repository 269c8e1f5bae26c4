"""Resolution of free-text concepts and conditions to codes: exact, token and trigram arms over inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_none_term, jaccard, lexemes, match_score, normalize_key, trigrams, trimmed, unresolved
from ..sources.tables import counted_join, materialized, upsert
from .cohorts import canonical_types
from .index import FuzzyIndex, build_index, first_names, gram_candidates, token_candidates
from .joins import exact_candidates, unseen_conditions
from .search import code_guard, coverage_guard


#: Tables of at most so many texts with their lexemes or grams (some 2 KB each) are broadcast.
TEXTS = 20_000


def union_hits(*arms: DataFrame) -> DataFrame:
    """query, cui, rank of several arms, one after another."""
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out


def top_k_candidates(hits: DataFrame, k: int = 15) -> DataFrame:
    """The k concepts of the highest rank of each query; ties to the smaller cui."""
    t = hits.groupBy("query", "cui").agg(F.max("rank").alias("rank"))
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "cui"))
    return t.withColumn("position", at).filter(F.col("position") <= k)


def _distinct(queries: DataFrame) -> DataFrame:
    return queries.select("query").filter(normalize_key(F.col("query")) != "").distinct()


def exact_arm(queries: DataFrame, atoms: DataFrame) -> DataFrame:
    q = _distinct(queries).withColumn("str_norm", normalize_key(F.col("query")))
    return q.join(atoms.select("str_norm", "cui").distinct(), "str_norm").select("query", "cui", F.lit(2.0).alias("rank"))


def token_arm(queries: DataFrame, atoms: DataFrame, limit: int = 15, max_len: int = 80, index: FuzzyIndex | None = None) -> DataFrame:
    """Atoms that share a lexeme: 1 + min(0.999, matched / query lexemes / (1 + ln(atom lexemes))).

    Candidates come from the index's bounded lists, which hold the best max(limit, 40) texts of any query; they are counted exactly. Those
    texts of a query stay.
    """
    k = max(limit, 40)
    if index is None or index.best < k:
        index = build_index(atoms, max_len, best=k)
    q = materialized(_distinct(queries).withColumn("lex", lexemes(F.col("query"))))
    found = token_candidates(q, index)
    t = counted_join(found, q.withColumnRenamed("lex", "ql"), "query", most=TEXTS)
    t = counted_join(t, index.texts.select("tid", "str", "na", "lex"), "tid", most=TEXTS)
    shared = F.size(F.array_intersect("ql", "lex"))
    t = t.withColumn("rank", 1 + F.least(F.lit(0.999), shared / F.size("ql") / (1 + F.log("na")))).select("query", "str", "rank")
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "str"))
    return t.withColumn("i", at).filter(F.col("i") <= k).join(index.names, "str").select("query", "cui", "rank")


def trigram_arm(queries: DataFrame, atoms: DataFrame, least: float = 0.3, max_len: int = 80, index: FuzzyIndex | None = None) -> DataFrame:
    """Atoms whose trigrams are alike enough (Jaccard): candidates by rare grams, sizes and places, each compared once, whole."""
    index = index or build_index(atoms, max_len)
    q = _distinct(queries).withColumn("grams", trigrams(F.col("query")))
    q = materialized(q.select("query", F.size("grams").alias("nq"), "grams"))
    found = gram_candidates(q, index, least).distinct()
    t = counted_join(found, q.select("query", F.col("grams").alias("qg")), "query", most=TEXTS)
    t = counted_join(t, index.texts.select("tid", "str", F.col("grams").alias("tg")), "tid", most=TEXTS)
    hits = t.select("query", "str", jaccard(F.col("qg"), F.col("tg")).alias("rank")).filter(F.col("rank") >= least)
    return hits.join(index.names, "str").select("query", "cui", "rank")


def candidate_search(queries: DataFrame, atoms: DataFrame, concepts: DataFrame, limit: int = 15, least: float = 0.3, max_len: int = 80, include_trigram: bool = True, index: FuzzyIndex | None = None) -> DataFrame:
    """query, cui, rank, position, name, root_source of the best candidates of each distinct query. An index (build_index) serves many searches; without one it's made."""
    index = first_names(index or build_index(atoms, max_len, best=max(limit, 40)), limit)
    arms = [exact_arm(queries, atoms), token_arm(queries, atoms, limit, max_len, index)]
    if include_trigram:
        arms.append(trigram_arm(queries, atoms, least, max_len, index))
    return named_candidates(union_hits(*arms), concepts, limit)


def named_candidates(hits: DataFrame, concepts: DataFrame, limit: int) -> DataFrame:
    return top_k_candidates(hits, limit).join(concepts.select("cui", F.col("pref_name").alias("name"), "root_source"), "cui")


def best_match(pairs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """The candidate of the highest score at or above the threshold, ties to the higher rank, then the smaller cui; score to 3 places."""
    t = pairs.withColumn("score", match_score(F.col("query"), F.col("name"))).filter(F.col("score") >= threshold)
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("position"), "cui"))
    return t.withColumn("i", at).filter("i = 1").select("query", "cui", "name", "root_source", F.round("score", 3).alias("score"))


def guarded(pairs: DataFrame) -> DataFrame:
    return code_guard(coverage_guard(pairs))


def search_with_fallback(queries: DataFrame, atoms: DataFrame, concepts: DataFrame, threshold: float = 0.45, limit: int = 15, least: float = 0.3, max_len: int = 80, index: FuzzyIndex | None = None) -> DataFrame:
    """Guarded candidates; the trigram arm runs only for queries that no exact or token candidate answers, and joins their earlier hits."""
    index = first_names(index or build_index(atoms, max_len, best=max(limit, 40)), limit)
    queries = materialized(_distinct(queries))
    hits = materialized(union_hits(exact_arm(queries, atoms), token_arm(queries, atoms, limit, max_len, index)))
    first = materialized(guarded(named_candidates(hits, concepts, limit)))
    done = materialized(best_match(first, threshold).select("query"))
    rest = materialized(queries.join(done, "query", "left_anti"))
    again = union_hits(hits.join(rest, "query", "left_semi"), trigram_arm(rest, atoms, least, max_len, index))
    return first.join(done, "query", "left_semi").unionByName(guarded(named_candidates(again, concepts, limit)))


def resolve_queries(queries: DataFrame, atoms: DataFrame, concepts: DataFrame, threshold: float = 0.45, index: FuzzyIndex | None = None) -> DataFrame:
    """query, cui, name, root_source, score of the queries that resolve."""
    return materialized(best_match(search_with_fallback(queries, atoms, concepts, threshold, index=index), threshold))


def resolve_concepts(criteria: DataFrame, atoms: DataFrame, concepts: DataFrame, types: DataFrame, cache: DataFrame | None = None, index: FuzzyIndex | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Criteria with code, name, score, source and semantic types of their concept; distinct concepts are resolved once and joined back.

    What the terminology doesn't answer may come from the normalization cache. Unresolved rows have null code and types. asked: the
    concepts of the criteria, where they are told more cheaply than by the rows.
    """
    queries = materialized((criteria if asked is None else asked).select(F.col("concept").alias("query")).distinct())
    found = resolve_queries(queries, atoms, concepts, index=index).select(F.col("query").alias("concept"), "cui", "name", "score", F.col("root_source").alias("source"))
    if cache is not None:
        from .joins import cached_resolutions

        rest = queries.withColumnRenamed("query", "concept").join(found.select("concept"), "concept", "left_anti")
        cached = cached_resolutions(rest, cache).select("concept", F.col("code").alias("cui"), "name", "score", F.lit("cache").alias("source"))
        found = found.unionByName(cached)
    named = found.join(canonical_types(types), "cui", "left")
    new = ["concept_code", "umls_name", "match_score", "match_source", "semantic_type", "semantic_type_tuis"]
    named = named.select("concept", F.col("cui").alias("concept_code"), F.col("name").alias("umls_name"), F.col("score").alias("match_score"), F.col("source").alias("match_source"), F.col("sty_text").alias("semantic_type"), F.col("tuis").alias("semantic_type_tuis"))
    return counted_join(criteria.drop(*new), materialized(named), "concept", "left")  # concepts are few and repeat: a shuffle by them would be skewed


def pick_ambiguous(candidates: DataFrame) -> DataFrame:
    """One concept for a condition with several exact ones. candidates: norm, raw_form, cui, pref_name, has_hierarchy."""
    same = (normalize_key(F.col("pref_name")) == F.col("norm")).cast("int")
    order = [F.desc(F.col("has_hierarchy").cast("int")), F.desc(same), F.desc(match_score(F.col("raw_form"), F.col("pref_name"))), F.asc("cui")]
    return candidates.withColumn("i", F.row_number().over(Window.partitionBy("norm").orderBy(*order))).filter("i = 1").drop("i")


def resolve_conditions(conditions: DataFrame, atoms: DataFrame, concepts: DataFrame, closure: DataFrame, threshold: float = 0.6, index: FuzzyIndex | None = None) -> DataFrame:
    """condition_norm, raw_form, code, match_tier, match_score: exact, exact_ambiguous, fuzzy or unresolved.

    Exact tiers score 1 without the scorer; the fuzzy one asks the terminology for the raw form.
    """
    c = conditions.select("condition_norm", "raw_form")
    exact = exact_candidates(c.select(F.col("condition_norm").alias("norm")), atoms, concepts, closure)
    exact = exact.join(c.withColumnRenamed("condition_norm", "norm"), "norm")
    many = exact.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    picked = pick_ambiguous(exact).join(many, "norm")
    tier = F.when(F.col("n") == 1, "exact").otherwise("exact_ambiguous")
    sure = picked.select(F.col("norm").alias("condition_norm"), "raw_form", F.col("cui").alias("code"), tier.alias("match_tier"), F.lit(1.0).alias("match_score"))
    rest = c.join(many.select(F.col("norm").alias("condition_norm")), "condition_norm", "left_anti")
    fuzzy = resolve_queries(rest.select(F.col("raw_form").alias("query")), atoms, concepts, threshold, index).select(F.col("query").alias("raw_form"), F.col("cui").alias("code"), "score")
    rest = rest.join(fuzzy, "raw_form", "left")
    rest = rest.select("condition_norm", "raw_form", "code", F.when(F.col("code").isNull(), "unresolved").otherwise("fuzzy").alias("match_tier"), F.col("score").alias("match_score"))
    return sure.unionByName(rest)


def pending_conditions(dictionary: DataFrame, force: bool = False, limit: int = 1000) -> DataFrame:
    """Entries still to resolve, those of most trials first."""
    t = dictionary if force else dictionary.filter("resolved_at IS NULL")
    return t.orderBy(F.desc("study_count"), "condition_norm").limit(max(1, limit))


def store_conditions(dictionary: DataFrame, resolved: DataFrame, now) -> DataFrame:
    """Resolved entries put in; an entry's study_count stays, a new one starts at 0."""
    new = resolved.withColumn("study_count", F.lit(0).cast("long")).withColumn("resolved_at", F.lit(now).cast("timestamp"))
    return upsert(dictionary, new.select(*[c for c in dictionary.columns if c in new.columns]), ["condition_norm"], {"study_count": "keep"})


def ensure_conditions(mentions: DataFrame, dictionary: DataFrame, atoms: DataFrame, concepts: DataFrame, closure: DataFrame, now) -> DataFrame:
    """The dictionary with all conditions that a batch of trials mentions."""
    return store_conditions(dictionary, resolve_conditions(unseen_conditions(mentions, dictionary), atoms, concepts, closure), now)


def retry_unresolved(criteria: DataFrame, trials: DataFrame, atoms: DataFrame, concepts: DataFrame, types: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Criteria after another try for the unresolved rows of some trials, and the ledger (nct_id, rows_attempted, rows_resolved).

    A dry run tells the ledger and leaves criteria as they are. To force trials that were retried before, take them from
    trials_to_retry(include_retried=True).
    """
    mine = criteria.join(trials.select("nct_id").distinct().withColumn("__m", F.lit(True)), "nct_id", "left")
    todo = F.col("__m").isNotNull() & unresolved(F.col("concept_code")) & (trimmed(F.coalesce("concept", F.lit(""))) != "")
    mine = mine.withColumn("__todo", todo)
    found = materialized(resolve_concepts(mine.filter("__todo").drop("__m", "__todo"), atoms, concepts, types).select(*criteria.columns))
    ledger = found.groupBy("nct_id").agg(F.count(F.lit(1)).alias("rows_attempted"), F.count_if(F.col("concept_code").isNotNull()).alias("rows_resolved"))
    return (criteria if dry_run else mine.filter("NOT __todo").select(*criteria.columns).unionByName(found)), ledger


def apply_normalized_terms(criteria: DataFrame, term_map: DataFrame, atoms: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Given concept_norm -> term: blank or NONE is no concept, else the term is resolved and fills every unresolved row of the key.

    Returns criteria, cache rows (concept_norm, normalized_term, code, name, score, resolved) and counters. Semantic types
    are left to backfill_semantic_types.
    """
    t = term_map.select("concept_norm", trimmed(F.col("term")).alias("normalized_term")).withColumn("__none", is_none_term(F.col("normalized_term")))
    found = resolve_queries(t.filter("NOT __none").select(F.col("normalized_term").alias("query")), atoms, concepts)
    cache = t.join(found.select(F.col("query").alias("normalized_term"), F.col("cui").alias("code"), "name", "score"), "normalized_term", "left")
    cache = cache.select("concept_norm", F.when(~F.col("__none"), F.col("normalized_term")).alias("normalized_term"), "code", "name", "score", F.col("code").isNotNull().alias("resolved"), "__none")
    fill = cache.filter("resolved").select(F.col("concept_norm").alias("__norm"), "code", "name", "score")
    j = criteria.withColumn("__norm", normalize_key(F.col("concept"))).join(fill, "__norm", "left").withColumn("__hit", unresolved(F.col("concept_code")) & F.col("code").isNotNull())
    new = {"concept_code": "code", "umls_name": "name", "match_score": "score"}
    out = j.select(*(F.when(F.col("__hit"), F.col(new[c])).otherwise(F.col(c)).cast(criteria.schema[c].dataType).alias(c) if c in new else F.col(c) for c in criteria.columns))
    told = cache.agg(F.count_if("resolved").alias("resolved"), F.count_if("__none").alias("not_a_concept")).crossJoin(j.agg(F.count_if("__hit").alias("rows_updated")))
    return out, cache.drop("__none"), told


def apply_embeddings(texts: DataFrame, vectors: DataFrame, stored: DataFrame, model: str, backlog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored embeddings after a batch, and counters. texts: nct_id, source_text (to embed); vectors: nct_id, embedding (null: failed).

    backlog: nct_id of all studies that should have a vector of the model; with it the counters tell how many still have none.
    """
    t = texts.filter(trimmed(F.coalesce("source_text", F.lit(""))) != "").join(vectors, "nct_id", "left")
    good = t.filter(F.col("embedding").isNotNull()).select("nct_id", "embedding", F.lit(model).alias("model"), "source_text")
    counts = t.agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    if backlog is not None:
        have = stored.filter(F.col("model") == model).select("nct_id").unionByName(good.select("nct_id"))
        left = backlog.select("nct_id").distinct().join(have, "nct_id", "left_anti").agg(F.count(F.lit(1)).alias("remaining"))
        counts = counts.crossJoin(F.broadcast(left))  # one row
    return upsert(stored, good, ["nct_id"]), counts
