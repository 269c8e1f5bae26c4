"""Text keys, tokens, similarity scores and coercions as Column expressions (no UDF)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as tokens.
STOPWORDS = ["the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "with", "by", "at", "from", "is", "are", "as"]
#: Bullet marks that may lead a line.
BULLETS = r"^\s*[*\-•·◦]\s*"
#: Characters that Markdown lets a backslash escape.
MARKDOWN_ESCAPE = r"\\([\\!\"#$%&'()*+,\-./:;<=>?@\[\]\^_`{|}~])"


def let(value: Column, body) -> Column:
    """body(value) with the value made once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def normalize_key(c: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed; blank or null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def unresolved(code: Column) -> Column:
    """A code that is null or ''."""
    return code.isNull() | (code == "")


def truncate(c: Column, most: int = 2000) -> Column:
    return F.substring(c, 1, most)


def unescape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, MARKDOWN_ESCAPE, "$1")


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(c, BULLETS, "")


def _split(c: Column) -> Column:
    return F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+")


def tokenize(c: Column) -> Column:
    """Distinct lower-case words of two or more characters that aren't stopwords, in order of text."""
    return F.array_distinct(F.filter(_split(c), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)))


def significant_token_count(c: Column) -> Column:
    return F.size(tokenize(c))


def code_tokens(c: Column) -> Column:
    """Distinct lower-case tokens that hold a digit."""
    return F.array_distinct(F.filter(_split(c), lambda t: t.rlike(r"\d")))


def lexemes(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits, with no stopword or length rule."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each lower-case alphanumeric word with two blanks before and one after it."""
    words = F.transform(lexemes(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length on trimmed lower case; 1 for two empty texts."""
    x, y = F.lower(trimmed(F.coalesce(a, F.lit("")))), F.lower(trimmed(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def token_containment(query: Column, candidate: Column) -> Column:
    """Share of the query's tokens that the candidate has; 0 if either has none."""
    q, c = tokenize(query), tokenize(candidate)
    return F.when((F.size(q) > 0) & (F.size(c) > 0), F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)


def acronym_score(raw: Column, candidate: Column, lev: Column) -> Column:
    """0.5 where the raw query is an acronym that stands as a word in the candidate; plus 0.3 of the edit similarity always."""
    is_acronym = F.coalesce(raw, F.lit("")).rlike(r"^[A-Z0-9]{2,6}$")
    word = F.array_contains(_split(candidate), F.lower(raw))
    return F.when(is_acronym & F.coalesce(word, F.lit(False)), 0.5).otherwise(0.0) + 0.3 * lev


def match_score(query: Column, candidate: Column) -> Column:
    """The greatest of edit similarity, token containment and acronym score."""
    lev = levenshtein_similarity(query, candidate)
    return F.greatest(lev, token_containment(query, candidate), acronym_score(query, candidate, lev))


def embedding_text(title: Column, official: Column, summary: Column, conditions: Column, interventions: Column) -> Column:
    """Labelled lines of a study; blank parts are left out, and an official title equal to the title in any case."""
    some = lambda c: trimmed(F.coalesce(c, F.lit(""))) != ""
    line = lambda label, c: F.when(some(c), F.concat(F.lit(label + ": "), trimmed(c)))
    names = F.array_join(F.filter(conditions, some), ", ")
    things = F.filter(interventions, lambda i: some(i["name"]))
    shown = F.transform(things, lambda i: F.when(some(i["type"]), F.concat(i["type"], F.lit(": "), i["name"])).otherwise(i["name"]))
    other = F.when(F.lower(trimmed(F.coalesce(official, F.lit("")))) != F.lower(trimmed(F.coalesce(title, F.lit("")))), official)
    return F.concat_ws("\n", line("Title", title), line("Official title", other), line("Summary", summary), line("Conditions", names), line("Interventions", F.array_join(shown, ", ")))


def semantic_type_text(assignments: Column) -> Column:
    """Semantic type names of an array of (tui, sty), sorted by code point and joined by ', '."""
    return F.array_join(F.array_sort(F.transform(assignments, lambda a: a["sty"])), ", ")


def semantic_type_tuis(assignments: Column) -> Column:
    """Distinct non-empty type ids in input order."""
    return F.array_distinct(F.filter(F.transform(assignments, lambda a: a["tui"]), lambda t: t.isNotNull() & (t != "")))


def coerce_bool(c: Column) -> Column:
    t = F.lower(trimmed(c.cast("string")))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False)


def coerce_int(c: Column) -> Column:
    """Whole part of a number, else null."""
    d = trimmed(c.cast("string")).try_cast("decimal(38,10)")
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).try_cast("int")


def coerce_date(c: Column) -> Column:
    return trimmed(c.cast("string")).try_cast("date")


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("")


def interventions_to_json(c: Column) -> Column:
    return F.coalesce(F.to_json(c), F.lit("[]"))


def interventions_from_json(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<struct<type:string,name:string>>"), F.from_json(F.lit("[]"), "array<struct<type:string,name:string>>"))


def deterministic_id(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clean_generated_text(c: Column) -> Column:
    """Without a code fence and one pair of outer quotes."""
    t = trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return trimmed(F.regexp_replace(t, r'^"([\s\S]*)"$', "$1"))


def is_none_term(c: Column) -> Column:
    return F.upper(trimmed(F.coalesce(c, F.lit("")))).isin("", "NONE")


def tui_from_uri(c: Column) -> Column:
    """The last path segment where it is T and digits, else ''."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"(?:^|/)(T\d+)$", 1), F.lit(""))


def slug(c: Column, style: str = "dash", fallback: str = "export") -> Column:
    """File-name form: other than letters, digits, - and . become - (style 'dash'), or other than letters and digits become _."""
    pattern, fill = (r"[^\p{L}\p{N}.-]", "-") if style == "dash" else (r"[^\p{L}\p{N}]", "_")
    t = F.regexp_replace(F.coalesce(c, F.lit("")), pattern, fill)
    t = F.regexp_replace(t, f"^{fill}+|{fill}+$", "")
    return F.when(t == "", fallback).otherwise(t)


def _seconds(c: Column) -> Column:
    """Seconds of a time, with or without a zone."""
    return c.cast("timestamp").cast("double")


def duration_seconds(started: Column, finished: Column) -> Column:
    return _seconds(finished) - _seconds(started)


def tokens_per_second(tokens: Column, started: Column, finished: Column) -> Column:
    """Null while open or where no time has passed."""
    s = duration_seconds(started, finished)
    return F.when(s > 0, tokens / s)


def average_per_study(total: Column, studies: Column) -> Column:
    """Criteria or seconds a study; 0 without studies or while the total isn't known (a run that is open)."""
    return F.when(studies > 0, F.coalesce(total / studies, F.lit(0.0))).otherwise(0.0)


def run_fraction(done: Column, requested: Column) -> Column:
    return F.when(requested > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / requested))).otherwise(0.0)


def eta(started: Column, now: Column, done: Column, requested: Column) -> Column:
    """Start plus elapsed time per study done, times the studies asked for; null before the first."""
    seconds = _seconds(started) + (_seconds(now) - _seconds(started)) / done * requested
    return F.when(done > 0, F.timestamp_seconds(seconds))


def token_cost(prompt: Column, completion: Column, prompt_rate: float = 5, completion_rate: float = 25) -> Column:
    """US dollars at rates per million tokens."""
    d = lambda c, rate: c.cast("decimal(20,0)") * F.lit(rate).cast("decimal(10,4)") / F.lit(1000000).cast("decimal(10,0)")
    return d(prompt, prompt_rate) + d(completion, completion_rate)
