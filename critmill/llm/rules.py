"""Quality rules with thresholds from quantile sketches of each language and source: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_join

SPACE = " \t\n\x0b\x0c\r"
#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

#: Measures, each a whole number: a share (per 10,000) or, for length, characters per 100 words. For each: the least spread that a fence is built on, and whether it has
#: a lower fence as well. A measure that hardly varies inside a group would otherwise reject whatever differs at all.
MEASURES = {
    "symbols": (500, False),
    "length": (80, True),
    "capitals": (500, False),
    "marks": (250, False),
    "dup_lines": (1500, False),
    "repeats": (1000, False),
    "stutter": (300, False),
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(words: Column, doublings: int = 3) -> Column:
    """Hashes (64 bits) of all runs of 2 ** doublings words: those of one word, then of each run and the one that follows it."""

    def doubled(h: Column, k: int) -> Column:
        n = F.greatest(F.size(h) - k, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))

    def more(h: Column, done: int) -> Column:
        return h if done == doublings else let(doubled(h, 1 << done), lambda x: more(x, done + 1))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: more(h, 0))


def repeated_words(words: Column, doublings: int = 3) -> Column:
    """Words that stand in a window of 2 ** doublings words found twice or more in the array, each counted once.

    Texts without a repeated window end there; else windows are sorted with their places, those with an equal
    neighbour stay, and their places, in order, tell how many words each adds to those covered before.
    """
    window = 1 << doublings

    def covered(h: Column) -> Column:
        def twins(s: Column) -> Column:
            near = lambda e, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == e["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == e["h"]))
            return F.sort_array(F.transform(F.filter(s, near), lambda e: e["i"]))

        places = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twins)
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"))
        found = F.aggregate(places, start, add, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    return let(windows(words, doublings), covered)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the MEASURES (null where a text has no word)."""
    t = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("__text"))
    t = t.withColumn("__words", F.filter(F.split(F.trim("__text", F.lit(SPACE)), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    without = lambda pattern: (F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))).cast("long")
    per_text = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated"), F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))]))).cast("long").alias("again"))
    t = t.select(
        "doc_id", "lang", "source", let(F.col("__words"), per_text).alias("__w"), without(SYMBOLS).alias("n_symbols"), without(r"\p{Lu}").alias("__capitals"), without(r"[\p{P}\p{S}]").alias("__marks"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
    )
    t = t.select("doc_id", "lang", "source", F.col("__w.n").alias("n_words"), F.col("__w.chars").alias("word_chars"), "n_symbols", F.col("__w.repeated").alias("n_repeat_words"), F.col("__w.again").alias("__again"), "__lines", "__capitals", "__marks")
    parts = {"symbols": "n_symbols * 10000L div nullif(n_words, 0)", "length": "word_chars * 100L div nullif(n_words, 0)", "capitals": "__capitals * 10000L div nullif(word_chars, 0)"}
    parts |= {"marks": "__marks * 10000L div nullif(word_chars, 0)", "dup_lines": "__lines.dup * 10000L div nullif(__lines.n, 0)", "repeats": "n_repeat_words * 10000L div nullif(n_words, 0)", "stutter": "__again * 10000L div nullif(n_words, 0)"}
    return t.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("__lines.dup").alias("n_dup_lines"), "n_repeat_words", *(F.expr(parts[m]).alias(m) for m in MEASURES))


def sketch(measures: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Quantile sketches: keys, measure, value, n. A value keeps its 7 leading bits, so a quantile is at most 1/64 too low.

    A sketch is a table of counts. Of any parts of the data, in any order, `merge` gives the very sketch of the whole, so
    that reruns and retried tasks agree; each group has some thousand values at most, whatever its documents. Counts are summed in each task
    before they are shuffled.
    """
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES)))
    t = measures.select(*keys, each).filter("value IS NOT NULL")
    t = t.withColumn("value", F.expr("value - value % shiftleft(1L, greatest(0, length(bin(value)) - 7))"))
    return t.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The sketch of several sketches' data."""
    t = first
    for x in others:
        t = t.unionByName(x)
    return t.groupBy(*[c for c in first.columns if c != "n"]).agg(F.sum("n").alias("n"))


def coarser(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Groups merged into those of fewer keys."""
    return sketches.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], name: str, reach: float = 3.0) -> DataFrame:
    """One row a group: a struct `name` of its number of documents and, for each measure, low and high.

    The fence stands `reach` times the spread between the quartiles (at least the measure's least spread) beyond them.
    """
    s = F.struct
    cells = Window.partitionBy(*keys, "measure")
    t = sketches.withColumn("__upto", F.sum("n").over(cells.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("n").over(cells))
    at = lambda part: F.min(F.when(F.col("__upto") * 4 >= F.col("__all") * part, F.col("value")))
    q = t.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("__all").alias("docs"))
    made = [F.max("docs").alias("docs")]
    for m, (least, both) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * F.lit(float(reach))
        mine = F.col("measure") == m
        made.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{m}_high"))
        made.append(F.max(F.when(mine, F.col("q1") - spread if both else F.lit(0.0))).alias(f"{m}_low"))
    q = q.groupBy(*keys).agg(*made)
    return q.select(*keys, s(*[c for c in q.columns if c not in keys]).alias(name))


def thresholds(sketches: DataFrame, least: int = 200, reach: float = 3.0) -> DataFrame:
    """lang, source and the fences that hold there: of the group itself, of its language where the group has fewer than `least` documents, of all where that has."""
    own, lang = fences(sketches, ["lang", "source"], "own", reach), fences(coarser(sketches, ["lang"]), ["lang"], "by_lang", reach)
    t = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").select("o.*", "by_lang")
    t = t.crossJoin(F.broadcast(fences(coarser(sketches, []), [], "everywhere", reach)))  # one row
    return t.select("lang", "source", F.when(F.col("own.docs") >= least, F.col("own")).when(F.col("by_lang.docs") >= least, F.col("by_lang")).otherwise(F.col("everywhere")).alias("fence"))


def filter_quality(docs: DataFrame, min_words: int = 20, max_repeats: int = 30, least: int = 200, reach: float = 3.0) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and reasons (the measures outside their fences; none looked at where the base failed).

    Documents fail the base below `min_words` words or with over `max_repeats` percent of words in repeated windows. The others'
    measures make a sketch a language and source, fences come from its quartiles, and each document is joined with the fences of its group.
    Sketches and fences are small written tables; the fences are broadcast below BROADCAST_ROWS groups and joined by shuffle beyond.

    A null text counts as empty; texts without a word fail the base; a null lang or source is a group of its own; repeated rows count
    and return as often as they stand there; rows without doc_id as others. An empty table gives an empty result. Columns of other names, the added ones among them, don't matter.
    """
    t = save(measured(docs))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeats)
    sketches = save(sketch(t.filter(~base)))
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))  # noqa: E731  a null joins as well
    keys = {"__lang": named("lang"), "__source": named("source")}
    rules = save(thresholds(sketches, least, reach).withColumns(keys).select(*keys, "fence"))
    t = small_join(t.withColumns(keys), rules, list(keys))
    out = [F.when((F.col(m) > F.col(f"fence.{m}_high")) | (F.col(m) < F.col(f"fence.{m}_low")), m) for m in MEASURES]
    t = t.withColumn("base_failed", base).withColumn("reasons", F.when(base, "").otherwise(F.concat_ws(",", *out)))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("reasons") == "")).alias("kept"), "reasons")
