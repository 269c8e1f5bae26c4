"""Inverted indexes of a terminology's texts, for the fuzzy arms of the candidate search."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes, trigrams
from ..sources.tables import counted_join, materialized

#: Taken from a bound before it's rounded up, so that a quotient's last bit never shortens a prefix.
EPS = 1e-9


@dataclass
class FuzzyIndex:
    """Written tables.

    texts: tid, str, na (lexemes), ng (grams), lex, grams. names: str, cui and the cui's place among those of the text.
    postings: key, tid: of a key (lexemes, rarest first) of at most `many` texts all of them, else the `best` of fewest lexemes (ties by text).
    frequent: keys of over `many` texts, one table a key length. lexeme_counts: n of the frequent lexemes.
    gram_counts: gram, n. grams: gram, tid, ng and the gram's place among the text's grams, rarest first.
    """

    texts: DataFrame
    names: DataFrame
    postings: DataFrame
    frequent: list[DataFrame]
    lexeme_counts: DataFrame
    gram_counts: DataFrame
    grams: DataFrame
    many: int
    best: int
    levels: int


def fit(atoms: DataFrame, max_len: int) -> DataFrame:
    """Atoms that the fuzzy arms look at: no overlong ones, no panels of several names."""
    return atoms.filter((F.length("str") <= max_len) & ~F.contains(F.col("str"), F.lit(" | ")))


def _common(texts: DataFrame, counts: DataFrame, carry: list[str]) -> DataFrame:
    """carry and common: the frequent lexemes of each text, rarest first; texts without one are left out."""
    each = counted_join(texts.select(*carry, F.explode("lex").alias("lexeme")), counts, "lexeme")
    return each.groupBy(*carry).agg(F.sort_array(F.collect_list(F.struct("n", "lexeme"))).alias("common"))


def _first(common: DataFrame) -> DataFrame:
    """Keys of one frequent lexeme: key and at, its place among `common`."""
    return common.select("*", F.posexplode("common").alias("at", "__c")).withColumn("key", F.col("__c.lexeme")).drop("__c")


def _longer(rows: DataFrame) -> DataFrame:
    """Each key and one more of the text's frequent lexemes, a more frequent one."""
    rest = F.slice("common", F.col("at") + 2, F.greatest(F.size("common") - F.col("at") - 1, F.lit(0)))
    t = rows.select("*", F.posexplode(rest).alias("__i", "__c"))
    return t.withColumn("at", F.col("at") + 1 + F.col("__i")).withColumn("key", F.concat_ws(" ", "key", "__c.lexeme")).drop("__i", "__c")


def build_index(atoms: DataFrame, max_len: int = 80, many: int = 1000, best: int = 40, levels: int = 4) -> FuzzyIndex:
    """Indexes the texts of atoms (str, cui), once for any number of searches.

    Why `postings` suffice to find a query's `best` texts: let M be the lexemes that a text shares with the query. If one
    of them, or the shortest run of M's rarest ones that isn't frequent, has `many` texts or fewer, the text stands in that key's list. Else M as a whole is a
    frequent key, and if the text isn't among its best, those share all of M and have as few lexemes or fewer: each ranks before it. So no list is longer than
    `many` (or `best`). Keys of `levels` lexemes are the last; they keep all their texts.
    """
    place = F.row_number().over(Window.partitionBy("str").orderBy("cui"))
    names = materialized(fit(atoms, max_len).select("str", "cui").distinct().withColumn("place", place))
    texts = names.select("str").distinct().withColumn("lex", lexemes(F.col("str"))).withColumn("grams", trigrams(F.col("str")))
    texts = materialized(texts.select(F.monotonically_increasing_id().alias("tid"), "str", F.size("lex").alias("na"), F.size("grams").alias("ng"), "lex", "grams"))
    each = texts.select("tid", "str", "na", F.explode("lex").alias("key"))
    counts = materialized(each.groupBy(F.col("key").alias("lexeme")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many))
    frequent = [counts.select(F.col("lexeme").alias("key"))]
    order = Window.partitionBy("key").orderBy("na", "str")
    top = lambda t: t.withColumn("__i", F.row_number().over(order)).filter(F.col("__i") <= best).select("key", "tid")
    several = levels > 1 and not counts.isEmpty()
    parts = [(counted_join(each, frequent[0], "key", "left_anti") if several else each).select("key", "tid")]
    if several:
        rows = materialized(_first(_common(texts, counts, ["tid", "str", "na"])))
        parts.append(top(rows))
        for level in range(2, levels + 1):
            rows = materialized(_longer(rows))
            if level == levels or rows.isEmpty():
                parts.append(rows.select("key", "tid"))
                break
            keys = materialized(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many).select("key"))
            parts.append(counted_join(rows, keys, "key", "left_anti").select("key", "tid"))
            if keys.isEmpty():
                break
            frequent.append(keys)
            rows = counted_join(rows, keys, "key", "left_semi")
            parts.append(top(rows))
    postings = materialized(reduce(DataFrame.unionByName, parts))
    gram_counts = materialized(texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    grams = materialized(placed_grams(texts.select("tid", "ng", "grams"), gram_counts, ["tid", "ng"]))
    return FuzzyIndex(texts, names, postings, frequent, counts, gram_counts, grams, many, best, levels)


def first_names(index: FuzzyIndex, limit: int) -> FuzzyIndex:
    """The index with the `limit` smallest concepts of each text, for searches that keep the best `limit` of a query, ties to the smaller.

    All concepts of a text have its rank, so one behind `limit` others of that text is never among the best through it.
    """
    return replace(index, names=index.names.filter(F.col("place") <= limit))


def placed_grams(texts: DataFrame, counts: DataFrame, carry: list[str]) -> DataFrame:
    """gram, at, carry: each gram of a text with its place in the order of how many indexed texts hold it."""
    each = counted_join(texts.select(*carry, F.explode("grams").alias("gram")), counts, "gram", "left")
    rows = each.groupBy(*carry).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("__g"))
    return rows.select(*carry, F.posexplode("__g").alias("at", "__c")).select("__c.gram", "at", *carry)


def query_keys(queries: DataFrame, index: FuzzyIndex) -> DataFrame:
    """query, key: the index's keys that a query's lexemes (lex) make. Longer keys only continue frequent ones."""
    out = queries.select("query", F.explode("lex").alias("key"))
    if index.levels < 2 or index.lexeme_counts.isEmpty():
        return out
    rows = _first(_common(queries, index.lexeme_counts, ["query"]))
    for keys in index.frequent[: index.levels - 1]:
        rows = materialized(_longer(counted_join(rows, keys, "key", "left_semi")))
        out = out.unionByName(rows.select("query", "key"))
    return out


def token_candidates(queries: DataFrame, index: FuzzyIndex) -> DataFrame:
    """query, tid: texts among which are the best of each query (lex). A query's key meets a list of bounded length."""
    return query_keys(queries, index).join(index.postings.hint("merge"), "key").select("query", "tid").distinct()


def needed(nq: Column, na: Column, least: float) -> Column:
    """Grams that sets of these sizes must share to be alike enough."""
    return F.ceil((nq + na) * (least / (1 + least)) - EPS)


def gram_candidates(queries: DataFrame, index: FuzzyIndex, least: float) -> DataFrame:
    """query, tid (with repeats): texts whose grams may be alike enough. queries: query, nq, grams.

    Grams stand rarest first. Alike sets share one of the first n - ceil(least * n) + 1 grams of either; the first gram they share
    leaves enough places behind it on both sides for what else they must share. So the most frequent grams of a text are
    neither looked up nor found.
    """
    n, at = F.col("nq"), F.col("at")
    probes = materialized(placed_grams(queries, index.gram_counts, ["query", "nq"]).filter(at <= n - F.ceil(n * least - EPS)).select("gram", "query", "nq", F.col("at").alias("i")))
    g = index.grams.filter(at <= F.col("ng") - F.ceil(F.col("ng") * least - EPS))
    sizes = (F.col("nq") * least <= F.col("ng") + EPS) & (F.col("ng") * least <= F.col("nq") + EPS)
    places = F.least(F.col("nq") - F.col("i"), F.col("ng") - at) >= needed(F.col("nq"), F.col("ng"), least)
    return probes.join(g, (probes["gram"] == g["gram"]) & sizes & places).select("query", "tid")
