"""The indexed fuzzy arms against brute force, and how many rows their joins make."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from critmill.operators import index as ix
from critmill.operators import resolve as re_


def words_of(text):
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


def grams_of(text):
    return {f"  {w} "[i : i + 3] for w in words_of(text) for i in range(len(w) + 1)}


@pytest.fixture(scope="module", autouse=True)
def few_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def terms():
    """Texts of words whose frequencies fall off steeply: the first few stand in a third of all texts."""
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in ("aro", "eni", "ilu", "osta") for c in ("", "n", "mic", "sis")]
    weights = [1 / (i + 1) ** 1.1 for i in range(len(vocabulary))]
    make = lambda: " ".join(dict.fromkeys(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 7))))
    atoms = [(f"C{rnd.randrange(200):04d}", make()) for _ in range(900)]
    queries = sorted({make() for _ in range(120)} | {"baro", "zzz", "baro zzz", "Baro, BARO!", atoms[0][1] + "x"})
    return atoms, queries


def brute_tokens(atoms, queries, k):
    texts, out = sorted({s for _, s in atoms}), set()
    for q in queries:
        ranked = [(-(1 + min(0.999, len(words_of(q) & words_of(s)) / len(words_of(q)) / (1 + math.log(len(words_of(s)))))), s) for s in texts if words_of(q) & words_of(s)]
        best = {s for _, s in sorted(ranked)[:k]}
        out |= {(q, c, round(-r, 9)) for r, s in ranked if s in best for c, x in atoms if x == s}
    return out


def brute_trigrams(atoms, queries, least):
    out = set()
    for q in queries:
        for c, s in set(atoms):
            a, b = grams_of(q), grams_of(s)
            r = len(a & b) / len(a | b)
            if r >= least:
                out.add((q, c, round(r, 9)))
    return out


@pytest.mark.parametrize("many, levels", [(3, 4), (20, 2), (20, 1), (100_000, 4)])
def test_token_arm(spark, terms, many, levels):
    """The same rows whatever counts as frequent: keys of one lexeme, of several, or whole lists."""
    atoms, queries = terms
    a, q = spark.createDataFrame(atoms, "cui string, str string"), spark.createDataFrame([(x,) for x in queries], "query string")
    index = ix.build_index(a, many=many, best=40, levels=levels)
    got = {(r.query, r.cui, round(r["rank"], 9)) for r in re_.token_arm(q, a, index=index).collect()}
    assert got == brute_tokens(atoms, queries, 40)
    if levels == 4:
        sizes = [r.n for r in index.postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.size(F.split("key", " ")) < 4).collect()]
        assert max(sizes) <= max(many, 40)


def test_token_joins_are_bounded(spark, terms):
    """Frequent lexemes don't meet all queries: far fewer rows than all shared lexemes make."""
    atoms, queries = terms
    a, q = spark.createDataFrame(atoms, "cui string, str string"), spark.createDataFrame([(x,) for x in queries], "query string")
    index = ix.build_index(a, many=10, best=10)
    keys = ix.query_keys(q.withColumn("lex", re_.lexemes(F.col("query"))), index)
    rows = keys.join(index.postings, "key").count()
    shared = Counter(w for _, s in set(atoms) for w in words_of(s))
    everything = sum(shared[w] for x in queries for w in words_of(x))
    assert rows < 0.25 * everything


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_trigram_arm(spark, terms, least):
    """Equal to comparing all pairs; the candidate join makes a small share of all gram matches."""
    atoms, queries = terms
    a, q = spark.createDataFrame(atoms, "cui string, str string"), spark.createDataFrame([(x,) for x in queries], "query string")
    index = ix.build_index(a)
    got = {(r.query, r.cui, round(r["rank"], 9)) for r in re_.trigram_arm(q, a, least, index=index).collect()}
    assert got == brute_trigrams(atoms, queries, least)
    grams = q.withColumn("grams", re_.trigrams(F.col("query"))).select("query", F.size("grams").alias("nq"), "grams")
    rows = ix.gram_candidates(grams, index, least).count()
    held = Counter(g for s in {s for _, s in atoms} for g in grams_of(s))
    everything = sum(held[g] for x in queries for g in grams_of(x))
    assert rows < {0.3: 0.5, 0.8: 0.05}[least] * everything


def test_one_index_serves_searches(spark, terms):
    """With and without a given index, in one pass or with the fallback, rows are the same; an empty side gives none."""
    atoms, queries = terms
    a = spark.createDataFrame(atoms, "cui string, str string").withColumn("str_norm", re_.normalize_key(F.col("str")))
    concepts = a.groupBy("cui").agg(F.min("str").alias("pref_name")).withColumn("root_source", F.lit("MSH"))
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    index = ix.build_index(a, many=50)
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(re_.candidate_search(q, a, concepts, index=index)) == rows(re_.candidate_search(q, a, concepts))
    assert rows(re_.search_with_fallback(q, a, concepts, index=index)) == rows(re_.search_with_fallback(q, a, concepts))
    assert re_.candidate_search(q.limit(0), a, concepts).count() == 0 == re_.candidate_search(q, a.limit(0), concepts).count()


def test_search_meets_few_concepts_of_a_text(spark):
    """A text of many concepts brings no more of them than are kept; the best are those of all."""
    from critmill.operators import index as ix
    from critmill.operators import resolve as re_

    rows = [(f"C{i:03d}", s) for s, step in (("hot bolt", 1), ("hot bolts", 2), ("cold bolt", 3)) for i in range(0, 90, step)]
    atoms = spark.createDataFrame(rows, "cui string, str string").selectExpr("*", "str AS str_norm")
    concepts = atoms.select("cui").distinct().selectExpr("cui", "cui AS pref_name", "'X' AS root_source")
    queries = spark.createDataFrame([("hot boltss",), ("cold bolts",), ("hot bolt",)], "query string")
    index = ix.build_index(atoms)
    few = ix.first_names(index, 15)
    assert few.names.count() == 45
    arms = [re_.exact_arm(queries, atoms), re_.token_arm(queries, atoms, index=index), re_.trigram_arm(queries, atoms, index=index)]
    want = {tuple(r) for r in re_.named_candidates(re_.union_hits(*arms), concepts, 15).collect()}
    assert len(want) == 45 and {tuple(r) for r in re_.candidate_search(queries, atoms, concepts, index=index).collect()} == want
