"""Quality rules and their sketches against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from critmill.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_counts(spark, sf, messy, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet")
    if which == "messy":
        more = ["a b c d e f g h " * 3, "\n \nx\nx\n\nx \r\nx\r\n", "x " * 7, "x " * 9, "p q r s t u v w y p q r s t u v w", "\x0b\x0ctab\tnext", None, "", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"]
        docs = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(500 + i, x, None, "a") for i, x in enumerate(more)], "doc_id long, text string, lang string, source string"))
    out = rules.filter_quality(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.reasons)


def test_empty_and_clashes(spark, messy, empty):
    assert rules.filter_quality(empty).count() == 0
    more = messy.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("x")).withColumn("symbols", F.lit("x")).withColumn("fence", F.lit(1))
    assert rules.filter_quality(more).count() == messy.count()


def test_sketches_merge(spark, sf):
    """Parts merged in any order are the sketch of the whole; quantiles are at most 1/64 too low."""
    m = rules.save(rules.measured(spark.read.parquet(f"{sf}/documents.parquet")).filter("n_words > 0"))
    rows = lambda t: sorted((tuple(r) for r in t.select("lang", "source", "measure", "value", "n").collect()), key=str)
    parts = [rules.sketch(m.filter(F.col("doc_id") % 3 == i)) for i in range(3)]
    assert rows(rules.merge(*parts)) == rows(rules.merge(parts[2], rules.merge(parts[0], parts[1]))) == rows(rules.sketch(m))
    f = rules.fences(rules.coarser(rules.sketch(m), []), [], "f", 0.0).first().f
    values = sorted(r.length for r in m.collect())
    exact = values[-(-3 * len(values) // 4) - 1]
    assert exact * 63 / 64 <= f.length_high <= exact and f.docs == len(values)


def test_thresholds_adapt(spark):
    """A source whose plain texts hold many capitals keeps them; in another, the same text is odd. Small groups take their language's fences."""
    calm = lambda i: " ".join(f"word{i}x{j} plain" for j in range(20))
    loud = lambda i: " ".join(f"WORD{i}X{j} plain" for j in range(20))
    rows = [(i, calm(i), "en", "calm") for i in range(300)] + [(1000 + i, loud(i), "en", "loud") for i in range(300)]
    rows += [(2000, loud(7777), "en", "calm"), (2001, calm(7777), "en", None), (2002, "### &&& $$$ *** " * 0 + " ".join(f"a{j}### b{j}&&&" for j in range(20)), "xx", "few"), (2003, calm(9), None, None)]
    out = {r.doc_id: r for r in rules.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept for i in [*range(300), *range(1000, 1300), 2001, 2003])
    assert not out[2000].kept and "capitals" in out[2000].reasons and not out[2002].kept


def test_registered(spark):
    """Of labelled documents that pass the base, the clean ones stay and the others go. Labels are no input."""
    sf = "/root/testdata/sf0.1"
    t = queries.op12_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in t.groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 0.995 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) < 0.01 * n[0, False]
