import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta"] + [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(120), text(30)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "one", None, "b", 3), (5, "two words", "en", "b", 9)]
    rows += [(6, base, "en", "a", 5), (7, base, "en", "a", 5), (8, base + " tail", "en", "c", 5), (9, text(15000), "en", "c", 5), (10, "x" * 30000, "en", "a", 5)]
    rows += [(11, "z " * 4000, "en", "a", 5), (12, base, "en", "a", 5), (12, base, "en", "a", 5), (13, text(40) + " " + passage + " " + text(40), "fr", "a", 5)]
    rows += [(14, text(25) + " " + passage + " " + text(60), "fr", "d", 5), (15, "日本語 " * 50, "ja", "d", 5), (16, "Á é 🙂 'tis we're <|endoftext|>", "en", "d", 5)]
    rows += [(100 + i, text(rnd.randrange(1, 400)), "en", rnd.choice("abcdef"), 7) for i in range(60)]
    rows = [r + ("mine", 1.0) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, rank double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
