"""Kept options and sketches against a scan of the whole table, after random replacements of a stored one."""

import os
import random

import pytest

from critmill.operators import search as se
from critmill.operators.options import OptionTable
from critmill.sources.store import Keyed, Store

SCHEMA = "nct_id string, kind string, few string, many string"
COLUMNS = ["kind", "few", "many", "none"]


def make(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA + ", none string").coalesce(1)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def pairs(t):
    return {(r.column_name, r.value) for r in t.collect()}


def test_follows_a_store(spark, tmp_path):
    rnd = random.Random(8)
    store = Store(spark, f"{tmp_path}/s", {"criteria": Keyed(SCHEMA + ", none string", ["nct_id"], ["nct_id"])}, 4)
    kept = OptionTable(spark, f"{tmp_path}/o", COLUMNS, buckets=4, cap=12)
    now: dict[str, list] = {}
    for number in range(1, 4):
        tried = [f"n{i}" for i in (range(40) if number == 1 else [3, 5])]
        rows = [(i, rnd.choice(["a", " b", "", None]), f"f{rnd.randrange(9 + number)}", f"m{rnd.random()}") for i in tried for _ in range(rnd.randrange(1, 9))]
        if number == 3:
            rows = []  # both lose their rows
        now |= {i: [r for r in rows if r[0] == i] for i in tried}
        store.commit(number, {"criteria": store.replace("criteria", make(spark, rows), make(spark, [(i, "", "", "") for i in tried]))})
        before = files(kept.store.root)
        touched = kept.follow(store, "criteria")
        assert touched == (list(range(4)) if number == 1 else store.changed("criteria", number - 1, number))
        written = {int(f.split("bucket=")[1].split("/")[0]) for f in files(kept.store.root) - before}
        assert len(written) <= len(touched)
        assert kept.follow(store, "criteria") == []
        want = make(spark, [r for x in now.values() for r in x])
        for cap in (12, 3):
            assert pairs(kept.options(cap)) == pairs(se.filter_options(want, COLUMNS, cap))
        got = {r.column_name: r.estimate for r in kept.estimates().collect()}
        exact = {c: len({r[i + 1] for x in now.values() for r in x if r[i + 1] is not None}) for i, c in enumerate(COLUMNS[:3])} | {"none": 0}
        assert all(abs(got[c] - n) <= 0.05 * n for c, n in exact.items()), (number, got, exact)
    store.vacuum(keep=1)
    assert store.changed("criteria", 1, 3) == list(range(4))


def test_cap_is_exact_across_buckets(spark, tmp_path):
    """A column within the cap in each bucket can exceed it in all; one beyond it in one bucket only is out."""
    rows = [(f"n{i}", "k", f"f{i % 20}", f"m{i}" if i < 400 else "m") for i in range(600)]
    t = make(spark, rows)
    kept = OptionTable(spark, f"{tmp_path}/o", COLUMNS, buckets=8, cap=20)
    kept.replace(1, t)
    assert pairs(kept.options()) == pairs(se.filter_options(t, COLUMNS, 20)) == {("kind", "k")} | {("few", f"f{i}") for i in range(20)}
    assert pairs(kept.options(19)) == {("kind", "k")}


def test_empty_table_and_other_keys(spark, tmp_path):
    kept = OptionTable(spark, f"{tmp_path}/o", COLUMNS, buckets=2)
    kept.replace(1, make(spark, []).limit(0))
    assert pairs(kept.options()) == set() and {r.estimate for r in kept.estimates().collect()} == {0}
    other = Store(spark, f"{tmp_path}/s", {"t": Keyed("k string", ["k"], ["k"])}, 2)
    with pytest.raises(ValueError):
        kept.follow(other, "t")
