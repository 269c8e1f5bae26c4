"""Terminology release files: pipe-separated lines to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from .tables import materialized

#: Source vocabularies that are loaded by default, in order of preference.
VOCABULARIES = ["SNOMEDCT_US", "MSH", "RXNORM", "LNC", "ICD10CM", "MDR"]


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(lines.columns[0], r"\|", -1).alias("f"))


def read_atoms(lines: DataFrame, vocabularies: list[str] = VOCABULARIES) -> DataFrame:
    """English, unsuppressed atoms of the given vocabularies (none given: all): cui, str, str_norm, sab, tty, is_pref."""
    f = F.col("f")
    t = _fields(lines).filter(F.size("f") >= 17)
    t = t.filter((f[1] == "ENG") & (f[16] == "N") & (F.trim(f[14]) != ""))
    if vocabularies:
        t = t.filter(F.upper(f[11]).isin([v.upper() for v in vocabularies]))
    return t.select(f[0].alias("cui"), f[14].alias("str"), normalize_key(f[14]).alias("str_norm"), f[11].alias("sab"), f[12].alias("tty"), (f[6] == "Y").alias("is_pref"))


def read_relations(lines: DataFrame, sab: str = "SNOMEDCT_US") -> DataFrame:
    """child_cui, parent_cui of parent and child relations of one vocabulary."""
    f = F.col("f")
    t = _fields(lines).filter(F.size("f") >= 11)
    t = t.filter((f[10] == sab) & (F.trim(f[0]) != "") & (F.trim(f[4]) != "") & (f[0] != f[4]) & f[3].isin("PAR", "CHD"))
    up = f[3] == "PAR"
    return t.select(F.when(up, f[0]).otherwise(f[4]).alias("child_cui"), F.when(up, f[4]).otherwise(f[0]).alias("parent_cui"))


def read_semantic_types(lines: DataFrame) -> DataFrame:
    """cui, tui, sty."""
    f = F.col("f")
    t = _fields(lines).filter((F.size("f") >= 4) & (F.trim(f[0]) != "") & (F.trim(f[3]) != ""))
    return t.select(f[0].alias("cui"), f[1].alias("tui"), f[3].alias("sty"))


def load_semantic_types(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows and those of new (cui, tui) pairs, one a pair (the smallest name)."""
    fresh = rows.groupBy("cui", "tui").agg(F.min("sty").alias("sty"))
    return stored.select("cui", "tui", "sty").unionByName(fresh.join(stored.select("cui", "tui"), ["cui", "tui"], "left_anti"))


def semantic_type_dimension(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """tui and sty: a loaded name takes the place of the stored one."""
    fresh = rows.groupBy("tui").agg(F.min("sty").alias("sty"))
    return fresh.unionByName(stored.select("tui", "sty").join(fresh.select("tui"), "tui", "left_anti"))


def build_concepts(atoms: DataFrame, priority: list[str] = VOCABULARIES) -> DataFrame:
    """One preferred name a concept: preferred atoms first, then by vocabulary, then the shortest, then by text."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("sab")), F.lit(0)), F.lit(9))
    best = F.min_by(F.struct("str", "sab"), F.struct((~F.col("is_pref")).cast("int"), rank, F.length("str"), F.col("str"), F.col("sab")))
    return atoms.groupBy("cui").agg(best.alias("b")).select("cui", F.col("b.str").alias("pref_name"), F.col("b.sab").alias("root_source"))


def concept_closure(edges: DataFrame, depth: int | None = 2) -> DataFrame:
    """descendant, ancestor, min_distance up to `depth` levels (to the end where it's None), without self pairs; cycles do no harm.

    Semi-naive: each level extends the pairs that the level before found first, and keeps those not seen yet, so a pair's level is
    its least distance. Beyond two levels every level is written, so that its plan doesn't hold those before it, and the loop ends with
    a level that finds nothing.
    """
    e = edges.filter("child_cui <> parent_cui").select(F.col("child_cui").alias("descendant"), F.col("parent_cui").alias("ancestor")).distinct()
    keep = (lambda t: t) if depth is not None and depth <= 2 else materialized
    e = keep(e)
    step = e.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("next"))
    level = e.withColumn("min_distance", F.lit(1))
    levels, d = [level], 1
    while depth is None or d < depth:
        d += 1
        seen = reduce(DataFrame.unionByName, levels).select("descendant", "ancestor")
        level = level.join(step, "ancestor").select("descendant", F.col("next").alias("ancestor")).filter("descendant <> ancestor").distinct()
        level = keep(level.join(seen, ["descendant", "ancestor"], "left_anti").withColumn("min_distance", F.lit(d)))
        if keep is materialized and level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def hierarchy_stats(closure: DataFrame) -> DataFrame:
    return closure.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("descendant").alias("descendants"), F.max("min_distance").alias("max_depth"))


def load_completeness(concepts: DataFrame, types: DataFrame, closure: DataFrame, least_rows: int = 1000) -> DataFrame:
    """Concepts without a semantic type (0 when complete) and whether the hierarchy has enough rows."""
    missing = concepts.join(types.select("cui"), "cui", "left_anti").agg(F.count(F.lit(1)).alias("without_type"))
    return missing.crossJoin(closure.agg((F.count(F.lit(1)) >= least_rows).alias("hierarchy_ok")))
