"""Distinct (trial, concept) pairs and their counts, kept from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Change, Keyed, Store
from ..sources.tables import BROADCAST_ROWS, materialized
from .cohorts import with_descendants
from .search import resolved

TABLES = {
    "by_trial": Keyed("nct_id string, concept_code string", ["nct_id"], ["nct_id", "concept_code"]),
    "by_code": Keyed("nct_id string, concept_code string", ["concept_code"], ["nct_id", "concept_code"]),
    "counts": Keyed("concept_code string, trials long", ["concept_code"], ["concept_code"]),
    "size": Keyed("what string, trials long", ["what"], ["what"]),
}


def looked_up(keys: DataFrame) -> DataFrame:
    """Keys of a join that keeps or drops rows: broadcast where few, else hashed by partition, so that the rows needn't be sorted."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


class PairTable:
    """Pairs by trial and by concept, trials of each concept, and the number of trials with a resolved criterion.

    `replace` takes the criteria of some trials and corrects all four by what differs from their earlier pairs, so its work follows the trials
    that changed; the buckets of other trials and concepts stay as files. All four tables change in one version, and a replay under the
    same number changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.store = Store(spark, root, TABLES, buckets)

    def replace(self, number: int, trials: DataFrame, criteria: DataFrame) -> None:
        """trials: nct_id of all whose rows are replaced; criteria: their new rows (of other trials none counts)."""
        store = self.store
        if number in store.numbers():
            return
        both = ["nct_id", "concept_code"]
        trials = materialized(trials.select("nct_id").distinct())
        mine = looked_up(trials)
        # Dealt by trial once, the rows lie right for the distinct pairs too.
        new = materialized(resolved(criteria).select(*both).join(mine, "nct_id", "left_semi").distinct())
        touched = store.touched("by_trial", trials)
        kept = store.read("by_trial", touched)
        met = new.select(*both, F.lit(False).alias("was"), F.lit(True).alias("stays"))
        if not kept.isEmpty():
            old = kept.join(mine, "nct_id", "left_semi").select(*both, F.lit(True).alias("was"), F.lit(False).alias("stays"))
            met = materialized(old.unionByName(met).groupBy(*both).agg(F.max("was").alias("was"), F.max("stays").alias("stays")))
        gone, come = met.filter("was AND NOT stays").select(*both), met.filter("stays AND NOT was").select(*both)
        delta = materialized(met.filter("was <> stays").groupBy("concept_code").agg(F.sum(F.when(F.col("stays"), 1).otherwise(-1)).alias("trials")))
        codes = store.touched("by_code", delta)
        by_code = store.read("by_code", codes).join(looked_up(gone), both, "left_anti").select(*both).unionByName(come)
        counts = store.upsert("counts", delta, {"trials": "increment"})
        counts = Change(counts.rows.filter("trials > 0"), counts.touched)
        size = met.groupBy("nct_id").agg(F.max("was").alias("was"), F.max("stays").alias("stays"))
        size = materialized(size.agg((F.count_if("stays") - F.count_if("was")).alias("trials")).select(F.lit("trials").alias("what"), "trials"))
        store.commit(number, {
            "by_trial": Change(kept.join(mine, "nct_id", "left_anti").select(*both).unionByName(new), touched),
            "by_code": Change(by_code, codes),
            "counts": counts,
            "size": store.upsert("size", size, {"trials": "increment"}),
        })

    def counts(self) -> DataFrame:
        """concept_code, trials: the corpus profile."""
        return self.store.read("counts")

    def size(self) -> DataFrame:
        """One row: trials."""
        return self.store.read("size").agg(F.coalesce(F.sum("trials"), F.lit(0)).alias("trials"))

    def members(self, value: str, closure: DataFrame | None = None) -> DataFrame:
        """Trials of a concept, with a closure of its descendants too; reads the buckets of those concepts only."""
        codes = materialized(with_descendants(value, closure, self.store.spark))
        rows = self.store.read("by_code", self.store.touched("by_code", codes))
        return rows.join(codes, "concept_code", "left_semi").select("nct_id").distinct()

    def profile(self, members: DataFrame) -> DataFrame:
        """concept_code, trials, size of a cohort (see cohorts.cohort_profile; without its row for an empty profile)."""
        members = materialized(members)
        rows = self.store.read("by_trial", self.store.touched("by_trial", members))
        per = rows.join(members, "nct_id", "left_semi").groupBy("concept_code").agg(F.count(F.lit(1)).alias("trials"))
        return per.crossJoin(F.broadcast(members.agg(F.count(F.lit(1)).alias("size"))))  # one row
