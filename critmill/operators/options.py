"""Distinct values and their estimated numbers, kept by bucket of a table so that they're read without scanning it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_if_empty, trimmed
from ..sources.store import Keyed, Store
from ..sources.tables import materialized

TABLES = {"options": Keyed("part int, column_name string, sketch binary, options array<string>", ["part"], ["part", "column_name"])}


class OptionTable:
    """For each bucket of a table's key and each column: a sketch of its distinct values, and the values themselves if there are at most `cap`.

    A column with at most `cap` values in all has at most so many in every bucket, so what is kept tells its values exactly, and has at most
    buckets * columns * cap values. Sketches of buckets merge. Neither forgets a value, so a changed bucket is made anew
    from its own rows, and the others stay as files.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str], key: str = "nct_id", buckets: int = 64, cap: int = 500) -> None:
        self.store = Store(spark, root, TABLES, buckets)
        self.columns, self.key, self.cap, self.buckets = columns, key, max(1, min(cap, 500)), self.store.buckets

    def bucket(self) -> Column:
        """The bucket of a row: that of a Store which keeps the table by the same key in as many buckets."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def replace(self, number: int, rows: DataFrame, touched: list[int] | None = None) -> None:
        """rows: all that the touched buckets (by default, all buckets) hold now. A number that exists already changes nothing."""
        if number in self.store.numbers():
            return
        spark, touched = self.store.spark, list(range(self.buckets)) if touched is None else touched
        rows = rows.select(self.bucket().alias("part"), *(F.col(c).cast("string").alias(c) for c in self.columns))
        rows = rows.filter(F.col("part").isin(touched))
        # Of hashes, since sketches of texts leave out the empty one.
        sketched = rows.groupBy("part").agg(*(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c))).alias(c) for c in self.columns))
        sketched = sketched.select("part", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("sketch")) for c in self.columns))))
        sketched = materialized(sketched)  # a row a bucket and column
        # Sketches err by some per cent: what has over twice the cap by them has more than the cap, all else few values.
        narrow = sketched.filter(F.hll_sketch_estimate("sketch") <= 2 * self.cap).groupBy("part").agg(F.collect_set("column_name").alias("narrow"))
        values = rows.join(F.broadcast(narrow), "part")  # a row a bucket
        values = values.select("part", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(F.array_contains("narrow", c), F.col(c)).alias("value")) for c in self.columns))))
        values = values.filter(null_if_empty(trimmed(F.col("value"))).isNotNull()).distinct()
        values = values.groupBy("part", "column_name").agg(F.sort_array(F.collect_list("value")).alias("found"))
        values = materialized(values)
        full = sketched.join(values.hint("merge"), ["part", "column_name"], "left").join(F.broadcast(narrow), "part", "left")
        known = F.coalesce(F.array_contains("narrow", F.col("column_name")), F.lit(False)) & (F.coalesce(F.size("found"), F.lit(0)) <= self.cap)
        made = full.select("part", "column_name", "sketch", F.when(known, F.coalesce("found", F.array().cast("array<string>"))).alias("options"))
        tried = spark.createDataFrame([(b,) for b in touched], "part int")
        self.store.commit(number, {"options": self.store.replace("options", made, tried)})

    def follow(self, source: Store, name: str) -> list[int]:
        """Catches up with a table's latest version, reads the buckets that changed since the version followed last, and returns them."""
        if source.buckets != self.buckets or source.tables[name].by != [self.key]:
            raise ValueError("the source must have the same key and buckets")
        number, last = source.latest(), self.store.latest()
        touched = source.changed(name, last, number)
        if number > last:
            self.replace(number, source.read(name, touched, number), touched)
        return touched

    def estimates(self) -> DataFrame:
        """column_name, estimate (see search.distinct_estimates); a column without rows has 0."""
        merged = self.store.read("options").groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
        names = self.store.spark.createDataFrame([(c,) for c in self.columns], "column_name string")
        return names.join(merged.hint("merge"), "column_name", "left").fillna(0, ["estimate"])

    def options(self, cap: int | None = None) -> DataFrame:
        """column_name, value (see search.filter_options): none of a column that has more than `cap` (at most the table's)."""
        cap = self.cap if cap is None else max(1, min(cap, self.cap))
        kept = self.store.read("options").filter(F.col("column_name").isin(self.columns))
        sets = kept.groupBy("column_name").agg(F.bool_or(F.col("options").isNull()).alias("wide"), F.array_distinct(F.flatten(F.collect_list("options"))).alias("options"))
        return sets.filter(~F.col("wide") & (F.size("options") <= cap)).select("column_name", F.explode("options").alias("value"))
