"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, save, small_join


def source_targets(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row a source: its words, documents, place in the order, and target words.

    Sources in code-point order, null last, take `weights` in turn; the budget is `share` times
    all words. A target stops at `cap` times its source's words and the excess goes to the others
    by weight until none is above: with sources in order of cap * words / weight, those that stop are a
    prefix, so the common level is found by running sums over one row a source.
    """
    t = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__room", "__order")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("__order"), F.lit(len(weights))) + 1)
    t = t.withColumn("__order", F.row_number().over(by_name) - 1).withColumn("__weight", w)
    t = t.withColumn("__first", F.sum("__docs").over(by_name) - F.col("__docs"))
    t = t.withColumn("__room", F.lit(float(cap)) * F.col("source_size") / F.col("__weight"))
    everything = Window.partitionBy()
    used = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(cap)) * used
    open_weight = F.sum("__weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("__level", left / open_weight)
    level = F.min(F.when(F.col("__level") <= F.col("__room"), F.struct(F.col("__room"), F.col("__order"), F.col("__level")))).over(everything)
    t = t.withColumn("__at", level["__level"])
    most = F.lit(float(cap)) * F.col("source_size")
    return t.withColumn("target", F.when(F.col("__at").isNull(), most).otherwise(F.least(most, F.col("__at") * F.col("__weight")))).drop("__room", "__level", "__at", "__weight")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """Adds size (words), source_size, target, copies and taken (copies * size) to every row.

    Every document of a source is expected target / source_size times. Documents are put in order of
    size inside their source, expected copies are summed along it (a distributed rank times the rate),
    and a document is emitted once for each integer that its interval, shifted by the source's
    one random offset, crosses; in that order the words taken miss the target by no more than about
    one document. The order ends in a hash and the id, so reruns agree.

    Null or blank texts have size 0 and count as documents; a null source is a source of its own; repeated rows
    are documents of their own; a source without words has target 0; an empty table gives an empty result. Input columns named as the
    added ones are replaced; the columns of `carry` (all by default; source and doc_id among them) stay.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    carried = carry or docs.columns
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).select(*carried, "size")
    t = ranked(sized, [F.col("source").isNull(), F.col("source"), F.col("size"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")], "__rank")
    plan = save(source_targets(t, weights, share, cap))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source joins as well
    t = small_join(t.withColumn("__source", key), plan.withColumn("__source", key).drop("source"), ["__source"], "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("__source", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.col("__rank") - F.col("__first")
    crossed = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    t = t.withColumn("copies", F.least(crossed, F.ceil(rate)).cast("int"))
    t = t.withColumn("taken", F.col("copies") * F.col("size"))
    return t.select(*carried, "size", "source_size", "target", "copies", "taken")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as many times as its copies say, without the added columns."""
    many = mixed.filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.drop("__i", "size", "source_size", "target", "copies", "taken")
