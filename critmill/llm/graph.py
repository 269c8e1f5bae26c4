"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that it reaches) for every node of the edges (a, b) that isn't a root itself.

    Each round moves every edge to the smallest neighbour that its ends know, so distances to a root
    halve. A node's smallest neighbour comes from a partial aggregation and is joined as a written
    table, so a node with many edges (they hang on its smaller end) can be split.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    e = save(edges.filter("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct())
    for _ in range(rounds):
        mins = save(e.groupBy("hi").agg(F.min("lo").alias("m")))
        t = e.join(mins.hint("merge"), "hi").select("hi", "lo", F.col("m").alias("mh"))
        t = t.join(mins.select(F.col("hi").alias("lo"), F.col("m").alias("ml")).hint("merge"), "lo", "left")
        aim = F.least("mh", F.coalesce("ml", "lo"))
        ends = F.array(F.struct(F.col("hi").alias("hi"), aim.alias("lo")), F.struct(F.col("lo").alias("hi"), aim.alias("lo")))
        moved = t.select(F.inline(ends)).filter("hi > lo").distinct()
        new = save(moved)
        # Settled: every node has one edge, and no smaller end has an edge to something smaller still.
        n, nodes = new.count(), mins.count()
        same = n == nodes and n == e.count() and new.join(e.hint("merge"), ["hi", "lo"], "left_anti").isEmpty()
        drop_saved(mins)
        drop_saved(e)
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
