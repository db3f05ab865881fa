"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from swellframe.sources.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of all nodes with an edge.

    ``edges`` has long columns ``a`` and ``b``. Alternates two steps that hang each node's
    neighbours on its smallest one, until nothing changes: a logarithmic number of rounds in
    practice. Each round is stored, so lost executors repeat one round at most. A node's
    neighbours are aggregated and joined, never gathered.
    """
    current = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = larger.filter("a <> b").distinct()
        # Now every edge leads to a smaller node: hang all of them on the smallest.
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        hung = hung.unionByName(least.select("a", F.col("least").alias("b")))
        current = written(hung.filter("a <> b").distinct(), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
