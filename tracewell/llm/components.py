"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import delete_written, written


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), component being the smallest node reachable.

    Each round moves every node's neighbours to its smallest one, so the number of rounds follows the logarithm of
    the longest path. Rounds are written tables. Loops, repeated edges and edges with a null don't count; a node
    without an edge isn't returned.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, name)
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        delete_written(edges.sparkSession, now)
        now = new
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
