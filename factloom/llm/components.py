"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, release


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root: the component's least node, whose own row is included.

    Each round hooks neighbours onto least neighbours in both directions; the number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder, so lineage stays short.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = durable(edges.filter("a <> b").select(high, low).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least neighbours are written before they are joined: a hot node's edges can be split then.
        least = durable(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = durable(large, "large-star")
        first = durable(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = large.join(first, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = durable(small.select("e.a", "e.b").filter("a <> b").distinct(), "small-star")
        # Stars are left when no node is both below and above another, or below two: then the rounds have come to rest.
        ends = after.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("below")), F.struct(F.col("b").alias("u"), F.lit(0).alias("below")))).alias("e")).select("e.u", "e.below")
        unrest = ends.groupBy("u").agg(F.sum("below").alias("n"), F.min("below").alias("least")).filter("n > 1 or (n > 0 and least = 0)")
        done = unrest.isEmpty()
        release(now, least, large, first)
        now = after
        if done:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
