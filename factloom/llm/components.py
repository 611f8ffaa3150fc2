"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Tables of at most this many nodes are broadcast (16 bytes each).
FEW = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one type. Returns node, component (the smallest node reachable) for nodes other than the smallest.

    Every step hangs a node's neighbours below its smallest one; the number of steps grows with the logarithm of the
    component's diameter. Each round is cut to the shared folder; only a count and a checksum reach the driver."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen, now = None, state()
    while now != seen:
        few = 2 * now[0] <= FEW  # no table of nodes has more rows than that

        def lowest(pairs: DataFrame) -> DataFrame:
            """a, low. One row a node: broadcast where those are few, else written out, so that Spark can split the rows
            of a hub in the join."""
            low = pairs.groupBy("a").agg(F.min("b").alias("low"))
            return F.broadcast(low) if few else cut(low)

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(lowest(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).filter("a <> b").distinct()
        large = large if few else cut(large)
        pairs = large.join(lowest(large), "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
        e = cut(pairs.filter("a <> b").distinct())
        seen, now = now, state()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
