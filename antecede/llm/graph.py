"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``links`` has columns a and b, root is the smallest node reachable.

    Each round lets every node hang its larger (then its smaller) neighbours on its smallest one, which
    needs O(log n) rounds; the links of a round are stored, so a lost executor costs no earlier round.
    Neighbours are never gathered: the smallest is an aggregate, joined back to the links.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                              F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.where("a <> b").distinct(), "links")
        # a star has every node once on the left, and no root on the left
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
