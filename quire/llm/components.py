"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of one ordered type to ``(node, root)``: the smallest node it is connected with.

    Large star and small star in turn: every node links its larger neighbours, then its smaller ones,
    to the smallest node it knows, until every node hangs on its root. Each step is a minimum per node,
    combined before the shuffle, and a join on the node, whose hot keys adaptive execution splits; no
    neighbourhood is ever collected. The number of rounds is about the logarithm of the longest path.
    Each round is written, so that a lost executor costs one round at most. Edges with a null end and
    loops are left out; an empty table gives an empty one.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        if large:
            around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        if large:
            joined = around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            joined = around.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
            joined = joined.unionByName(least.select("a", F.col("root").alias("b")))
        return joined.filter(F.col("a") != F.col("b")).distinct()

    links = stored(
        edges.select("a", "b")
        .filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    shape = F.sum(F.hash("a", "b").cast("long")).alias("s"), F.count("*").alias("n")
    before = links.agg(*shape).first()
    while True:
        links = stored(star(star(links, True), False), name)
        now = links.agg(*shape).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
