"""Connected components of a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import checkpointed


#: A node with more than one in so many of all edges is hot: there are at most twice as many of them.
HOT_SHARE = 1000


def _with_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """`edges` with the `low` of their `a`; hot nodes, whose number is bounded, are broadcast, so that no
    task meets all edges of one."""
    hot = F.col("n") * HOT_SHARE > total
    found = edges.join(F.broadcast(low.where(hot).select("a", F.col("low").alias("hot_low"))), "a", "left")
    cold = found.where("hot_low IS NULL").drop("hot_low").join(low.where(~hot).select("a", "low"), "a")
    return cold.unionByName(found.where("hot_low IS NOT NULL").withColumnRenamed("hot_low", "low"))


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the smallest node of its component) of every node that is not a root.

    `edges` has two columns of one orderable type. A round links each node's larger neighbours to the
    smallest one it knows, then each node's smaller ones; the rounds needed grow with the logarithm of
    the largest component, and no component is ever gathered in a task: a node only asks for a minimum,
    which is combined before the shuffle, and its edges stay where they are if it has very many. Each round
    is checkpointed.
    """
    a, b = edges.columns
    current = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    seen, total = None, current.count()
    least = [F.min("b").alias("low"), F.count(F.lit(1)).alias("n")]
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(*least).select("a", F.least("a", "low").alias("low"), "n")
        large = _with_low(both, low, total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = _with_low(large, large.groupBy("a").agg(*least), total)
        moved = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = checkpointed(moved.unionByName(small.select("a", F.col("low").alias("b"))).distinct())
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, total = state, state[0]
