"""Preorder of forests by an Euler tour: every node is entered and left once, and the tour is ranked as a list.

From an entry the tour goes to the entry of the first child, or to the node's own exit; from an exit to the
entry of the next sibling, or to the parent's exit. Pointers along the tour are doubled, each with the number
of entries it passes and how much deeper it gets, until all have arrived at the ends. A row holds a few
numbers, however deep its node is, and a tree of n nodes takes log2(2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.session import checkpointed, rewritten

ENTRY, EXIT = 0, 1


def next_siblings(children: DataFrame) -> DataFrame:
    """`id` and `next`, the following child of the same parent, of children (`id`, `parent`, `age`), by age, then id.

    Children are dealt by ranges of their order, so those of one parent may lie in many tasks; the last
    row of each task looks at the first one of the next, of which there is a row a task.
    """
    order = ["parent", "age", "id"]
    dealt = checkpointed(children.select(*order).repartitionByRange(*order).withColumn("task", F.spark_partition_id()))
    firsts = dealt.groupBy("task").agg(F.min(F.struct(*order)).alias("first"))
    beyond = firsts.select("task", F.lead("first").over(Window.orderBy("task")).alias("beyond"))
    within = F.lead(F.struct(*order)).over(Window.partitionBy("task").orderBy(*order))
    seen = dealt.withColumn("following", within).join(F.broadcast(beyond), "task").withColumn("following", F.coalesce("following", "beyond"))
    return seen.select("id", F.when(F.col("following.parent") == F.col("parent"), F.col("following.id")).alias("next"))


def preorder(nodes: DataFrame) -> DataFrame:
    """`id`, `position` (from 0, in its tree) and `depth` of nodes (`id`, `parent`, `age`, `root`).

    Parents come first, siblings by age, then id. A parent must be null (of roots) or the id of a row,
    and there must be no cycles. An empty table gives none.
    """
    nodes = checkpointed(nodes.select("id", "parent", "age", "root"))
    children = nodes.where("parent IS NOT NULL")
    first = children.groupBy(F.col("parent").alias("id")).agg(F.min_by("id", F.struct("age", "id")).alias("first"))
    known = nodes.join(first, "id", "left").join(next_siblings(children), "id", "left")
    to = lambda id_, side: F.struct(F.col(id_).alias("to_id"), F.lit(side).alias("to_side"))
    entry = F.struct(F.lit(ENTRY).alias("side"), F.when(F.col("first").isNotNull(), to("first", ENTRY)).otherwise(to("id", EXIT)).alias("to"))
    leave = F.when(F.col("next").isNotNull(), to("next", ENTRY)).when(F.col("parent").isNotNull(), to("parent", EXIT))
    steps = F.array(entry, F.struct(F.lit(EXIT).alias("side"), leave.alias("to")))
    is_entry = F.col("side") == ENTRY
    state = rewritten(
        known.select("id", F.inline(steps)).select(
            "id", "side", "to.to_id", "to.to_side",
            F.when(is_entry, 1).otherwise(0).cast("bigint").alias("entries"),
            F.when(is_entry, 1).otherwise(-1).cast("bigint").alias("rise"),
        )
    )
    while state.where("to_id IS NOT NULL").limit(1).count():
        there = state.select(*[F.col(c).alias(f"there_{c}") for c in state.columns])
        moved = (
            state.where("to_id IS NOT NULL")
            .join(there, (F.col("to_id") == F.col("there_id")) & (F.col("to_side") == F.col("there_side")))
            .select(
                "id", "side", F.col("there_to_id").alias("to_id"), F.col("there_to_side").alias("to_side"),
                (F.col("entries") + F.col("there_entries")).alias("entries"), (F.col("rise") + F.col("there_rise")).alias("rise"),
            )
        )
        state = rewritten(state.where("to_id IS NULL").unionByName(moved))
    # entries from a node on to the end of its tree, all of them from the root on; the rest of a tour falls to 0
    ranked = nodes.select("id", "root").join(state.where(F.col("side") == ENTRY).select("id", "entries", "rise"), "id")
    sizes = ranked.groupBy("root").agg(F.max("entries").alias("size"))
    return ranked.join(sizes, "root").select("id", (F.col("size") - F.col("entries")).alias("position"), (-F.col("rise")).alias("depth"))
