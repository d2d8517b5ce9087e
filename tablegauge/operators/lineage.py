"""Following parent links to their end, for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.session import checkpointed


def follow_links(links: DataFrame, label: str | None = None) -> DataFrame:
    """(id, end, path) for `links` (id, target[, label]): where each row's chain of targets ends.

    A target that does not exist is no target. A row on a cycle ends at itself; one that leads
    into a cycle ends where it meets the cycle. `path` joins the labels from the end down to the
    row; it is only built once cycles are cut, where no chain is longer than the table.
    """
    nodes = links.select(
        "id", "target", (F.col(label).cast("string") if label else F.lit("")).alias("label")
    )
    state, on_cycle = _walk(nodes.withColumn("label", F.lit("")))
    if on_cycle is not None:
        nodes = nodes.join(on_cycle, F.col("id") == F.col("cycle_id"), "left").select(
            "id", F.when(F.col("cycle_id").isNull(), F.col("target")).alias("target"), "label"
        )
    if on_cycle is not None or label:
        state, _ = _walk(nodes)
    return state.select("id", F.col("at").alias("end"), "path")


def _walk(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pointers doubled until all have arrived, or the cycles that keep some from arriving.

    Every round joins the open pointers with all of them, so a chain of length n takes log2(n)
    rounds. Each round is written to the checkpoint folder: plans stay short, and a lost executor
    costs one round at most. Many rows may point at one hub; the side they are joined to holds one
    row per id, so adaptive execution can split the hub's rows over tasks.
    """
    known = nodes.select(F.col("id").alias("known_id"))
    start = nodes.join(known, F.col("target") == F.col("known_id"), "left").select(
        "id",
        F.coalesce("known_id", "id").alias("at"),
        F.col("label").alias("path"),
        F.col("known_id").isNull().alias("done"),
    )
    state = checkpointed(start)
    total, n_open = state.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
    rounds = 0
    while n_open:
        if rounds > total.bit_length():
            # After more steps than there are rows, an open pointer stands on a cycle.
            return state, state.where("NOT done").select(F.col("at").alias("cycle_id")).distinct()
        there = state.select(*[F.col(c).alias(f"there_{c}") for c in state.columns])
        moved = (
            state.where("NOT done")
            .join(there, F.col("at") == F.col("there_id"))
            .select(
                "id",
                F.col("there_at").alias("at"),
                F.concat("there_path", "path").alias("path"),
                F.col("there_done").alias("done"),
            )
        )
        state = checkpointed(state.where("done").unionByName(moved))
        n_open = state.agg(F.count_if(~F.col("done"))).first()[0]
        rounds += 1
    return state, None
