"""Interleaving of sources by target weights, as a proportionate-fair schedule of blocks.

The schedule follows a fluid mixture: each source that is not used up flows by its share of the weights of
those left. Block i (from 0) of a source is released at the slot in which the flow has passed i blocks of
it, rounded down, and due by that of i + 1 blocks, rounded up. Earliest deadline first over the released
blocks keeps every source less than one block away from its flow at any time, over the whole input. One
task deals the slots; it holds a few numbers a source, whatever the number of blocks.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablegauge.llm.common import checkpointed, row_key

BLOCK_ROWS = 16
#: Weights are integers of about this sum in the schedule, which is exact for them.
WEIGHT_SUM = 1 << 50
#: Without targets a source's weight is its number of rows to this power, so small sources come early.
TEMPERATURE = 0.5
#: Rows of a source are ordered by hash; this many leading bits deal them to tasks.
HASH_BITS = 10
SLOTS_AT_ONCE = 1 << 16


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Source, block, phase and slot of all blocks, in order of slots; a phase ends where a source is used up."""
    order = sorted(range(len(blocks)), key=lambda j: blocks[j] / weights[j])
    # while the flow has `level` blocks a unit of weight, sources of a lower end are used up; of those
    # k, `done[k]` blocks have flown, and the weights of the others sum up to `rest[k]`
    ends, done, rest = array("d", (blocks[j] / weights[j] for j in order)), array("q", [0]), array("q", [sum(weights)])
    for j in order:
        done.append(done[-1] + blocks[j])
        rest.append(rest[-1] - weights[j])

    def flow(j: int, i: int) -> tuple[int, int]:
        """The slot in which `i` blocks of source `j` have flown, rounded down and up."""
        k = bisect_left(ends, i / weights[j])
        whole, part = divmod(i * rest[k], weights[j])
        return done[k] + whole, done[k] + whole + (part > 0)

    source_bits = (1 << 40) - 1
    waiting: list[int] = []  # release and source
    ready: list[int] = []  # deadline and source
    place, due = array("q", [0] * len(blocks)), array("q", [0] * len(blocks))
    after = array("q", [0] * len(blocks))  # release of the source's next block
    for j, n in enumerate(blocks):
        if n:
            after[j], due[j] = flow(j, 1)
            waiting.append(j)
    phase = 0
    for slot in range(sum(blocks)):
        while waiting and (waiting[0] >> 40 <= slot or not ready):
            j = heapq.heappop(waiting) & source_bits
            heapq.heappush(ready, due[j] << 40 | j)
        j = heapq.heappop(ready) & source_bits
        yield j, place[j], phase, slot
        place[j] += 1
        if place[j] == blocks[j]:
            phase += 1
        else:
            release = after[j]
            after[j], due[j] = flow(j, place[j] + 1)
            heapq.heappush(waiting, release << 40 | j)


def period_slots(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks where a source has as many blocks as its weight."""
    slots: dict[str, list[int]] = {name: [] for name in weights}
    names = list(weights)
    for j, _, _, slot in schedule(list(weights.values()), list(weights.values())):
        slots[names[j]].append(slot)
    return slots


def source_weights(labels: list[str], rows: list[int], targets: dict[str, float] | None) -> list[int]:
    """Integer weights in the order of `labels`. Sources without a target share the mean of the targets by `TEMPERATURE`."""
    sizes = [n**TEMPERATURE for n in rows]
    if targets:
        unnamed = sum(x for name, x in zip(labels, sizes, strict=True) if name not in targets)
        mean = sum(targets.values()) / len(targets)
        sizes = [targets[name] if name in targets else mean * x / unnamed for name, x in zip(labels, sizes, strict=True)]
    total = sum(sizes)
    return [max(1, round(x / total * WEIGHT_SUM)) for x in sizes]


def mix(docs: DataFrame, targets: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, prefix: str = "mix_") -> DataFrame:
    """`docs` with all rows and columns, plus `mix_phase`, `mix_slot` and `mix_place` (within the block).

    `targets` gives positive weights by source, `None` as a key those of null sources. Sources it does
    not name share one weight, the mean of the others, by the roots of their sizes. Every source has its
    own place in the schedule. The rows of a source are taken in the order of a hash of id and text;
    repeated rows may swap places. Only a source's last block may be short. An empty table gives an
    empty result. `prefix` renames the new columns; columns of their names are replaced.
    """
    names = [c for c in docs.columns if c not in (f"{prefix}phase", f"{prefix}slot", f"{prefix}place")]
    label = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    by_label = None if targets is None else {"null" if k is None else f"={k}": w for k, w in targets.items()}
    # order by hash: the leading bits deal a source to tasks, row numbers count on over the parts
    key = row_key("doc_id", "text")
    ordered = (
        docs.select(*[F.col(f"`{c}`") for c in names], label.alias("__label"))
        .withColumn("__key", key)
        .withColumn("__part", F.shiftrightunsigned(F.col("__key.a"), 64 - HASH_BITS).cast("int"))
    )
    within = Window.partitionBy("__label", "__part").orderBy("__key")
    sizes = checkpointed(ordered.groupBy("__label", "__part").agg(F.count(F.lit(1)).alias("n")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
        slots = schedule([-(-n // block_rows) for n in rows], source_weights(labels, rows, by_label))
        while some := list(islice(slots, SLOTS_AT_ONCE)):
            source, block, phase, slot = zip(*some, strict=True)
            arrays = [pa.array([labels[j] for j in source]), pa.array(block, pa.int64()), pa.array(phase, pa.int32()), pa.array(slot, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["__label", "__block", "phase", "slot"])

    plan = (
        sizes.groupBy("__label").agg(F.sum("n").alias("rows")).repartition(1).sortWithinPartitions("__label")
        .mapInArrow(deal, "__label string, __block long, phase int, slot long")
    )
    # the slots of each part's blocks go to its rows in one list, by the key that the rows are dealt by already
    before = Window.partitionBy("__label").orderBy("__part")  # 2 ** HASH_BITS rows a source at most
    block_of = lambda row: F.floor(row / block_rows)
    parts = (
        sizes.withColumn("__before", F.sum("n").over(before) - F.col("n"))
        .withColumn("__block", F.explode(F.sequence(block_of(F.col("__before")), block_of(F.col("__before") + F.col("n") - 1))))
        .join(plan, ["__label", "__block"])
        .groupBy("__label", "__part", "__before")
        .agg(F.array_sort(F.collect_list(F.struct("__block", "phase", "slot"))).alias("__slots"))
    )
    row = F.col("__before") + F.col("__at")
    found = F.element_at("__slots", (block_of(row) - block_of(F.col("__before")) + 1).cast("int"))
    return (
        ordered.withColumn("__at", F.row_number().over(within) - 1)
        .join(parts, ["__label", "__part"])
        .select(
            *[F.col(f"`{c}`") for c in names],
            found["phase"].alias(f"{prefix}phase"),
            found["slot"].alias(f"{prefix}slot"),
            (row % block_rows).cast("int").alias(f"{prefix}place"),
        )
    )
