"""Tree order against a depth-first walk: ties, cycles, hot parents and long chains."""

import datetime as dt
import random

import pytest

from tablegauge.operators.history import tree_order

SCHEMA = "dataset_id long, parent_dataset_id long, created_at timestamp"
START = dt.datetime(2024, 1, 1)


def walk(rows):
    """(dataset_id, root, depth, position), the walk begun at rows without a known parent."""
    known = {r[0] for r in rows}
    children, out = {}, {}
    for i, parent, when in rows:
        children.setdefault(parent if parent in known else None, []).append((when, i))
    for _, root in children.get(None, []):
        waiting, position = [(root, 0)], 0
        while waiting:
            node, depth = waiting.pop()
            out[node] = (node, root, depth, position)
            position += 1
            waiting += [(i, depth + 1) for _, i in sorted(children.get(node, []), reverse=True)]
    return sorted(out.values())


def got(spark, rows):
    frame = tree_order(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return sorted((r.dataset_id, r.root_id, r.depth, r.position) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, rng.choice([None, 77_777, *ids[:at]] if at % 9 == 0 else ids[:at] or [None]), START + dt.timedelta(days=rng.randrange(5))) for at, i in enumerate(ids)]
    assert got(spark, rows) == walk(rows)


def test_a_hot_parent_and_nothing(spark):
    rows = [(0, None, START)] + [(i, 0, START + dt.timedelta(days=-i % 7)) for i in range(1, 500)]
    assert got(spark, rows) == walk(rows)
    assert tree_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cycles_are_cut(spark):
    rows = [(1, 3, START), (2, 1, START), (3, 2, START), (4, 2, START), (9, 9, START), (10, 9, START)]
    assert got(spark, rows) == [(1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0), (4, 2, 1, 1), (9, 9, 0, 0), (10, 9, 1, 1)]


def test_a_long_chain(spark):
    """20,000 versions, each the parent of the next: rows stay as short as any."""
    chain = spark.range(20_000).selectExpr("id AS dataset_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_dataset_id", "TIMESTAMP '2024-01-01 00:00:00' AS created_at")
    placed = tree_order(chain)
    assert set(placed.columns) == {"dataset_id", "parent_dataset_id", "created_at", "root_id", "depth", "position"}
    assert placed.where("depth = dataset_id AND position = dataset_id AND root_id = 0").count() == 20_000
