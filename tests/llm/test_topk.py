"""Exact top-k by bounds against brute force."""

import math
import random

import numpy as np
import pytest

from tablegauge.llm import topk
from tablegauge.llm.queries import op7_exact_top_k


def brute(rows, every, k):
    valid = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, vector) in enumerate(valid):
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(vector, c, strict=False)), i) for other, (i, c) in enumerate(valid) if other != at]
            out += [(q, rank + 1, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, every, k, kind="float"):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, emb array<{kind}>, id int, rank int")
    vectors = topk.integer_vectors(table.repartition(3), "vec_id", "emb")
    return sorted(map(tuple, topk.top_inner_products(vectors, vectors.where(f"id % {every} = 0"), k).collect()))


@pytest.mark.parametrize(("width", "spread"), [(16, 1.0), (3, 0.02), (1, 1.0)])
def test_same_as_brute_force(spark, monkeypatch, width, spread):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = random.Random(width)
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(width)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(40)] + [(500, [0.0] * width), (510, [5.0] * width)]
    rows += [(600, None), (610, [None] * width), (620, [math.nan] * width), (630, [math.inf] + [1.0] * (width - 1)), (None, [1.0] * width)]
    rows += [rows[5]] * 3 + [rows[30]] * 2 + [(40, rows[7][1])]
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_few_or_odd_rows(spark):
    assert run(spark, [], 10, 5) == []
    assert run(spark, [(0, [1.0])], 10, 5) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, 2.0, 9.0]), (4, [1e30, 0.0])]
    got = run(spark, rows, 10, 5)
    assert [r[2] for r in got] == [4, 3, 1, 2] and got[1][3] == 256 * 256 * 3
    same = [(i, [0.5, 0.5]) for i in range(30)]
    assert run(spark, same, 10, 3) == brute(same, 10, 3)
    assert run(spark, [(0, []), (1, []), (0, [])], 10, 3) == [(0, 1, 0, 0), (0, 1, 0, 0), (0, 2, 1, 0), (0, 2, 1, 0)]


def test_repeated_rows_are_rows(spark):
    """Each copy of a row is a candidate, also of the query's id; a copy of a query is a query."""
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.5])]
    assert run(spark, rows, 10, 3) == brute(rows, 10, 3)
    assert [r[2] for r in run(spark, rows, 10, 3)] == [0, 0, 1, 1, 1, 1]


def test_large_components_are_exact(spark):
    """Components beyond 2 ** 53 after scaling, sums beyond doubles, and scores beyond longs."""
    rows = [(0, [1.0, 0.00390625]), (1, [1e9, 1.0]), (2, [1e9, 1.0 + 1 / 256]), (3, [2e6, 0.0]), (4, [3e6, 0.0]), (5, [-1e18, 3.0])]
    rows += [(10, [1e12, 1.0]), (20, [1e200, -1.0])]
    got = run(spark, rows, 10, 9, "double")
    assert [r for r in got if r[0] < 20] == [r for r in brute(rows, 10, 9) if r[0] < 20]
    assert [r[2] for r in got if r[0] == 0] == [20, 10, 2, 1, 4, 3, 5]
    assert max(r[3] for r in got) == 2**63 - 1


def read_share(matrix, query, k=3):
    """Share of the lists' entries that a query reads, and its result."""
    read = []

    class Counted(topk.Block):
        def read(self, used, from_end, first, end):
            read.append(len(used) * (end - first))
            return super().read(used, from_end, first, end)

    numbers = np.arange(len(matrix)).tobytes()
    found = topk.query_top(-1, np.asarray(query, dtype=float), Counted.of(numbers, numbers, matrix.astype(float).tobytes()), k)
    expected = sorted((-int(s), i) for i, s in enumerate(matrix @ np.asarray(query)))[:k]
    assert sorted((-s, i) for i, s in found) == expected
    return sum(read) / matrix.size


def test_reading_stops_early():
    """Where some lists tell the best apart, less than half of the entries are read."""
    rng = np.random.default_rng(0)
    spread = np.floor(rng.lognormal(3, 2, (1600, 4))).astype(np.int64)
    assert read_share(spread, [7, 1, 2, 1]) < 0.5
    assert read_share(-spread, [-7, -1, -2, 0]) < 0.5
    one = rng.integers(-3, 4, (1600, 4)).astype(np.int64)
    one[:, 0] = np.arange(1600) * 100
    assert read_share(one, [7, 1, 1, 1]) < 0.1
    assert read_share(np.full((200, 3), 5), [1, 1, 1]) > 0.9


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)] + [(50, None), (None, [1.0] * 8)]
    rows += [rows[100], rows[7]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, op7_exact_top_k(spark, str(tmp_path)).collect())) == brute(rows, 50, 5)
