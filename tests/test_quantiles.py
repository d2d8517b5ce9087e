"""Quantiles in two scans: shapes of values, missed brackets, narrowing, and the number of jobs."""

import random
import uuid

import numpy as np
import pytest

from tablegauge.operators import quantiles as q
from tablegauge.operators.column_stats import NULLS, row_count
from tablegauge.operators.profiling import numeric_summary

SHAPES = {
    "one": [5.0],
    "two": [1.0, 4.0],
    "same": [7.0] * 500,
    "hot": [7.0] * 400 + [float(i) for i in range(800)],
    "halves": [0.0] * 300 + [1.0] * 300,
    "ends": [float("-inf")] * 5 + [float(i) for i in range(90)] + [float("inf")] * 5,
    "spread": [random.Random(1).lognormvariate(0, 4) for _ in range(3000)],
    "zeros": [-0.0, 0.0] * 40 + [1e-300, -1e300],
}
AT = (0.0, 0.01, 0.25, 0.5, 0.505, 0.75, 0.99, 1.0)


def table(spark):
    longest = max(map(len, SHAPES.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in SHAPES.values()) + (None, float("nan")) for i in range(longest)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in [*SHAPES, "empty", "no.number"])).repartition(4)


def check(df, **options):
    got = {(r[0], r[1]): r[2] for r in q.quantiles(df, None, AT, **options).collect()}
    assert set(got) == {(n, p) for n in SHAPES for p in AT}
    for name, values in SHAPES.items():
        for p in AT:
            position = (len(values) - 1) * p
            rank = int(position)
            ordered = sorted(values)
            expected = ordered[rank]
            if position > rank:
                expected += (ordered[rank + 1] - expected) * (position - rank)
            assert got[name, p] == pytest.approx(expected, rel=1e-12, nan_ok=True), (name, p)


@pytest.mark.parametrize("options", [{}, {"size": 64}, {"size": 16, "limit": 50}, {"limit": 0}, {"size": 2000, "limit": 10}])
def test_shapes(spark, options):
    check(table(spark), **options)


def test_missed_brackets_are_widened(spark, monkeypatch):
    """Brackets far narrower than the error of the sketch: counts tell, and wider ones are counted."""
    monkeypatch.setattr(q, "WIDTHS", (1e-4, 2e-4, 3e-4, 4e-4))
    monkeypatch.setattr(q, "_half_widths", lambda size: [1e-6, 1e-5, 0.01, 0.2])
    check(table(spark), size=16)


def test_other_aggregates_and_powers(spark):
    df = table(spark)
    names = ["spread", "hot"]
    found = q.two_scans(df, names, (0.5,), [row_count()], powers=True)
    assert found.row["n_rows"] == 3000 and NULLS
    for name in names:
        x = np.array(SHAPES[name])
        for power, got in zip((2, 3, 4), found.powers[name], strict=True):
            assert got == pytest.approx(((x - x.mean()) ** power).sum(), rel=1e-9)
    assert q.two_scans(df, []).quantiles == {}


def test_jobs(spark):
    """Two scans of the table, whatever the number of columns: the jobs are those of their two shuffles."""
    df = spark.range(50_000).selectExpr("id % 777 AS a", "id * 1.5 AS b", "sin(id) AS c", "-id AS d")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    numeric_summary(df).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8, len(jobs)
