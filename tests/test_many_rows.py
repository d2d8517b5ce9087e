"""Joins over many runs and issues: what cannot match is spread over tasks, and issues are read once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablegauge.operators.diff import choose_baselines, diff_summary, mark_new_issues
from tablegauge.queries.version_queries import version_issue_compare
from tablegauge.sources.run_store import RunStore

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def by_shuffle(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def many_runs(spark, n=8000):
    return spark.range(n).select(
        F.col("id").alias("run_id"), (F.col("id") % 4).alias("project_id"), F.lit("COMPLETED").alias("status"), F.lit(DAY).alias("completed_at"),
        F.when(F.col("id") % 100 == 7, F.col("id") - 1).alias("baseline_run_id"),
    )


def test_runs_without_a_named_baseline_are_spread(spark, by_shuffle):
    """all of them met in the task of the null key."""
    found = choose_baselines(many_runs(spark))
    assert largest_share(found) < 0.5
    chosen = dict(found.collect())
    assert (len(chosen), chosen[107], chosen[4], chosen[7996], chosen[7992]) == (8000, 106, 7996, 7992, 7996)


def test_issues_without_a_match_are_spread(spark, by_shuffle):
    """issues without fingerprint met in one task a baseline."""
    issues = spark.range(8000).select(F.col("id").alias("run_id"), F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 50 == 1, "a").alias("fingerprint"))
    baselines = issues.select("run_id", F.lit(1).cast("bigint").alias("chosen_baseline_id"))
    marked = mark_new_issues(issues, baselines)
    assert largest_share(marked) < 0.5
    assert marked.where("NOT is_new").count() == 160 and marked.count() == 8000 and "__spread" not in marked.columns


def test_diff_summary_counts_repeated_rows_as_before(spark):
    issues = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (1, ""), (2, "a"), (2, "a"), (2, "c"), (2, None), (2, ""), (None, "a")], "run_id bigint, fingerprint string"
    )
    baselines = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, 1), (None, 1)], "run_id bigint, chosen_baseline_id bigint")
    got = sorted(tuple(r) for r in diff_summary(issues, baselines).where("run_id IS NOT NULL").collect())
    twice = (2, 1, True, 6, 4, 1)
    assert got == [(1, None, False, 4, 0, 0), twice, twice, (3, 1, True, 0, 0, 2)]


def test_superseded_rows_without_the_runs_in_the_plan(spark, tmp_path):
    """readers joined all pairs of run and commit with themselves, and aggregated whole rows."""
    store = RunStore(spark, str(tmp_path / "store"))
    frame = lambda ids, kind: spark.createDataFrame([(i, i % 3, kind) for i in ids], "run_id bigint, project_id bigint, kind string")
    store.write(frame(range(20), "a"), frame([*range(20), 4], "a"), "one")
    store.write(frame(range(4, 8), "b"), frame([5, 5], "b"), "two")
    store.write(frame([5, 30], "c"), frame([30], "c"), "three")
    assert sorted((r.run_id, r.kind) for r in store.runs().collect()) == [(i, "c" if i in (5, 30) else "b" if 4 <= i < 8 else "a") for i in [*range(20), 30]]
    assert sorted((r.run_id, r.kind) for r in store.issues().collect()) == [*[(i, "a") for i in range(20) if not 4 <= i < 8], (30, "c")]
    assert not [f for f in store.issues().inputFiles() if "/runs/" in f]
    # all rows of a commit met in one task to be given its number
    assert "hashpartitioning(commit" not in store.issues()._jdf.queryExecution().executedPlan().toString()
    assert len(store.runs().inputFiles()) == len(set(store.runs().inputFiles()))
    assert "max_by" not in store.runs()._jdf.queryExecution().toString()


def test_versions_compared_from_one_read_of_the_issues(spark, tmp_path):
    """all issues were shuffled four times, for each side and use."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, f"c{i}", 1, 1.0, "x") for i in range(3)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    write([(1,)], "p_partkey bigint", "part")
    write([(10 + i, i, "F", 1.0, DAY, "x") for i in range(3)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", "orders")
    write(
        [(10, 1, 1, 1, 5.0, "A", "F"), (10, 2, 1, 2, 5.0, "A", "F"), (11, 1, 1, 1, 50.0, "A", "F"), (11, 3, 1, 2, 5.0, "A", "F"), (12, 3, 1, 6, 9.0, "N", "F")],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
        "lineitem",
    )
    found = version_issue_compare(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "lineitem" in f]
    rows = sorted((r.pair, r.status, r.issue_id, r.previous_severity, r.row_count_delta) for r in found.collect())
    key = lambda run, part, line: ((run * 100000 + part) * 10000 + 1) * 10 + line
    assert rows == [
        (1, "common", key(11, 1, 1), "info", 45),
        (1, "new", key(11, 3, 2), None, None),
        (1, "resolved", key(10, 2, 2), None, None),
        (2, "new", key(12, 3, 6), None, None),
        (2, "resolved", key(11, 1, 1), None, None),
        (2, "resolved", key(11, 3, 2), None, None),
    ]
